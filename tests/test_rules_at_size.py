"""Work that has to be done once per row, and on all cores."""

import json

from pyspark.sql import functions as F

from watchtide.sources import adapters as A
from watchtide.sources import signals as S
from watchtide.sources.remap import Call, Path, apply_remap
from watchtide.sources.webhooks import normalize_change_webhooks


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_remap_is_not_repeated_by_filters(spark):
    rows = spark.createDataFrame([(k, '{"kind": "a", "n": "%d"}' % k) for k in range(4)], "id bigint, payload string")
    steps = [{"set": "k", "to": Call("upcase", Path("kind"))}, {"set": "n", "to": Call("to_int", Path("n"))}]
    out = apply_remap(rows, steps, default_route="logs")
    kept = out.filter(F.get_json_object("payload", "$.k") == "A").filter(F.get_json_object("payload", "$.n") > 1)
    assert optimized(kept).count("parseJson") == optimized(out).count("parseJson")
    assert sorted(r.id for r in kept.collect()) == [2, 3]


def test_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s")).coalesce(1).write.parquet(path)
    usual = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() > 8  # many splits, and all rows in one of them
        dealt = A.spread(scan).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    assert len(dealt) >= 8 and sum(r["count"] for r in dealt) == 20_000 and max(r["count"] for r in dealt) < 5_000


def test_webhook_bodies_are_read_once(spark):
    bodies = [("GitHub", "deployment", '{"repository":{"name":"r"},"deployment":{"id":7,"sha":"s","creator":{"login":"l"}}}'), ("github", "push", "{}"), ("ld", "", "[1]"), ("svn", "x", "{}")]
    out = normalize_change_webhooks(spark.createDataFrame(bodies, "provider string, event_type string, payload string"))
    assert optimized(out).count("from_json") == 1
    got = sorted((r.service, r.deploy_id, r.author, r.error) for r in out.collect())
    assert got == [("", "", "", "ld payload is not a JSON object"), ("", "", "", "unknown provider svn"), ("r", "7", "l", None)]


def test_large_json_exports_are_arrays_of_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FILE_ROWS", 10)
    rows = spark.range(0, 35, 1, 2).select("id", F.when(F.col("id") % 2 == 0, 'a"\n').alias("s"))
    S.export_result(rows, str(tmp_path / "many"), "json")
    files = [json.loads(p.read_text()) for p in (tmp_path / "many").glob("part-*")]
    assert len(files) == 4 and max(map(len, files)) == 10
    want = [{"id": k, "s": None if k % 2 else 'a"\n'} for k in range(35)]
    assert sorted((r for f in files for r in f), key=lambda r: r["id"]) == want
    S.export_result(rows.filter("id < 10"), str(tmp_path / "few"), "json")
    assert [len(json.loads(p.read_text())) for p in (tmp_path / "few").glob("part-*")] == [10]
    S.export_result(rows.filter("id < 0"), str(tmp_path / "none"), "json")
    assert spark.read.schema("id bigint").option("multiLine", True).json(str(tmp_path / "none")).count() == 0
