"""Nothing is cut, lost or renumbered: full results, late rows, repeatable ids, pruned lookups."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from watchtide.functions.levels import LEVELS, level_cmp
from watchtide.operators import logs as L
from watchtide.operators.scope import select_aggregate, select_rows
from watchtide.plans.quantiles import exact_quantile
from watchtide.schemas import conform
from watchtide.session import checkpoint_root
from watchtide.sources import signals as S
from watchtide.streaming import ingest as SI
from watchtide.streaming import rollups as SR
from watchtide.streaming.files import read_files, write_batches

MANY = 1500


@pytest.fixture
def folder(spark):
    return f"{checkpoint_root(spark)}/test-{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def many(spark):
    rows = spark.range(MANY).select(
        F.col("id").cast("string").alias("id"), F.lit("t").alias("tenant_id"), F.concat(F.lit("s"), "id").alias("service"), F.lit("error").alias("level"),
        F.lit("prod").alias("environment"), F.lit("boom here").alias("message"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("timestamp"),
    )
    return conform(rows, "logs").cache()


def test_defaults_return_everything(spark, many):
    assert select_aggregate(many, "logs", "t", [("count", "*")], ["service"]).count() == MANY
    assert select_rows(many, "logs", "t").count() == MANY
    assert L.search_logs(many, "t", "boom").count() == MANY
    assert L.label_values(many, "t", "service").count() == MANY
    assert L.label_sets(many, "t").count() == MANY
    as_of = dt.datetime.fromtimestamp(1_700_000_000 + MANY, dt.timezone.utc)
    assert L.stream_selector(many, "t", [], as_of).count() == MANY
    empty = many.limit(0)
    feed = L.timeline(many, empty.withColumns({"status_code": F.lit(""), "name": F.lit(""), "kind": F.lit(""), "duration_ns": F.lit(0)}), empty.withColumns({"kind": F.lit(""), "title": F.lit("")}), "t", as_of)
    assert feed.count() == MANY


def test_a_limit_is_exact_and_ordered(spark, many):
    newest = [str(MANY - 1 - k) for k in range(1200)]
    assert [r.id for r in L.search_logs(many, "t", "boom", limit=1200).collect()] == newest
    first = select_aggregate(many, "logs", "t", [("count", "*")], ["service"], limit=3)
    assert [r.service for r in first.orderBy("service").collect()] == ["s0", "s1", "s10"]
    with pytest.raises(ValueError):
        L.search_logs(many, "t", "boom", limit=0)


def test_export_is_whole(spark, many, folder):
    S.export_result(many.select("id", "service"), folder, "ndjson")
    assert spark.read.json(folder).distinct().count() == MANY


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
@pytest.mark.parametrize("level", ["trace", "warn", "fatal", "odd"])
def test_level_orderings_follow_ranks(spark, op, level):
    rows = spark.createDataFrame([(v,) for v in [*LEVELS, "odd", None]], "level string")
    rank = lambda v: LEVELS.index(v) + 1 if v in LEVELS else 0
    want = {v for v in [*LEVELS, "odd", None] if eval(f"{rank(v)} {op} {rank(level)}")}
    assert {r.level for r in rows.filter(level_cmp(op, level)).collect()} == want


def test_level_filters_reach_the_scan(spark, many, folder):
    many.write.parquet(folder)
    plan = spark.read.parquet(folder).filter(level_cmp(">=", "warn"))._jdf.queryExecution().executedPlan().toString()
    assert "In(level, [error,fatal,warn])" in plan


def test_rows_without_a_value_count(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", None, "e"), ("a", 3, "e"), ("b", None, "e"), ("b", None, "x")], "k string, v bigint, s string")
    got = {r.k: (r.q, r.n, r.e) for r in exact_quantile(rows, ["k"], "v", 0.5, "q", "n", {"e": F.col("s") == "e"}).collect()}
    assert got == {"a": (2.0, 3, 2), "b": (None, 2, 1)}


def test_late_rows_count(spark, folder):
    rows = spark.createDataFrame([("t", "1", 10_000_000), ("t", "2", 10_000_030), ("t", "3", 5), ("t", "1", 10_000_000), ("t", "4", 10_000_000)], "tenant_id string, id string, at bigint")
    rows = rows.withColumn("timestamp", F.timestamp_seconds("at")).drop("at")
    for k, r in enumerate(rows.collect()):
        spark.createDataFrame([r], rows.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = lambda: read_files(spark, f"{folder}/in", rows.schema, 1)
    write_batches(SI.dedup_stream(stream()), f"{folder}/out", f"{folder}/c1", available_now=True).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{folder}/out").collect()) == ["1", "2", "3", "4"]
    SR.stream_rate_windows(stream(), f"{folder}/rates", f"{folder}/c2", available_now=True).awaitTermination()
    counted = SR.read_rate_windows(spark.read.parquet(f"{folder}/rates"), 2)
    assert {(r.window_start, r.requests, r.exceeded) for r in counted.collect()} == {(0, 1, False), (9_999_960, 3, True), (10_000_020, 1, False)}


def test_replayed_batches_keep_their_ids(spark, folder):
    from watchtide.sources.records import IngestConfig

    lines = spark.createDataFrame([("t", '{"message": "m%d"}' % (k % 3)) for k in range(12)] + [("t", "broken"), ("t", " ")], "tenant_id string, value string")
    cfg = IngestConfig(as_of="2024-01-31 00:00:00")
    for parts in (2, 5):
        SI.ingest_batch(lines.repartition(parts), folder, cfg, [], 7, ["logs"])
    stored = S.read_signal(spark, folder, "logs")
    assert stored.count() == 12 and stored.select("id").distinct().count() == 12
    assert spark.read.parquet(f"{folder}/dead_letters").count() == 1


def test_lookup_of_stored_ids_prunes(spark, many, folder):
    S.write_signal(many, folder, "logs")
    batch = many.filter("id < 5").withColumn("yyyymm", S.month_of())
    plan = S.stored_ids(spark, f"{folder}/logs", batch)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    S.write_signal(many, folder, "logs")
    assert S.read_signal(spark, folder, "logs").count() == MANY


def test_ingest_parses_a_batch_once_and_behind_its_shuffle(spark, monkeypatch, folder):
    from watchtide.catalog.streaming import as_stream
    from watchtide.sources.records import IngestConfig

    apply_remap, seen = SI.apply_remap, []
    rows = spark.createDataFrame([("t", '{"message": "m%d"}' % k) for k in range(3)] + [("t", "broken"), ("t", "[1]"), ("t", " ")], "tenant_id string, value string")

    def watched(df, *how, **more):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return apply_remap(df, *how, **more)

    monkeypatch.setattr(SI, "apply_remap", watched)
    SI.ingest_batch(rows, f"{folder}/base", IngestConfig(as_of="2024-01-01T00:00:00Z"), [], 1, ["logs"])
    above, below = seen[0].split("Aggregate", 1)
    assert "parsejson" in above.lower() and "parsejson" not in below.lower(), seen[0]
    assert sorted(r.message for r in spark.read.parquet(f"{folder}/base/logs").collect()) == ["m0", "m1", "m2"]
    dead = spark.read.parquet(f"{folder}/base/dead_letters").select("payload", "error", "status").collect()
    assert sorted(tuple(r) for r in dead) == [("[1]", "not a JSON object", "pending"), ("broken", "not a JSON object", "pending")]

    as_stream(spark.range(10_000).withColumn("value", F.lit("x")), f"{folder}/in", shuffled=True)
    parts = spark.read.parquet(f"{folder}/in")
    assert parts.count() == 10_000
    assert len(parts.inputFiles()) // 4 >= spark.sparkContext.defaultParallelism  # four batches


def test_repeated_and_stored_ids_are_written_once(spark, folder):
    def store(*ids):
        rows = spark.createDataFrame([(t, i) for t, i in ids], "tenant_id string, id string").withColumn("timestamp", F.lit("2024-01-05").cast("timestamp"))
        S.write_signal(conform(rows, "logs"), folder, "logs")
        return sorted((r.tenant_id, r.id) for r in S.read_signal(spark, folder, "logs").collect())

    assert store(("a", "1"), ("a", "2"), ("b", "1")) == [("a", "1"), ("a", "2"), ("b", "1")]
    assert store(("a", "3"), ("a", "4")) == [("a", "1"), ("a", "2"), ("a", "3"), ("a", "4"), ("b", "1")]
    assert store(("a", "3"), ("a", "5"), ("a", "5"), ("c", "1"), ("c", "1")) == [("a", "1"), ("a", "2"), ("a", "3"), ("a", "4"), ("a", "5"), ("b", "1"), ("c", "1")]


def test_cheap_looks_change_no_text(spark):
    from watchtide.functions.fields import is_json_object, json_entries, quote_json
    from watchtide.functions.masking import gate_texts, mask_pii

    odd = ["", "a", 'a"b', "a\\b", "a\nb", "a\n", "\n", "\x00", "\x7f", "é", "日本", "[x]", "[", "/", " ", None]
    texts = spark.createDataFrame([(t,) for t in odd], "t string")
    for r in texts.select("t", quote_json(F.col("t")).alias("fast"), F.trim(F.to_json(F.array("t")), F.lit("[]")).alias("slow")).collect():
        assert r.fast == r.slow, repr(r.t)
    lines = ["{}", '{"a":1}', "[1]", "1", "null", '"x"', "", "{", '{"a":1,"a":2}', '{"a":{"b":null}}', None]
    for r in spark.createDataFrame([(t,) for t in lines], "t string").select("t", is_json_object("t").alias("fast"), json_entries("t").isNotNull().alias("slow")).collect():
        assert r.fast == r.slow, repr(r.t)
    lists = [["4111 1111", "1111 1111"], ["a@b", ".com"], ["x@example.com", "10.0.0.1", "+4912345678"], ["4111 1111 1111 1111", ""], ["", "eyJ"], ["eyJa.b.c"], [""], []]
    rows = spark.createDataFrame([(t,) for t in lists], "t array<string>")
    want = rows.select(F.transform("t", lambda t: mask_pii(t)["text"]).alias("w")).collect()
    assert [r.t for r in gate_texts(rows, "t").collect()] == [r.w for r in want]
