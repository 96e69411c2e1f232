"""Physical patterns against brute force, with one heavy key in the data."""

import random

import pytest
from pyspark.sql import functions as F

from watchtide.plans.closure import components, reachable
from watchtide.plans.lookups import attach
from watchtide.plans.quantiles import exact_quantile
from watchtide.plans.ranking import top_n_per_group
from watchtide.operators import forecast, logs, metrics, traces
from watchtide.plans.sweep import asof_join, paged, running_totals


def heavy(seed, n=600):
    """Rows of which a third share one key."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.34 else f"k{rng.randrange(9)}", rng.randrange(0, 40_000), i) for i in range(n)]


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_join(spark, forward, strict):
    left, right = heavy(1), heavy(2, 200)
    l = spark.createDataFrame(left, "k string, s bigint, i bigint").withColumn("t", F.timestamp_seconds("s"))
    r = spark.createDataFrame(right, "k string, s bigint, v bigint").withColumn("u", F.timestamp_seconds("s")).drop("s")
    got = {x["i"]: x["v"] for x in asof_join(l, r, ["k"], "t", "u", ["u", "v"], forward, strict).collect()}
    assert len(got) == len(left)
    for k, s, i in left:
        if forward:
            hits = [(-t, v) for kk, t, v in right if kk == k and (t > s if strict else t >= s)]
        else:
            hits = [(t, v) for kk, t, v in right if kk == k and (t < s if strict else t <= s)]
        assert got[i] == (max(hits)[1] if hits else None)


def test_running_totals(spark):
    rows = heavy(3)
    df = spark.createDataFrame(rows, "k string, s bigint, i bigint").withColumn("us", F.col("s") * 1_000_000).withColumn("n", F.lit(1))
    got = {x["i"]: x["run_n"] for x in running_totals(df, ["k"], "us", ["i"], ["n"]).collect()}
    for k, s, i in rows:
        assert got[i] == sum(1 for kk, t, j in rows if kk == k and (t, j) <= (s, i))


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_exact_quantile(spark, p):
    rng = random.Random(4)
    rows = [(k, rng.choice([0, 1, 2**40, rng.randrange(10**6), rng.randrange(10**15)])) for k, _, _ in heavy(5, 900)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    got = {x["k"]: x["q"] for x in exact_quantile(df, ["k"], "v", p, "q").collect()}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key)
        at = p * (len(values) - 1)
        low, high = values[int(at)], values[-int(-at // 1)] if at % 1 else values[int(at)]
        assert got[key] == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12)


def test_closure_and_components(spark):
    rng = random.Random(6)
    edges = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(14)} | {("a", "b"), ("b", "a")}
    df = spark.createDataFrame([("t", a, b) for a, b in edges], "t string, a string, b string")
    found = {(x["origin"], x["reached"]) for x in reachable(df, ["t"], "a", "b").collect()}
    closure = set(edges)
    while True:
        more = {(a, d) for a, b in closure for c, d in edges if b == c} - closure
        if not more:
            break
        closure |= more
    assert found == {(a, b) for a, b in closure if a != b}
    label = {x["a"]: x["component"] for x in components(df, ["t"], "a", "b").collect()}
    for a, b in edges:
        assert label[a] == label[b]
    assert all(v == min(n for n in label if label[n] == v) for v in label.values())


def test_attach_spread_or_not(spark):
    left = spark.createDataFrame([("hot" if i % 3 else None if i % 2 else f"k{i}", i) for i in range(300)], "k string, i bigint")
    lookup = spark.createDataFrame([("hot", 1), ("k6", 2)], "k string, v int")
    small = {tuple(r) for r in attach(left, lookup, ["k"], ["v"]).select("k", "i", "v").collect()}
    large = {tuple(r) for r in attach(left, lookup, ["k"], ["v"], spread_by="i").select("k", "i", "v").collect()}
    assert small == large and len(small) == 300


def test_top_n_is_trimmed_before_the_shuffle(spark):
    df = spark.createDataFrame(heavy(7), "k string, s bigint, i bigint")
    top = top_n_per_group(df, ["k"], [F.col("s").desc(), F.col("i")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 3


def test_pages_follow_each_other(spark):
    rng = random.Random(11)
    base = 1_700_000_000 * 10**9
    lines = [("hot" if rng.random() < 0.5 else f"s{rng.randrange(3)}", base + rng.choice([0, 5, rng.randrange(3 * 3600)]) * 10**9 + rng.randrange(3), f"m{rng.randrange(50)}") for _ in range(700)]
    df = spark.createDataFrame(lines, "service string, ts_ns bigint, message string").withColumn("level", F.lit("info"))
    found = logs.to_streams(df, page_size=16).collect()
    assert {len(r.values) for r in found if len(r.values) < 16} != set() and max(len(r.values) for r in found) == 16
    for service in {s for s, _, _ in lines}:
        pages = sorted((r for r in found if dict(r.labels)["service"] == service), key=lambda r: r.page)
        assert [r.page for r in pages] == list(range(len(pages)))
        assert all(len(r.values) == 16 for r in pages[:-1])
        assert [tuple(v) for r in pages for v in r.values] == sorted((t, m) for s, t, m in lines if s == service)
    with pytest.raises(ValueError):
        paged(df, ["service"], "ts_ns", [], 0)
    assert logs.to_streams(df.limit(0)).collect() == []


def test_series_pages(spark):
    points = [("hot", 60 * i, float(i)) for i in range(300)] + [("cold", 0, 1.0), ("cold", 60, float("nan"))]
    df = spark.createDataFrame(points, "service string, bucket bigint, value double").withColumn("metric_name", F.lit("m"))
    found = sorted(metrics.to_matrix(df, page_size=64).collect(), key=lambda r: (r.series_key, r.page))
    assert [(r.metric["service"], r.page, len(r.values)) for r in found] == [("cold", 0, 1)] + [("hot", k, n) for k, n in enumerate((64, 64, 64, 64, 44))]
    assert [tuple(v) for r in found[1:] for v in r.values] == [(b, v) for s, b, v in points if s == "hot"]


def test_smoothing_without_lists_equals_the_loop(spark):
    rng = random.Random(12)
    for alpha in (0.01, 0.3, 0.999, 1, 5, 0):
        rows = [(k, i, rng.uniform(-1e6, 1e6)) for k, n in (("a", 1), ("b", 2), ("c", 700)) for i in range(n)]
        df = spark.createDataFrame(rows, "k string, idx int, v double")
        got = {r.k: r.ewma for r in forecast.ewma(df, alpha, by=["k"]).collect()}
        a = 0.3 if alpha <= 0 else min(alpha, 1)
        for k in got:
            level = None
            for kk, _, v in rows:
                if kk == k:
                    level = v if level is None else a * v + (1 - a) * level
            assert got[k] == pytest.approx(level, rel=1e-9, abs=1e-9)


def test_a_series_of_a_million_buckets_is_smoothed(spark):
    df = spark.range(1_000_000).select(F.lit("a").alias("k"), F.col("id").alias("idx"), (F.col("id") % 10).cast("double").alias("v"))
    level = 0.0
    for i in range(1_000_000 - 500, 1_000_000):  # what lies further back weighs less than 1e-70
        level = 0.3 * (i % 10) + 0.7 * level
    assert forecast.ewma(df, 0.3, by=["k"]).first().ewma == pytest.approx(level, abs=1e-9)


def test_parents_are_filtered_by_the_traces_of_the_window(spark, tmp_path, capsys):
    """Spark builds a bloom filter of the window's traces and pushes it into the scan of parents that are large enough."""
    spans = spark.range(2000).selectExpr(
        "'t' tenant_id", "concat('x', id div 4) trace_id", "cast(id as string) span_id", "if(id % 4 = 0, '', cast(id - 1 as string)) parent_span_id",
        "concat('s', id % 4) service", "'ok' status_code", "id duration_ns", "timestamp_seconds(1700000000 + id) timestamp",
    )
    spans.write.parquet(str(tmp_path / "spans"))
    settings = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    usual = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        edges = traces.service_edges(spark.read.parquet(str(tmp_path / "spans")), "2023-11-14 22:46:39", 600)
        edges.explain("extended")
        assert "might_contain" in capsys.readouterr().out
        assert {(r.caller, r.callee) for r in edges.collect()} == {("s0", "s1"), ("s1", "s2"), ("s2", "s3")}
    finally:
        for name, value in usual.items():
            spark.conf.set(name, value)
