"""Folded states of batches: bounded folders, and nothing lost or doubled when a step breaks off."""

import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from watchtide.operators import alerts as A
from watchtide.streaming import states


def summed(df):
    return df.groupBy("k").agg(F.sum("n").alias("n"))


def test_folders_stay_few():
    live, written = [], 0
    for number in range(10_000):
        live.append((0, f"{number}-{number}"))
        written += sum(len(merged) for merged, _ in states.folds(live))
        assert len(live) <= 15 * 4
        covered = [tuple(map(int, name.split("-"))) for _, name in live]
        assert covered[0][0] == 0 and covered[-1][1] == number
        assert all(a[1] + 1 == b[0] for a, b in zip(covered, covered[1:]))
    assert written < 10_000 * 1.1  # folders read by folds


def test_broken_steps_lose_and_double_nothing(spark, tmp_path, monkeypatch):
    """Every write may break off before or after it happened; the batch then comes again."""
    rng = random.Random(3)
    out, want, usual = str(tmp_path / "out"), {}, DataFrameWriter.parquet
    fails = {"on": True}

    def parquet(self, path, *args, **kwargs):
        luck = rng.random() if fails["on"] else 1
        if luck < 0.15:
            raise OSError("before")
        usual(self, path, *args, **kwargs)
        if luck < 0.3:
            raise OSError("after")

    states.begin(spark, out)
    with pytest.raises(FileNotFoundError):
        states.live_states(spark, out)
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    broken = 0
    for number in range(14):
        rows = [(f"k{rng.randrange(4)}", rng.randrange(100)) for _ in range(5)] if number != 6 else []
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        batch = spark.createDataFrame(rows, "k string, n bigint")
        while True:
            try:
                states.begin(spark, out)
                states.add(summed(batch), out, number, summed, fan=3)
                break
            except OSError:
                broken += 1
        states.add(summed(batch), out, number, summed, fan=3)  # handed over once more
    fails["on"] = False
    upto, live = states.committed(spark, out)
    assert broken > 3 and upto == 13 and [level for level, _ in live] == [2, 1, 0, 0]
    got = {r.k: r.n for r in summed(states.live_states(spark, out)).collect()}
    assert got == want


def test_sweep_out_of_counts_equals_the_sweep_of_lines(spark):
    rng = random.Random(9)
    start = 1_700_000_000
    rows = [
        (rng.choice(["a", "b"]), rng.choice(["s", "t"]), rng.choice(["error", "fatal", "info"]), start * 10**6 + rng.choice([rng.randrange(6000), 300 * rng.randrange(20)]) * 10**6 + rng.choice([0, 0, 1, 500_000, 999_999]))
        for _ in range(3000)
    ]
    logs = spark.createDataFrame(rows, "tenant_id string, service string, level string, us bigint").withColumn("timestamp", F.timestamp_micros("us")).drop("us")
    parts = logs.randomSplit([1.0, 1.0, 1.0], 5)
    counts = A.error_counts(parts[0]).unionByName(A.error_counts(parts[1])).unionByName(A.error_counts(parts[2]))
    newest = counts.agg(F.max("newest")).first()[0]
    assert newest == logs.agg(F.max("timestamp")).first()[0]
    for as_of in (start + 5400, start + 5999, start + 100 + 300 * 18):
        at = spark.range(1).select(F.timestamp_seconds(F.lit(as_of))).first()[0].strftime("%Y-%m-%d %H:%M:%S")
        want = sorted(A.anomaly_sweep(logs, at, 300, 12, 0.0).collect())
        got = sorted(A.swept_counts(counts, at, 300, 12, 0.0).collect())
        assert want and [r[:3] for r in got] == [r[:3] for r in want]
        for g, w in zip(got, want, strict=True):  # Spark adds up the deviation in any order
            assert tuple(g[3:]) == pytest.approx(tuple(w[3:]), rel=1e-12)
