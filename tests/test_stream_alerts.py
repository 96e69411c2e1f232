"""Alert cycles in streams: late lines correct what was told, and silence fires by the clock."""

import datetime as dt
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from watchtide.functions.folding import RuleCycles
from watchtide.operators.alerts import AlertRule
from watchtide.session import checkpoint_root
from watchtide.streaming import alerts as SA
from watchtide.streaming.files import read_files


def plain(kind, threshold, window, cycle, counts, first, last):
    """Every cycle one after the other."""
    out, now, fired = {}, False, None
    for at in range(first, last + 1, cycle):
        total = sum(n for c, n in counts.items() if at - window < c <= at)
        fires = total == 0 if kind == "absence" else threshold is not None and total > threshold
        if fires != now:
            now = fires
            fired = at if fires else fired
            out[at] = fires, fired
    return out


@pytest.mark.parametrize("seed", range(40))
def test_any_order_ends_at_the_same_changes(seed):
    rng = random.Random(seed)
    kind, threshold = rng.choice([("absence", None), ("threshold", 2.0), ("threshold", None)])
    cycle, window = 10, rng.choice([10, 30, 35, 5])
    counts = {at * cycle: rng.randint(0, 3) for at in rng.sample(range(1, 200), rng.randint(1, 25))}
    rule, held = RuleCycles(kind, threshold, window, cycle), {}
    parts = list(counts.items())
    rng.shuffle(parts)
    while parts:
        some, parts = parts[:3], parts[3:]
        for at, fires, fired, gone in RuleCycles.add(rule, dict(some)):
            if gone:
                del held[at]
            else:
                held[at] = fires, fired
        rule = RuleCycles(kind, threshold, window, cycle, rule.known())  # as stored and read back
    want = plain(kind, threshold, window, cycle, counts, min(counts), max(counts))
    assert held == want
    # the clock goes on and no line arrives
    for at, fires, fired, _ in rule.add({}, max(counts) + 500):
        held[at] = fires, fired
    assert held == plain(kind, threshold, window, cycle, counts, min(counts), max(counts) + 500)


def test_old_cycles_are_settled():
    whole, short = RuleCycles("threshold", 1.0, 30, 10), RuleCycles("threshold", 1.0, 30, 10)
    rng = random.Random(9)
    for at in range(10, 3000, 10):
        counts = {at: rng.choice([0, 0, 0, 2])}
        assert whole.add(counts) == short.add(counts)
        short.forget(100)
    assert len(short.counts) < 15 < len(whole.counts) and len(short.changes) < 15
    assert short.add({20: 5}) == []  # too late to change anything


def test_a_silent_stream_fires(spark):
    """One batch of lines and then none: the absence rule fires by the clock, also the one whose service never spoke."""
    folder = f"{checkpoint_root(spark)}/test-{uuid.uuid4().hex}"
    now = dt.datetime.now(dt.timezone.utc)
    rules = [
        AlertRule("quiet", "t", kind="absence", service="s0", window_seconds=4), AlertRule("never", "t", kind="absence", service="s9", window_seconds=4),
        AlertRule("many", "t", kind="threshold", threshold=0.0, window_seconds=4),
    ]
    lines = spark.createDataFrame([("t", "s0", now)], "tenant_id string, service string, timestamp timestamp")
    SA.cycle_counts(lines, rules, 2).write.parquet(f"{folder}/counts/batch_id=0")
    counts = read_files(spark, f"{folder}/counts/*", SA.CYCLES_SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = SA.stream_alerts(counts, rules, f"{folder}/out", f"{folder}/checkpoint", 2, trigger="1 second")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        found, until = {}, time.time() + 90
        while time.time() < until and not {("quiet", True), ("never", True), ("many", False)} <= found.keys():
            time.sleep(2)
            assert query.isActive, query.exception()
            try:
                rows = SA.read_changes(spark.read.parquet(f"{folder}/out")).collect()
            except Exception:  # noqa: BLE001 - nothing written yet
                continue
            found = {(r.rule_id, r.firing): r.cycle.replace(tzinfo=None) for r in rows}
    finally:
        query.stop()
    assert {("quiet", True), ("never", True), ("many", True), ("many", False)} <= found.keys()
    assert found["quiet", True] == found["many", False] > found["many", True]


def test_rules_and_lines_may_be_missing(spark):
    none = spark.createDataFrame([], "tenant_id string, service string, timestamp timestamp")
    rules = [AlertRule("r", "t", kind="absence")]
    assert SA.cycle_counts(none, rules).collect() == []
    line = none.unionByName(spark.createDataFrame([("t", None, dt.datetime(2024, 1, 1))], none.schema))
    assert SA.cycle_counts(line, []).collect() == []
    got = SA.cycle_counts(line, rules).groupBy("rule_id").agg(F.sum("n").alias("n")).collect()
    assert [(r.rule_id, r.n) for r in got] == [("r", 1)]
