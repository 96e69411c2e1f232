"""Neighbour merging against a plain replay of signals and resolves."""

import datetime as dt
import random

import pytest

from watchtide.operators.incidents import correlate_incidents
from watchtide.streaming import states
from watchtide.streaming.files import read_files
from watchtide.streaming.incidents import read_incidents, stream_correlation

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def replay(signals, resolves, near):
    """Every signal in order: join the first-opened open neighbour, else the service's own incident."""
    facts = sorted([(t, 0, s, i) for i, (s, t) in enumerate(signals)] + [(t, 1, s, -1) for s, t in resolves])
    opened, members = {}, {}
    for at, kind, service, index in facts:
        if kind == 1:
            opened.pop(service, None)
            continue
        hosts = [(opened[n], n) for n in near.get(service, ()) if n in opened]
        host = min(hosts)[1] if hosts else service
        opened.setdefault(host, at)
        members.setdefault((host, opened[host]), []).append(index)
    return sorted((host, len(found)) for (host, _), found in members.items())


@pytest.mark.parametrize("seed", range(3))
def test_merge(spark, seed):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(7)]
    links = {tuple(rng.sample(names, 2)) for _ in range(5)}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    ticks = rng.sample(range(10_000), 260)
    signals = [("s1" if rng.random() < 0.34 else rng.choice(names), t) for t in ticks[:200]]
    resolves = [(rng.choice(names), t) for t in ticks[200:]]
    at = lambda t: START + dt.timedelta(seconds=t)
    sdf = spark.createDataFrame(
        [("t", s, f"r{i % 3}", "rule", 0.5, "", at(t)) for i, (s, t) in enumerate(signals)],
        "tenant_id string, service string, rule_id string, rule_name string, confidence double, deploy_id string, timestamp timestamp",
    )
    rdf = spark.createDataFrame([("t", s, at(t)) for s, t in resolves], "tenant_id string, service string, timestamp timestamp")
    edf = spark.createDataFrame([("t", a, b) for a, b in links], "tenant_id string, caller string, callee string")
    got = sorted((r["service"], r["signal_count"]) for r in correlate_incidents(sdf, rdf, edf).collect())
    assert got == replay(signals, resolves, near)


def test_the_query_merges_over_all_edges(spark):
    from watchtide.catalog import QUERIES
    from watchtide.catalog.tracing import links_of
    from watchtide.sources import adapters

    sf = "/root/testdata/sf0.001"
    near = {}
    for r in links_of(spark, sf).collect():
        near.setdefault((r.tenant_id, r.caller), set()).add(r.callee)
        near.setdefault((r.tenant_id, r.callee), set()).add(r.caller)
    signals = [(r.tenant_id, r.service, r.timestamp) for r in adapters.signals(spark, sf).collect()]
    resolves = [(r.tenant_id, r.service, r.timestamp) for r in adapters.resolves(spark, sf).collect()]
    want = []
    for tenant in {t for t, _, _ in signals}:
        own = {s: found for (t, s), found in near.items() if t == tenant}
        found = replay([(s, at) for t, s, at in signals if t == tenant], [(s, at) for t, s, at in resolves if t == tenant], own)
        want += [(tenant, *x) for x in found]
    got = sorted((r.tenant_id, r.service, r.signal_count) for r in QUERIES["merge_neighbor_incidents"](spark, sf).collect())
    assert got == sorted(want)


@pytest.mark.parametrize("merging", [False, True])
def test_a_stream_in_any_order_ends_with_the_incidents_of_the_table(spark, tmp_path, merging):
    rng = random.Random(6)
    names = [f"s{i}" for i in range(5)]
    links = [("s0", "s1"), ("s1", "s2"), ("s3", "s4")]
    near = {}
    for a, b in links if merging else []:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    ticks = rng.sample(range(10_000), 130)
    signals, resolves = [(rng.choice(names), t) for t in ticks[:100]], [(rng.choice(names), t) for t in ticks[100:]]
    at = lambda t: START + dt.timedelta(seconds=t)
    rows = [("t", s, at(t), "r", "rule", 0.5, "", True) for s, t in signals] + [("t", s, at(t), None, None, None, None, False) for s, t in resolves]
    rows += [(None, "s1", at(3), "r", "rule", 0.5, "", True), ("t", None, at(3), "r", "rule", 0.5, "", True)]
    rng.shuffle(rows)
    schema = "tenant_id string, service string, timestamp timestamp, rule_id string, rule_name string, confidence double, deploy_id string, signal boolean"
    given, out, edges = str(tmp_path / "in"), str(tmp_path / "out"), spark.createDataFrame([("t", a, b) for a, b in links], "tenant_id string, caller string, callee string")
    edges = edges if merging else None
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(given)
    stream = read_files(spark, given, schema, 1)
    signal, close = stream.filter("signal").drop("signal"), stream.filter("not signal").select("tenant_id", "service", "timestamp")
    stream_correlation(signal, close, out, str(tmp_path / "checkpoint"), edges, available_now=True).awaitTermination()
    assert states.committed(spark, f"{out}/incidents")[0] == 2
    assert sorted((r["service"], r["signal_count"]) for r in read_incidents(spark, out, edges).collect()) == replay(signals, resolves, near)
