"""Erasure requests against brute force: many of one tenant, nested, open, empty and repeated ones."""

import datetime as dt
import random

from pyspark.sql import functions as F

from watchtide.operators import governance as G

T0 = dt.datetime(2024, 1, 1)
REQUEST = "request_id string, tenant_id string, user_id string, from_ts timestamp, to_ts timestamp"


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def covers(request, tenant, user, second):
    _, t, u, a, b = request
    return t == tenant and (bool(u) or a is not None or b is not None) and (not u or u == user) and (a is None or second >= a) and (b is None or second <= b)


def run(spark, rows, requests):
    traces = spark.createDataFrame([(t, f'{{"user_id": "{u}"}}', at(s), i) for i, (t, u, s) in enumerate(rows)], "tenant_id string, attributes string, timestamp timestamp, i int")
    asked = spark.createDataFrame([(r, t, u, at(a), at(b)) for r, t, u, a, b in requests], REQUEST)
    kept, receipts = G.erase_subject({"traces": traces}, asked)
    return kept["traces"], receipts


def check(spark, rows, requests):
    kept, receipts = run(spark, rows, requests)
    assert kept.columns == ["tenant_id", "attributes", "timestamp", "i"]
    assert sorted(r.i for r in kept.collect()) == [i for i, row in enumerate(rows) if not any(covers(q, *row) for q in requests)]
    usable = {q for q in requests if q[2] or q[3] is not None or q[4] is not None}
    want = sorted((r, t, sum(covers((r, t, u, a, b), *row) for row in rows)) for r, t, u, a, b in usable)
    assert sorted((r.request_id, r.tenant_id, r.erased) for r in receipts.collect()) == want


def test_requests_of_all_shapes(spark):
    rng = random.Random(5)
    day = 86400
    rows = [("hot" if rng.random() < 0.6 else f"t{rng.randrange(3)}", str(rng.randrange(6)), rng.randrange(20 * day)) for _ in range(1500)]
    requests = [("none", "hot", "", None, None), ("all", "t1", "3", None, None), ("back", "hot", "2", 9 * day, 8 * day), ("blank", "t0", None, 5, 90 * day)]
    for k in range(120):
        tenant, user = rng.choice(["hot", "hot", "t0", "t2", "absent"]), rng.choice(["", "0", "1", "4"])
        start = rng.randrange(20 * day)
        bounds = (start, start + rng.choice([0, 60, 3600, 2 * day]))
        if user and rng.random() < 0.2:
            bounds = rng.choice([(None, start // 9), (20 * day - start // 9, None)])
        requests.append((f"q{k % 60}", f"{tenant}", user, *bounds))  # ids repeat between tenants
    requests = sorted(set(requests), key=str)
    seen, single = set(), []
    for q in requests:  # one receipt each: drop repeated ids of one tenant
        if q[:2] not in seen:
            seen.add(q[:2])
            single.append(q)
    check(spark, rows, single)


def test_bounds_are_inclusive_and_empty_tables_stay_empty(spark):
    check(spark, [("a", "1", s) for s in (9, 10, 15, 20, 21)], [("in", "a", "", 10, 20), ("touch", "a", "1", 20, 21), ("point", "a", "", 9, 9)])
    kept, receipts = run(spark, [("a", "1", 5)], [])
    assert kept.count() == 1 and receipts.count() == 0
    kept, receipts = run(spark, [], [("q", "a", "1", None, None)])
    assert kept.count() == 0 and [r.erased for r in receipts.collect()] == [0]


def test_a_hundred_thousand_requests_of_one_tenant(spark):
    n = 100_000
    minutes = spark.range(n).select(
        F.concat(F.lit("q"), "id").alias("request_id"), F.lit("a").alias("tenant_id"), F.lit("").alias("user_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 30).alias("from_ts"), F.timestamp_seconds(F.lit(1_700_000_009) + F.col("id") * 30).alias("to_ts"),
    )
    rows = spark.range(50_000).select(
        F.lit("a").alias("tenant_id"), F.lit("{}").alias("attributes"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 5).alias("timestamp"),
    )
    kept, receipts = G.erase_subject({"traces": rows}, minutes)
    # of every six rows, 5 s apart, the first two fall into the ten seconds of a request
    assert kept["traces"].count() == 50_000 - 2 * -(-50_000 // 6) + (1 if 50_000 % 6 == 1 else 0)
    done = receipts.agg(F.count("*").alias("n"), F.sum("erased").alias("erased"), F.max("erased").alias("most")).first()
    assert (done.n, done.erased, done.most) == (n, 50_000 - kept["traces"].count(), 2)
