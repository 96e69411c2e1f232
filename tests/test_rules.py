"""Rules as tables: many rules and tenants against plain evaluation, from lists and from stored tables."""

import datetime as dt
import json
import random
import re
import statistics
import uuid

import pytest

from watchtide.functions.levels import LEVELS, ROUTING_RANKS
from watchtide.operators import alerts as AL
from watchtide.operators import rules as R
from watchtide.session import checkpoint_root

NOW = dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc)
OPS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
ROWS = "id string, tenant_id string, service string, level string, environment string, message string, body string, timestamp timestamp"


def rank(level):
    return LEVELS.index(level) + 1 if level in LEVELS else 0


def holds(row, clause):
    field, op, value = clause
    test = OPS["=" if op == "==" else op]
    if field == "level" and op in ("<", "<=", ">", ">="):
        return test(rank(row["level"]), rank(value))
    if field in ("tenant", "tenant_id"):
        return True
    if field == "time":
        return test(row["timestamp"], dt.datetime.fromisoformat(value).replace(tzinfo=dt.timezone.utc))
    if field.startswith("body."):
        found = json.loads(row["body"])
        for step in field.split(".")[1:]:
            found = found.get(step) if isinstance(found, dict) else None
        left = found if isinstance(found, str) else ""
    else:
        left = row[field]
    if isinstance(value, str):
        return left is not None and test(left, value)
    try:
        return test(float(left), value)
    except (TypeError, ValueError):
        return False


def matches(rule, row):
    return row["tenant_id"] == rule.tenant_id and rule.service in ("", "*", row["service"]) and all(holds(row, c) for c in rule.condition)


def some_rows(rng, tenants, n):
    out = []
    for k in range(n):
        body = json.dumps({"k": str(rng.randint(0, 9)), "a": {"b.c": "x", "b": rng.choice(["x", "y"])}, "n": 3})
        tenant = "t0" if rng.random() < 0.34 else f"t{rng.randrange(tenants)}"
        at = NOW - dt.timedelta(seconds=rng.randint(-50, 4000))
        out.append((str(k), tenant, rng.choice(["s0", "s1", "*", None]), rng.choice([*LEVELS, "odd", None]), rng.choice(["prod", ""]), "m", body, at))
    return out


def some_rules(rng, tenants, n):
    clauses = [("level", ">=", "error"), ("level", "<", "warn"), ("level", "=", "info"), ("environment", "!=", "prod"), ("environment", "==", "prod"), ("body.k", ">", 4), ("body.k", "=", "7"),
               ("body.a.b", "=", "x"), ("body.n", "=", ""), ("time", ">", "2024-01-01 23:30:00"), ("tenant_id", "=", "other"), ("id", "<", 50)]
    return [
        AL.AlertRule(f"r{i}", f"t{rng.randrange(tenants)}", f"rule {i}", rng.choice(["threshold", "absence", "other"]), rng.choice(["", "*", "s0", "s1"]),
                     tuple(rng.sample(clauses, rng.randint(0, 3))), rng.choice([None, 0.0, 1.0, 3.5]), rng.choice([60, 600, 3000]), rng.random() < 0.9)
        for i in range(n)
    ]


def brute(rules, rows):
    names = [c.split()[0] for c in ROWS.split(", ")]
    rows = [dict(zip(names, r, strict=True)) for r in rows]
    by_tenant = {}
    for r in rows:
        by_tenant.setdefault(r["tenant_id"], []).append(r)
    out = {}
    for rule in rules:
        if not rule.enabled:
            continue
        start = NOW - dt.timedelta(seconds=rule.window_seconds)
        n = sum(start < r["timestamp"] <= NOW and matches(rule, r) for r in by_tenant.get(rule.tenant_id, ()))
        fires = n == 0 if rule.kind == "absence" else rule.kind == "threshold" and rule.threshold is not None and n > rule.threshold
        out[rule.tenant_id, rule.id] = (n, fires)
    return out


@pytest.mark.parametrize(("tenants", "n"), [(3, 700), (1000, 10_000)])
def test_many_rules_match_plain_evaluation(spark, tenants, n):
    rng = random.Random(n)
    rows, rules = some_rows(rng, tenants, 1500), some_rules(rng, tenants, n)
    logs = spark.createDataFrame(rows, ROWS)
    got = {(r.tenant_id, r.rule_id): (r["count"], r.firing) for r in AL.evaluate_alert_rules(logs, rules, NOW).collect()}
    assert got == brute(rules, rows)


def test_rules_come_from_a_stored_table(spark):
    rng = random.Random(1)
    rows, rules = some_rows(rng, 3, 600), some_rules(rng, 3, 60)
    path = f"{checkpoint_root(spark)}/rules-{uuid.uuid4().hex}"
    R.rule_table(spark, rules).write.parquet(path)
    logs = spark.createDataFrame(rows, ROWS)
    found = AL.evaluate_alert_rules(logs, spark.read.parquet(path), NOW)
    assert {(r.tenant_id, r.rule_id): (r["count"], r.firing) for r in found.collect()} == brute(rules, rows)


def test_plan_does_not_grow_with_rules(spark):
    rng = random.Random(2)
    logs = spark.createDataFrame(some_rows(rng, 3, 10), ROWS)
    size = lambda n: len(AL.evaluate_alert_rules(logs, R.rule_table(spark, some_rules(rng, 3, n)).repartition(1), NOW)._jdf.queryExecution().optimizedPlan().toString())
    assert size(2000) < 1.5 * size(200)


def test_baselines_match_plain_evaluation(spark):
    rng = random.Random(3)
    rows, rules = some_rows(rng, 2, 3000), some_rules(rng, 2, 80)
    names = [c.split()[0] for c in ROWS.split(", ")]
    want = {}
    for rule in rules:
        if rule.enabled and rule.kind == "threshold":
            buckets, w = {}, rule.window_seconds
            for r in (dict(zip(names, x, strict=True)) for x in rows):
                if NOW - dt.timedelta(seconds=13 * w) < r["timestamp"] <= NOW - dt.timedelta(seconds=w) and matches(rule, r):
                    buckets[int(r["timestamp"].timestamp()) // w] = buckets.get(int(r["timestamp"].timestamp()) // w, 0) + 1
            if len(buckets) >= 4:
                want[rule.tenant_id, rule.id] = (round(statistics.mean(buckets.values()), 9), round(statistics.pstdev(buckets.values()), 9), len(buckets))
    got = AL.rolling_baseline(spark.createDataFrame(rows, ROWS), rules, NOW).collect()
    assert want and {(r.tenant_id, r.rule_id): (round(r["mean"], 9), round(r["std"], 9), r.windows) for r in got} == want


def test_no_rules_and_odd_rules(spark):
    logs = spark.createDataFrame(some_rows(random.Random(4), 2, 20), ROWS)
    assert AL.evaluate_alert_rules(logs, [], NOW).collect() == AL.rolling_baseline(logs, [], NOW).collect() == []
    for clause in [("nowhere", "=", "x"), ("level", "~", "x"), ("other.k", "=", "x")]:
        rule = AL.AlertRule("r", "t0", condition=(clause,))
        with pytest.raises(ValueError):
            AL.evaluate_alert_rules(logs, [rule], NOW)
        row = ("r", "t0", "", "threshold", "*", 1.0, 60, True, [(clause[0], clause[1], clause[2], None)])
        with pytest.raises(ValueError):
            AL.evaluate_alert_rules(logs, spark.createDataFrame([row], R.RULES_SCHEMA), NOW)


# ---- routing -------------------------------------------------------------------------------


def route_holds(event, clause):
    match = re.match(R.CLAUSE_PATTERN, clause, re.S | re.A)
    if not match:
        return False
    name, op, wanted = match[1], match[2], match[3].strip()
    if len(wanted) >= 2 and wanted[0] == wanted[-1] and wanted[0] in "'\"":
        wanted = wanted[1:-1]
    low = name.lower()
    if low == "service":
        value = event["service"] or None
    elif low in ("level", "severity"):
        value = event["severity"] or None
    else:
        for prefix in R.LABEL_PREFIXES:
            if low.startswith(prefix):
                name = name[len(prefix):]
                break
        value = event["labels"].get(name)
    if value is None:
        return False
    value, target = value.lower(), wanted.lower()
    if op in ("=", "=="):
        return value == target
    if op == "!=":
        return value != target
    if op == "=~":
        return target in value
    if low not in ("level", "severity") or value not in ROUTING_RANKS or target not in ROUTING_RANKS:
        return False
    return OPS[op](ROUTING_RANKS[value], ROUTING_RANKS[target])


def test_routes_match_plain_evaluation(spark):
    rng = random.Random(5)
    conditions = ["", "level >= warn", "env = 'PROD' AND severity!=error", "(labels.k =~ Ab)", "label.k == \"abc\"", "not a clause", "missing = 1", "env > a", "service = S0 and level < fatal", "k = 'a and b'", "level >= nothing"]
    routes = [
        AL.RoutingRule(f"r{i}", rng.choice(["", " S0 ", "s1"]), rng.choice(conditions), rng.random() < 0.9, tuple(("mail", f"m{rng.randrange(6)}") for _ in range(rng.randint(0, 2))), rng.choice([None, "t0", "t1", f"t{i}"]))
        for i in range(300)
    ]
    events = [
        (str(k), rng.choice(["t0", "t1", "t2", None]), rng.choice(["s0", "S1 ", "", None]), rng.choice(["warn", "ERROR", "fatal", "", None, "odd"]), rng.choice([{}, {"env": "prod", "k": "abc"}, {"env": "", "k": "xABx"}]))
        for k in range(400)
    ]
    frame = spark.createDataFrame(events, "id string, tenant_id string, service string, severity string, labels map<string,string>")
    got = {r.id: (r.matched_rules, [tuple(c) for c in r.channels]) for r in AL.route_alerts(frame, routes).collect()}
    for k, tenant, service, severity, labels in events:
        event = {"service": service, "severity": severity, "labels": labels}
        hit = []
        for r in routes:
            own = r.tenant_id in (None, tenant) and (not r.service.strip() or (service or "").strip().lower() == r.service.strip().lower())
            parts = [p.strip().strip("()").strip() for p in re.split(r"(?i)\s+and\s+", r.condition.strip())]
            if r.enabled and own and all(route_holds(event, p) for p in parts if p):
                hit.append(r)
        assert got[k] == ([r.id for r in hit], list(dict.fromkeys(c for r in hit for c in r.channels))), (k, event)


def test_no_routes(spark):
    frame = spark.createDataFrame([("1", "t", "s", "warn", {})], "id string, tenant_id string, service string, severity string, labels map<string,string>")
    (row,) = AL.route_alerts(frame, []).collect()
    assert row.matched_rules == [] and row.channels == []
