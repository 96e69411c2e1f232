"""Known values of single operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from watchtide.functions import fields as FL
from watchtide.functions import masking as MK
from watchtide.functions import times as TM
from watchtide.operators import alerts as AL
from watchtide.operators import business as B
from watchtide.operators import deploys as D
from watchtide.operators import forecast as FC
from watchtide.operators import governance as G
from watchtide.operators import logs as L
from watchtide.operators import scope as SC
from watchtide.sources import lines as LN
from watchtide.sources import otlp as O
from watchtide.sources import records as R
from watchtide.sources.remap import Call, Path, apply_remap
from watchtide.sources.webhooks import normalize_change_webhooks

AS_OF = "2024-01-31 00:00:00"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    "current, mean, std, low, high",
    [(10, 10, 3, 0, 0), (2, 10, 3, 0, 0), (200, 2, 0, 0.9, 1), (200, 5, 2, 1, 1), (20, 10, 3, 0.0001, 0.9999)],
)
def test_anomaly_score(spark, current, mean, std, low, high):
    score = value(spark, AL.anomaly_score(lit(float(current)), lit(float(mean)), lit(float(std))))
    assert low <= score <= high


def test_health_delta(spark):
    rows = [(1000, 20, 1000, 120), (1000, 50, 1000, 51), (500, 10, 0, 0)]
    df = spark.createDataFrame(rows, "before_total bigint, before_err bigint, after_total bigint, after_err bigint")
    first, second, third = D.health_delta(df).collect()
    assert (first["before_rate"], first["after_rate"], first["delta"], first["degraded"]) == (0.02, 0.12, 0.10, True)
    assert second["degraded"] is False
    assert third["after_rate"] == 0 and third["degraded"] is False


def test_culprit_score(spark):
    def score(kind, age, after, delta):
        return value(spark, D.culprit_score(lit(kind), lit(age), 3600, lit(after), lit(delta)))

    assert score("deploy", 60, 100, 0.2) > score("flag", 60, 100, 0.0)
    assert score("deploy", 60, 0, 0.0) > score("deploy", 3000, 0, 0.0)
    assert score("deploy", 60, 0, 0.0) > score("config", 60, 0, 0.0)


def test_confidence_and_severity(spark):
    def conf(kind, n, threshold, mean=None, std=None):
        args = [] if mean is None else [lit(float(mean)), lit(float(std))]
        return value(spark, AL.confidence(lit(kind), lit(n), lit(float(threshold)), *args))

    assert conf("absence", 0, 0) == 0.7
    assert conf("threshold", 200, 100) == 1.0
    assert conf("threshold", 110, 100) <= 0.2
    assert conf("threshold", 40, 100, 10, 5) == 1.0
    got = [value(spark, AL.severity_bucket(lit(x))) for x in (0.1, 0.4, 0.7, 0.95)]
    assert got == ["low", "medium", "high", "critical"]


def test_calibration(spark):
    rows = []
    expected = {"a": 1.0, "b": 1.0, "c": 0.5, "d": 1.15, "e": 0.825, "*": 1.0}
    counts = {"a": (1, 0), "b": (0, 3), "c": (0, 10), "d": (10, 0), "e": (5, 5), "*": (9, 9)}
    for service, (good, bad) in counts.items():
        rows += [("t", service, "actionable")] * good + [("t", service, "noise")] * bad
    df = spark.createDataFrame(rows, "tenant_id string, service string, verdict string").withColumn("created_at", F.lit("2024-01-30").cast("timestamp"))
    got = {r["service"]: r["factor"] for r in AL.calibration_factors(df, AS_OF).collect()}
    assert got == pytest.approx(expected)


def test_rca_rank(spark):
    rows = [
        ("t", "s", "dependency", "cache", 0.45, None, 10, 1), ("t", "s", "deploy", "deploy v2", 0.88, 60.0, None, None),
        ("t", "s", "dependency", "payments", 0.85, None, 1000, 900),
    ]
    df = spark.createDataFrame(rows, "tenant_id string, service string, type string, subject string, score double, age_seconds double, calls bigint, errors bigint")
    ranked = D.rca_rank(df).orderBy("position").collect()
    assert [r["subject"] for r in ranked] == ["deploy v2", "payments", "cache"]
    assert D.rca_rank(df, gate=0.3).count() == 2
    lowest = ranked[-1]["rank_score"]
    assert D.rca_rank(df, gate=lowest).count() == 3


def series(spark, values):
    rows = [("t", "s", "m", i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "tenant_id string, service string, metric_name string, idx bigint, v double")


def test_trend(spark):
    slope, icept = FC.linear_trend(series(spark, [1, 2, 3, 4, 5])).select("slope", "intercept").first()
    assert (slope, icept) == pytest.approx((1, 1))
    assert FC.linear_trend(series(spark, [3, 3, 3, 3])).first()["slope"] == 0
    one = FC.linear_trend(series(spark, [7])).first()
    assert (one["slope"], one["intercept"]) == (0, 7)
    assert value(spark, FC.project(lit(5), lit(1.0), lit(1.0), 3)) == 8


@pytest.mark.parametrize("current, slope, limit, steps", [(5, 1, 10, 5), (100, -10, 0, 10), (5, 0, 10, None), (5, -1, 10, None), (10, 1, 10, 0)])
def test_time_to_threshold(spark, current, slope, limit, steps):
    assert value(spark, FC.time_to_threshold(lit(float(current)), lit(float(slope)), lit(float(limit)))) == steps


def test_ewma(spark):
    values = F.array(*[lit(float(x)) for x in (1, 2, 3, 4)])
    assert value(spark, FC.ewma_of(values, 1)) == 4
    assert value(spark, FC.ewma_of(values, 5)) == 4
    assert value(spark, FC.ewma_of(F.array().cast("array<double>"))) == 0


def test_seasonal(spark):
    data = series(spark, [10, 20, 30, 10, 20, 30])
    assert FC.seasonal_baseline(data, 3).first()["seasonal_baseline"] == 10
    assert FC.seasonal_baseline(data, 7).count() == 0
    assert FC.seasonal_baseline(data, 0).count() == 0
    assert FC.seasonal_baseline(data.withColumn("reset", F.lit(5)), 3).count() == 0
    assert value(spark, FC.deviation(lit(120.0), lit(100.0))) == pytest.approx(0.2)
    assert value(spark, FC.deviation(lit(50.0), lit(0.0))) == 50


def test_exposure(spark):
    rows = [
        ("t", "api", "a", "enterprise", 10000.0, 99.9), ("t", "api", "b", "enterprise", 5000.0, 99.99), ("t", "web", "c", "pro", 2000.0, 99.9),
        ("u", "x", "d", "free", 1000.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "tenant_id string, service string, customer string, plan_tier string, monthly_revenue double, sla_target double")
    got = {r["tenant_id"]: r for r in B.exposure(df).collect()}
    assert (got["t"]["revenue_high"], got["t"]["revenue_low"], got["t"]["worst_sla_target"]) == (17000, 1.7, 99.99)
    assert got["t"]["affected_plan_tiers"] == ["enterprise", "pro"] and got["t"]["customer_count"] == 3
    assert "strictest-SLA (99.990%)" in got["t"]["basis"]
    assert got["u"]["revenue_low"] == 50 and got["u"]["worst_sla_target"] is None
    incidents = spark.createDataFrame([("t", "web", 4), ("t", "unmapped", 1)], "tenant_id string, service string, signal_count int")
    found = {r["service"]: r for r in B.incident_exposure(incidents, df).collect()}
    assert (found["web"]["revenue_high"], found["web"]["mapping_count"]) == (2000, 1)
    assert (found["unmapped"]["revenue_high"], found["unmapped"]["revenue_low"], found["unmapped"]["mapping_count"]) == (0, 0, 0)


def test_invoice(spark):
    usage = spark.createDataFrame([("a", 12_500_000, 60_500_000_000), ("b", 10_000_000, 50_000_000_000), ("c", 5, 10**9)], "tenant_id string, events bigint, bytes bigint")
    plan = "tenant_id string, plan string, included_events bigint, included_gb double, overage_per_million_events double, overage_per_gb double"
    plans = spark.createDataFrame([(t, "pro", 10_000_000, 50.0, 2.0, 0.5) for t in "ab"], plan)
    got = {r["tenant_id"]: r for r in B.invoice_preview(usage, plans).collect()}
    assert (got["a"]["overage_events_cost"], got["a"]["overage_gb_cost"], got["a"]["total_cost"]) == (5.0, 5.25, 10.25)
    assert got["b"]["total_cost"] == 0
    assert (got["c"]["plan"], got["c"]["total_cost"], got["c"]["overage_events"]) == ("free", 0, 5)


def test_time_to_first_query(spark):
    hour = lambda h: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=h)
    keys = [("a", hour(0)), ("a", hour(10)), ("a", hour(20)), ("b", hour(0)), ("b", hour(10)), ("c", hour(5)), ("d", hour(9))]
    asked = [("a", hour(1)), ("a", hour(12)), ("a", hour(25)), ("b", hour(1)), ("b", hour(12)), ("c", hour(6)), ("d", hour(2))]
    audit = spark.createDataFrame(asked, "tenant_id string, created_at timestamp").withColumn("action", F.lit("query"))
    got = {r["tenant_id"]: r for r in B.time_to_first_query(spark.createDataFrame(keys, "tenant_id string, created_at timestamp"), audit).collect()}
    assert (got["a"]["ttfiq_seconds"], got["a"]["median_ttfiq_seconds"]) == (3600, 7200)
    assert got["b"]["median_ttfiq_seconds"] == 5400
    assert got["c"]["median_ttfiq_seconds"] is None
    assert got["d"]["ttfiq_seconds"] is None


def test_tiers(spark):
    ages = [("logs", "t", f"p{a}", a) for a in (0, 2, 3, 29, 30, 100)] + [("logs", "never", "q", 500)]
    df = spark.createDataFrame(ages, "table string, tenant_id string, partition string, age_days int")
    tiers = spark.createDataFrame([("never", 3, 0)], "tenant_id string, hot_days int, cold_days int")
    got = G.classify_tiers(df, tiers)
    assert {r["age_days"]: r["tier"] for r in got.collect()} == {0: "hot", 2: "hot", 3: "cold", 29: "cold", 30: "expired", 100: "expired", 500: "cold"}
    moves = G.move_plan(got.withColumn("volume", F.when(F.col("age_days") == 29, "cold").otherwise("hot"))).collect()
    assert [(m["tenant_id"], m["partition"]) for m in moves] == [("t", "p3"), ("never", "q")]


def masked(spark, text, actions=None):
    return value(spark, MK.mask_pii(lit(text), actions))


def test_mask_pii(spark):
    assert masked(spark, "mail alice@example.com now")["text"] == "mail [redacted:email] now"
    assert masked(spark, "pay 4242424242424242.")["text"] == "pay [redacted:card]."
    # the pattern takes a separator along when a word follows
    assert masked(spark, "pay 4242 4242 4242 4242 ok")["text"] == "pay [redacted:card]ok"
    assert masked(spark, "id 1234567890123 ok")["text"] == "id 1234567890123 ok"
    hashed = masked(spark, "alice@example.com", {"email": "hash"})["text"]
    assert hashed.startswith("email:") and len(hashed) == len("email:") + 12
    dropped = masked(spark, "call +91 9876543210", {"phone": "drop_record"})
    assert dropped["drop_record"] and dropped["text"] == "call " and dropped["types"] == ["phone"]
    both = masked(spark, "10.0.0.1 and 2001:db8:0:0:0:0:0:1 and eyJa.b.c")
    assert both["types"] == ["ipv4", "ipv6", "jwt"]


def test_mask_json(spark):
    text = '{"a@b.io":"x\\n c@d.io","n":1,"l":["e@f.io",{"k":"ok"}]}'
    got = value(spark, MK.mask_pii_json(lit(text)))
    assert got["text"] == '{"a@b.io":"x\\n [redacted:email]","n":1,"l":["[redacted:email]",{"k":"ok"}]}'
    assert got["types"] == ["email"]


def test_mask_basic(spark):
    got = value(spark, MK.mask_text_basic(lit("bearer abc.def user@x.io 10.1.1.1 12345678 port 8080")))
    assert got == "Bearer [REDACTED] [EMAIL] [IP] [NUM] port 8080"


def test_tokens(spark):
    assert MK.phrase_tokens("payment failed!") == ["payment", "failed"]
    hit = lambda text, phrase: value(spark, MK.has_all_tokens(lit(text), phrase))
    assert hit("Payment has FAILED.", "payment failed")
    assert not hit("payments failed", "payment failed")
    assert not hit("caféteria", "caf")
    assert hit("anything", "--")


def test_gelf_and_syslog(spark):
    rows = spark.createDataFrame([('{"host":"h","short_message":"s","level":3,"_route":"r","_id":"x"}',), ("nope",), ("",)], "value string")
    got = LN.parse_gelf(rows).collect()
    assert len(got) == 1 and got[0]["level"] == "error" and got[0]["extra"] == {"route": '"r"'}
    lines = ["<34>1 2003-10-11T22:14:15.003Z mymachine.example.com su - ID47 - 'su root' failed", "plain text", "<13>1 - - - - - [a [b] c][d] hi"]
    first, second, third = LN.parse_syslog(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert (first["service"], first["level"], first["message"]) == ("su", "fatal", "'su root' failed")
    assert (second["level"], second["message"], second["service"]) == ("info", "plain text", None)
    assert third["message"] == "hi" and third["timestamp"] is None


def test_remote_write(spark):
    labels = [("__name__", "up"), ("job", "payments"), ("env", "prod"), ("code", "200")]
    df = spark.createDataFrame([(labels, [(1700000000000, 42.0)]), ([("job", "x")], [(1, 1.0)])], "labels array<struct<name:string,value:string>>, samples array<struct<timestamp:bigint,value:double>>")
    (row,) = O.map_remote_write_series(df).collect()
    assert (row["service"], row["environment"], row["attributes"], row["metric_type"], row["value"]) == ("payments", "prod", {"code": "200"}, "gauge", 42.0)


def remap(spark, event, steps):
    return apply_remap(spark.createDataFrame([(event,)], "payload string"), steps).first()


def test_remap(spark):
    steps = [
        {"set": "level", "to": Call("upcase", Path("level"))}, {"del": "password"}, {"redact": "token"}, {"rename": "msg", "to": "message"},
        {"set": "code", "to": Call("to_int", Path("code"))}, {"set": "user", "to": Call("coalesce", Path("none"), Path("id"))},
    ]
    row = remap(spark, '{"level":"warn","password":"p","token":"t","msg":"hi","code":"42.9","id":"u1"}', steps)
    assert row["payload"] == '{"code":42,"id":"u1","level":"WARN","message":"hi","token":"[REDACTED]","user":"u1"}'
    assert row["remap_applied"] == 6 and row["remap_errors"] == []
    row = remap(spark, '{"a":"x"}', [{"set": "n", "to": Call("to_int", Path("a"))}, {"set": "ok", "to": True}])
    assert row["payload"] == '{"a":"x","ok":true}' and row["remap_errors"] == ["to_int: not a number"]
    row = remap(spark, '{"k":5}', [{"if": (">", "k", 3), "then": {"route": "metrics"}}, {"if": ("exists", "zz"), "then": {"del": "k"}}])
    assert row["route_to"] == "metrics" and row["payload"] == '{"k":5}'
    assert remap(spark, "[1]", [{"set": "a.b", "to": 1}])["payload"] == '{"a":{"b":1}}'
    with pytest.raises(ValueError):
        apply_remap(spark.createDataFrame([("{}",)], "payload string"), [{"del": "x"}] * 201)


def test_webhooks(spark):
    rows = [
        ("github", "deployment", '{"repository":{"name":"api"},"deployment":{"id":42,"sha":"abc","ref":"refs/heads/main","environment":"prod","creator":{"login":"alice"}}}'),
        ("github", "workflow_run", '{"workflow_run":{"id":1,"conclusion":"failure"}}'), ("github", "push", '{"after":"cafe","ref":"refs/heads/x"}'),
        ("launchdarkly", "", '{"name":"new-ui","titleVerb":"on","member":{"email":"a@b.c"}}'), ("svn", "", "{}"),
    ]
    got = normalize_change_webhooks(spark.createDataFrame(rows, "provider string, event_type string, payload string")).collect()
    assert len(got) == 4
    assert (got[0]["deploy_id"], got[0]["author"], got[0]["title"]) == ("42", "alice", "Deployment of main to prod")
    assert got[1]["git_sha"] == "cafe"
    assert (got[2]["kind"], got[2]["flag_key"], got[2]["author"]) == ("flag", "new-ui", "a@b.c")
    assert got[3]["error"]


def test_build_log_record(spark):
    good, _ = LN.read_ndjson_logs(spark.createDataFrame([('{"message":"to bob@x.io","level":"ERR","commit":"c1","x":{"m":"q@w.io"},"user_id":"u"}', "t")], "value string, tenant_id string"))
    row = R.build_log_records(good, R.IngestConfig(as_of=AS_OF)).first()
    assert (row["message"], row["level"], row["git_sha"], row["service"]) == ("to [redacted:email]", "error", "c1", "unknown")
    assert row["body"] == '{"x":{"m":"[redacted:email]"}}' and row["pii_detected"] == ["email"]
    assert row["_retention_days"] == 7 and len(row["user_linkage_key"]) == 64 and row["timestamp"] == dt.datetime(2024, 1, 31)
    dropped = R.build_log_records(good, R.IngestConfig(as_of=AS_OF, masking_actions={"email": "drop_record"})).first()
    assert dropped["drop_record"]


def test_timestamps(spark):
    ns = lambda text: value(spark, TM.normalize_timestamp_ns(lit(text), AS_OF))
    assert ns("1700000000") == 1700000000 * 10**9
    assert ns("1700000000123456789") == 1700000000123456789
    assert ns("2024-01-01T00:00:00.123456789Z") == 1704067200123456789
    assert ns("2024-01-01T05:30:00+05:30") == 1704067200 * 10**9
    assert ns("2024-01-01 00:00:00.5") == 1704067200500000000
    for rubbish in ("", "soon", "2024-01-01", "99999999999999999999"):
        assert ns(rubbish) == 1706659200 * 10**9


def test_selector_rules(spark):
    logs = spark.createDataFrame([], "id string, tenant_id string, timestamp timestamp, service string, level string, environment string, trace_id string, span_id string, message string")
    with pytest.raises(ValueError):
        L.stream_selector(logs, "t", [("service", "=~", "a.*")], AS_OF)
    with pytest.raises(ValueError):
        L.stream_selector(logs, "t", [("pod", "=", "a")], AS_OF)
    with pytest.raises(ValueError):
        L.stream_selector(logs, "t", [], AS_OF, 10, 5)
    assert L.ns_window(1, 10**9 + 1, 3 * 10**9) == (3, 1)


def test_live_tail(spark):
    rec = spark.createDataFrame([("payments", "error", '{"region":"eu","n":5}')], "service string, level string, body string")
    hit = lambda *p: rec.filter(L.tail_predicate(*p)).count() == 1
    assert hit("service", "=", "payments") and not hit("service", "=", "web")
    assert hit("level", ">=", "WARN") and not hit("level", ">=", "fatal")
    assert not hit("body.region", "=", "us") and hit("body.n", ">", 4) and hit("body.n", "=", "5")
    assert hit("tenant", "=", "anything") and not hit("body.absent", "!=", "x")


def test_routing(spark):
    event = spark.createDataFrame([("t", "API", "error", {"env": "prod"})], "tenant_id string, service string, severity string, labels map<string,string>")

    def matches(**rule):
        return bool(AL.route_alerts(event, [AL.RoutingRule("r", **rule)]).first()["matched_rules"])

    assert matches(service="api") and not matches(service="web") and not matches(enabled=False)
    assert matches(condition="severity >= warn AND labels.env = 'PROD'") and not matches(condition="severity > error")
    assert not matches(condition="what is this") and not matches(condition="zone = a") and matches(condition="env =~ ro")


def test_tenant_isolation(spark):
    rows = [("1", "a", "svc", "error"), ("2", "b", "svc", "error"), ("3", "b", "svc", "info")]
    df = spark.createDataFrame(rows, "id string, tenant_id string, service string, level string")
    escape = SC.any_of(SC.pred("logs", "tenant_id", "=", "b"), SC.pred("logs", "level", "=", "error"))
    assert [r["id"] for r in SC.tenant_scope(df, "a").filter(escape).collect()] == ["1"]
    got = SC.select_aggregate(df, "logs", "a", [("count", "*")], ["service"], escape).collect()
    assert [r["count"] for r in got] == [1]
    for bad in ("nope", "body.x.y.z"[:4] + "q.x"):
        with pytest.raises(ValueError):
            SC.resolve_field("logs", bad)
    with pytest.raises(ValueError):
        SC.select_aggregate(df, "logs", "a", [("sum", "*")])


def test_series_key(spark):
    assert value(spark, FL.series_key(F.create_map(lit("b"), lit("2"), lit("a"), lit("1"), lit("c"), lit("")))) == "a=1;b=2;"


def test_limits():
    from watchtide.functions.basics import bounded_limit

    assert bounded_limit(1000, 100, 1000) == 1000 and bounded_limit(None, 100, 1000) == 100
    assert bounded_limit(None) is None and bounded_limit(999999) == 999999
    for refused in (0, -1, 1001):
        with pytest.raises(ValueError):
            bounded_limit(refused, 100, 1000)


def test_rate_windows(spark):
    stamps = [0] + [60] * 1001 + [59]
    df = spark.createDataFrame([("t", s) for s in stamps], "tenant_id string, s bigint").withColumn("timestamp", F.timestamp_seconds("s"))
    got = {r["window_start"]: r for r in G.ingest_rate_windows(df).collect()}
    assert (got[0]["requests"], got[0]["exceeded"], got[0]["remaining"]) == (2, False, 998)
    assert (got[60]["requests"], got[60]["exceeded"], got[60]["remaining"], got[60]["reset_at"]) == (1001, True, 0, 120)


def test_locale(spark):
    pick = lambda pref, default: value(spark, FL.resolve_locale(lit(pref), lit(default)))
    assert pick("hi-IN", "ta") == "hi" and pick("fr", "TA_in") == "ta" and pick("", "") == "en"


def test_rounding(spark):
    from watchtide.functions.basics import round_n

    assert value(spark, round_n(lit(1.005), 2)) == 1.0
    assert value(spark, round_n(lit(-2.5), 0)) == -3
    assert math.isclose(value(spark, round_n(lit(0.12345), 4)), 0.1235)
