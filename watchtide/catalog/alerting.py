"""Alert, incident and routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as AL
from ..operators import incidents as IN
from ..sources import adapters as A
from .base import DAY, NOW, TENANT, r6, register
from .tracing import links_of

AS_OF = A.AS_OF

# (id, tenant, kind, service, condition, threshold, window)
RULES = [
    AL.AlertRule("r1", "ten_0", "errors anywhere", "threshold", "", (("level", ">=", "error"),), 20.0, DAY),
    AL.AlertRule("r2", "ten_1", "svc_1 errors", "threshold", "svc_1", (("level", "=", "error"),), 2.0, DAY),
    AL.AlertRule("r3", "ten_1", "prod warnings", "threshold", "", (("level", "=", "warn"), ("environment", "=", "prod")), 500.0, DAY),
    AL.AlertRule("r4", "ten_2", "no logs", "absence", "svc_9", (), None, DAY),
    AL.AlertRule("r5", "ten_2", "fatal silence", "absence", "", (("level", "=", "fatal"),), None, DAY),
    AL.AlertRule("r6", "ten_2", "all of svc_3", "threshold", "svc_3", (), 10.0, DAY // 2),
    AL.AlertRule("r7", "ten_0", "off", "threshold", "", (), 0.0, DAY, enabled=False),
    AL.AlertRule("r8", "ten_1", "svc_1 errors again", "threshold", "svc_1", (("level", "=", "error"),), 200.0, DAY),
]
_RULE_SQL = "rules(rule_id, tenant_id, kind, service, threshold, w, cond) AS (VALUES " + ", ".join(
    f"('{r.id}', '{r.tenant_id}', '{r.kind}', '{r.service or '*'}', {'NULL' if r.threshold is None else r.threshold}::DOUBLE, {r.window_seconds}, {i})"
    for i, r in enumerate(RULES) if r.enabled
) + ")"
_TESTS = {0: "level IN ('error', 'fatal')", 1: "level = 'error'", 2: "level = 'warn' AND environment = 'prod'", 3: "true",
          4: "level = 'fatal'", 5: "true", 7: "level = 'error'"}
_COND = "CASE r.cond " + " ".join(f"WHEN {i} THEN {t}" for i, t in _TESTS.items()) + " END"
_MATCH = f"l.tenant_id = r.tenant_id AND (r.service = '*' OR l.service = r.service) AND ({_COND})"
_EVALS = f"""{_RULE_SQL}, ev AS (SELECT r.rule_id, r.tenant_id, r.kind, r.service, r.threshold, count(l.id) AS count FROM rules r
    LEFT JOIN {{logs}} l ON {_MATCH} AND l."timestamp" > {NOW} - to_seconds(r.w) AND l."timestamp" <= {NOW} GROUP BY ALL)"""
_BASE = f"""bk AS (SELECT r.rule_id, r.tenant_id, epoch_us(l."timestamp") // 1000000 // r.w AS b, count(*) AS n FROM rules r JOIN {{logs}} l
      ON {_MATCH} AND l."timestamp" > {NOW} - to_seconds(r.w * 13) AND l."timestamp" <= {NOW} - to_seconds(r.w) WHERE r.kind = 'threshold' GROUP BY ALL),
    base AS (SELECT rule_id, tenant_id, avg(n) AS mean, stddev_pop(n) AS std, count(*) AS windows FROM bk GROUP BY ALL HAVING count(*) >= 4)"""
_FIRES = "CASE kind WHEN 'threshold' THEN coalesce(count > threshold, false) WHEN 'absence' THEN count = 0 ELSE false END"


@register("evaluate_alert_rules", f"WITH {_EVALS} SELECT rule_id, tenant_id, count, {_FIRES} AS firing FROM ev")
def evaluate(spark, sf):
    return AL.evaluate_alert_rules(A.logs(spark, sf), RULES, AS_OF).select("rule_id", "tenant_id", "count", "firing")


@register(
    "rolling_baseline",
    f"WITH {_RULE_SQL}, {_BASE} SELECT rule_id, tenant_id, {r6('mean')} AS mean, {r6('std')} AS std, windows FROM base",
)
def baseline(spark, sf):
    return AL.rolling_baseline(A.logs(spark, sf), RULES, AS_OF)


_CONF = """CASE kind WHEN 'absence' THEN 0.7 WHEN 'threshold' THEN CASE WHEN std > 0 THEN least(greatest((count - mean) / std / 6.0, 0), 1)
    WHEN threshold > 0 THEN least(greatest((count - threshold) / threshold, 0), 1) ELSE 0.5 END ELSE 0.5 END"""


@register(
    "adaptive_firing",
    f"""WITH {_EVALS}, {_BASE}, j AS (SELECT ev.*, mean, std, {_FIRES} AS st FROM ev LEFT JOIN base USING (rule_id, tenant_id)),
        k AS (SELECT *, coalesce(std > 0 AND count > mean + 3 * std, false) AS ad, {_CONF} AS conf FROM j)
        SELECT rule_id, tenant_id, st AS static_firing, ad AS adaptive_firing, st OR ad AS firing, {r6('conf')} AS confidence,
          CASE WHEN conf >= 0.85 THEN 'critical' WHEN conf >= 0.6 THEN 'high' WHEN conf >= 0.3 THEN 'medium' ELSE 'low' END AS severity FROM k""",
)
def adaptive(spark, sf):
    """Static and adaptive firing with confidence and severity."""
    logs = A.logs(spark, sf)
    fired = AL.adaptive_firing(AL.evaluate_alert_rules(logs, RULES, AS_OF), AL.rolling_baseline(logs, RULES, AS_OF))
    score = AL.confidence(F.col("kind"), F.col("count"), F.col("threshold"), F.col("mean"), F.col("std"))
    scored = fired.withColumn("confidence", score)
    return scored.select(
        "rule_id", "tenant_id", "static_firing", "adaptive_firing", "firing", "confidence", AL.severity_bucket(F.col("confidence")).alias("severity")
    )


@register(
    "anomaly_sweep",
    f"""WITH e AS (SELECT tenant_id, service, "timestamp" > {NOW} - INTERVAL 1 DAY AS now, epoch_us("timestamp") // 1000000 // {DAY} AS b, count(*) AS n
          FROM {{logs}} WHERE level IN ('error', 'fatal') AND "timestamp" > {NOW} - INTERVAL 13 DAY AND "timestamp" <= {NOW} GROUP BY ALL),
        s AS (SELECT tenant_id, service, sum(n) FILTER (now) AS cur, avg(n) FILTER (NOT now) AS mean, stddev_pop(n) FILTER (NOT now) AS std,
          count(*) FILTER (NOT now) AS windows FROM e GROUP BY ALL),
        z AS (SELECT *, least(greatest((cur - mean) / greatest(std, sqrt(greatest(mean, 1))) / 6.0, 0), 1) AS score FROM s WHERE cur IS NOT NULL AND windows >= 4)
        SELECT tenant_id, service, {r6('cur')} AS current, {r6('mean')} AS mean, {r6('std')} AS std, {r6('score')} AS score FROM z WHERE score >= 0.1""",
)
def anomalies(spark, sf):
    """Daily windows and a low bar, so that the even test data has outliers to show."""
    return AL.anomaly_sweep(A.logs(spark, sf), AS_OF, DAY, 12, 0.1)


@register(
    "alert_transitions",
    """WITH ev AS (SELECT tenant_id, service AS rule_id, epoch_us("timestamp") // 3600000000 * 3600000000 AS cycle,
          count(*) FILTER (level = 'error') > 0 AS firing FROM {logs} GROUP BY ALL),
       w AS (SELECT *, coalesce(lag(firing) OVER (PARTITION BY tenant_id, rule_id ORDER BY cycle), false) AS was FROM ev),
       t AS (SELECT * FROM w WHERE firing <> was)
       SELECT tenant_id, rule_id, cycle, firing, CASE WHEN firing THEN cycle ELSE lag(cycle) OVER (PARTITION BY tenant_id, rule_id ORDER BY cycle) END AS fired_at,
         CASE WHEN NOT firing THEN cycle END AS resolved_at FROM t""",
)
def transitions(spark, sf):
    """Hourly cycles of one rule per service: any error fires."""
    hour = F.date_trunc("hour", "timestamp").alias("cycle")
    evals = A.logs(spark, sf).groupBy("tenant_id", F.col("service").alias("rule_id"), hour).agg(
        (F.count_if(F.col("level") == "error") > 0).alias("firing")
    )
    return AL.alert_transitions(evals)


def feedback_of(spark, sf):
    signals = A.signals(spark, sf)
    verdict = F.when(F.col("id").cast("bigint") % 3 == 0, "noise").otherwise("actionable")
    return signals.select("tenant_id", "service", F.col("timestamp").alias("created_at"), verdict.alias("verdict"))


@register(
    "calibration_factors",
    f"""SELECT tenant_id, service, count(*) FILTER (v = 'actionable') AS actionable, count(*) FILTER (v = 'noise') AS noise,
        {r6("CASE WHEN count(*) >= 5 THEN 0.5 + 0.65 * count(*) FILTER (v = 'actionable') / count(*) ELSE 1.0 END")} AS factor
        FROM (SELECT *, CASE WHEN cast(id AS bigint) % 3 = 0 THEN 'noise' ELSE 'actionable' END AS v FROM {{signals}})
        WHERE "timestamp" > {NOW} - INTERVAL 90 DAY AND "timestamp" <= {NOW} GROUP BY tenant_id, service""",
)
def calibration(spark, sf):
    return AL.calibration_factors(feedback_of(spark, sf), AS_OF)


@register(
    "calibrate",
    f"""WITH f AS (SELECT tenant_id, service, 0.5 + 0.65 * count(*) FILTER (cast(id AS bigint) % 3 <> 0) / count(*) AS factor, count(*) AS n
          FROM {{signals}} GROUP BY ALL)
        SELECT s.id, {r6("least(greatest(confidence * CASE WHEN n >= 5 THEN factor ELSE 1.0 END, 0), 1)")} AS confidence FROM {{signals}} s JOIN f USING (tenant_id, service)""",
)
def calibrated(spark, sf):
    scaled = AL.calibrate(A.signals(spark, sf), AL.calibration_factors(feedback_of(spark, sf), AS_OF))
    return scaled.select("id", "confidence")


_ISLANDS = """c AS (SELECT s.*, (SELECT max(r."timestamp") FROM {resolves} r WHERE r.tenant_id = s.tenant_id AND r.service = s.service
      AND r."timestamp" < s."timestamp") AS island FROM {signals} s)"""


def _incident_sql(islands: str) -> str:
    """Incidents out of signals ``c`` with the service and the ``island`` they belong to."""
    return f"""WITH {islands}, f AS (SELECT tenant_id, service, island, count(*) AS signal_count, max(confidence) AS confidence, min("timestamp") AS first_seen,
          max("timestamp") AS last_seen, coalesce(arg_min(deploy_id, ("timestamp", deploy_id)) FILTER (deploy_id <> ''), '') AS deploy_id,
          min("timestamp") FILTER (confidence >= 0.6) AS paged_at FROM c GROUP BY ALL),
        r AS (SELECT tenant_id, service, island, string_agg(rule_id, ',' ORDER BY fired, rule_id) AS correlated_rules FROM
          (SELECT tenant_id, service, island, rule_id, min("timestamp") AS fired FROM c GROUP BY ALL) GROUP BY ALL),
        e AS (SELECT f.*, (SELECT min(r."timestamp") FROM {{resolves}} r WHERE r.tenant_id = f.tenant_id AND r.service = f.service AND r."timestamp" >= f.last_seen) AS resolved FROM f)
        SELECT e.tenant_id, sha1(concat(e.tenant_id, '|', e.service)) AS fingerprint, e.service, concat(e.service, ' degraded') AS title,
          CASE WHEN confidence >= 0.85 THEN 'critical' WHEN confidence >= 0.6 THEN 'high' WHEN confidence >= 0.3 THEN 'medium' ELSE 'low' END AS severity,
          {r6('confidence')} AS confidence, signal_count, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen, deploy_id,
          correlated_rules, paged_at IS NOT NULL AS paged, epoch_us(paged_at) AS paged_at,
          CASE WHEN resolved IS NULL THEN 'open' ELSE 'resolved' END AS status, epoch_us(resolved) AS resolved_at
        FROM e JOIN r ON e.tenant_id = r.tenant_id AND e.service = r.service AND e.island IS NOT DISTINCT FROM r.island"""


@register("correlate_incidents", _incident_sql(_ISLANDS))
def incidents(spark, sf):
    return IN.correlate_incidents(A.signals(spark, sf), A.resolves(spark, sf))


# signals and resolves one after the other; ``held`` are the open services with the time they opened
_MERGED = """RECURSIVE links AS (SELECT tenant_id, service, list(DISTINCT neighbor) AS near FROM
      (SELECT tenant_id, caller AS service, callee AS neighbor FROM {calls} UNION ALL SELECT tenant_id, callee, caller FROM {calls}) GROUP BY ALL),
    facts AS (SELECT tenant_id, service, "timestamp", id, rule_id, confidence, deploy_id, 0 AS kind FROM {signals}
      UNION ALL SELECT tenant_id, service, "timestamp", '', '', 0.0::DOUBLE, '', 1 FROM {resolves}),
    steps AS (SELECT f.*, coalesce(near, []) AS near, row_number() OVER (PARTITION BY f.tenant_id ORDER BY "timestamp", kind, f.service, id) AS k
      FROM facts f LEFT JOIN links l ON l.tenant_id = f.tenant_id AND l.service = f.service),
    walk AS (
      SELECT DISTINCT tenant_id, 0::BIGINT AS k, ''::VARCHAR AS host, 0::BIGINT AS opened, []::STRUCT(since BIGINT, svc VARCHAR)[] AS held FROM facts
      UNION ALL
      SELECT tenant_id, k, h.svc, h.since, CASE WHEN kind = 1 THEN list_filter(held, lambda x: x.svc <> service)
          WHEN list_contains(list_transform(held, lambda x: x.svc), h.svc) THEN held ELSE list_append(held, h) END
      FROM (SELECT s.tenant_id, s.k, s.kind, s.service, w.held,
            coalesce(list_sort(list_filter(w.held, lambda x: list_contains(s.near, x.svc)))[1], list_filter(w.held, lambda x: x.svc = s.service)[1], {'since': epoch_us(s."timestamp"), 'svc': s.service}) AS h
            FROM walk w JOIN steps s ON s.tenant_id = w.tenant_id AND s.k = w.k + 1)),
    c AS (SELECT s.tenant_id, w.host AS service, w.opened AS island, s.rule_id, s.confidence, s.deploy_id, s."timestamp"
      FROM walk w JOIN steps s ON s.tenant_id = w.tenant_id AND s.k = w.k WHERE s.kind = 0)"""


@register("merge_neighbor_incidents", _incident_sql(_MERGED))
def merged(spark, sf):
    return IN.correlate_incidents(A.signals(spark, sf), A.resolves(spark, sf), links_of(spark, sf))


@register(
    "list_incidents",
    f"""WITH {_ISLANDS}, f AS (SELECT tenant_id, service, island, count(*) AS signal_count, max("timestamp") AS last_seen FROM c GROUP BY ALL),
        e AS (SELECT f.*, (SELECT min(r."timestamp") FROM {{resolves}} r WHERE r.tenant_id = f.tenant_id AND r.service = f.service AND r."timestamp" >= f.last_seen) AS resolved FROM f)
        SELECT service, signal_count, epoch_us(last_seen) AS last_seen FROM e WHERE tenant_id = '{TENANT}' AND resolved IS NOT NULL""",
)
def incident_list(spark, sf):
    from ..operators.logs import list_incidents

    found = IN.correlate_incidents(A.signals(spark, sf), A.resolves(spark, sf))
    return list_incidents(found, TENANT, "resolved").select("service", "signal_count", "last_seen")


@register(
    "overlays",
    f"""WITH {_ISLANDS}, f AS (SELECT tenant_id, service, island, min("timestamp") AS a, max("timestamp") AS b FROM c GROUP BY ALL)
        SELECT marker_type, service, title, a AS start, b AS end FROM (
          SELECT * FROM (SELECT 'deploy' AS marker_type, service, title, epoch_us("timestamp") AS a, epoch_us("timestamp") AS b FROM {{changes}}
            WHERE tenant_id = '{TENANT}' AND "timestamp" > {NOW} - INTERVAL 5 DAY)
          UNION ALL SELECT * FROM (SELECT 'incident', service, concat(service, ' degraded'), epoch_us(a), epoch_us(b) FROM f
            WHERE tenant_id = '{TENANT}' AND b > {NOW} - INTERVAL 5 DAY))""",
)
def overlays(spark, sf):
    from ..operators.logs import overlays as markers

    found = IN.correlate_incidents(A.signals(spark, sf), A.resolves(spark, sf))
    return markers(A.change_events(spark, sf), found, TENANT, AS_OF, 5 * DAY).select("marker_type", "service", "title", "start", "end")


ROUTES = [
    AL.RoutingRule("any", "", "", True, (("slack", "#all"),)),
    AL.RoutingRule("svc1", "SVC_1", "level >= warn AND environment = 'PROD'", True, (("pager", "p1"), ("slack", "#all"))),
    AL.RoutingRule("text", "", "labels.message =~ Request and severity != error", True, (("mail", "ops@example.com"),)),
    AL.RoutingRule("off", "", "", False, (("mail", "never@example.com"),)),
    AL.RoutingRule("bad", "", "not a clause", True, (("mail", "bad@example.com"),)),
    AL.RoutingRule("none", "", "missing = 1", True, (("mail", "missing@example.com"),)),
    AL.RoutingRule("order", "", "environment > a", True, (("mail", "order@example.com"),)),
    AL.RoutingRule("ten", "", "(severity>=err)", True, (("pager", "t1"),), tenant_id="ten_1"),
]
_R_SVC1 = "service = 'svc_1' AND level IN ('warn', 'error', 'fatal') AND environment = 'prod'"
_R_TEXT = "level <> 'error'"
_R_TEN = "tenant_id = 'ten_1' AND level IN ('error', 'fatal')"


@register(
    "route_alerts",
    f"""SELECT id, concat('any', CASE WHEN {_R_SVC1} THEN ',svc1' ELSE '' END, CASE WHEN {_R_TEXT} THEN ',text' ELSE '' END,
          CASE WHEN {_R_TEN} THEN ',ten' ELSE '' END) AS matched,
        concat('slack:#all', CASE WHEN {_R_SVC1} THEN ',pager:p1' ELSE '' END, CASE WHEN {_R_TEXT} THEN ',mail:ops@example.com' ELSE '' END,
          CASE WHEN {_R_TEN} THEN ',pager:t1' ELSE '' END) AS channels FROM {{logs}}""",
)
def routed(spark, sf):
    labels = F.create_map(F.lit("environment"), F.col("environment"), F.lit("message"), F.col("message"))
    events = A.logs(spark, sf).select("id", "tenant_id", "service", F.col("level").alias("severity"), labels.alias("labels"))
    out = AL.route_alerts(events, ROUTES)
    names = F.transform("channels", lambda c: F.concat(c["type"], F.lit(":"), c["target"]))
    return out.select("id", F.array_join("matched_rules", ",").alias("matched"), F.array_join(names, ",").alias("channels"))


@register(
    "webhook_subscribers",
    """WITH ep(tenant_id, endpoint_id, active, evs) AS (VALUES ('ten_0', 'e0', true, ''), ('ten_1', 'e1', true, 'error,click'),
          ('ten_1', 'e2', true, 'error'), ('ten_1', 'e3', false, ''), ('ten_2', 'e4', true, 'signup'))
       SELECT endpoint_id, event_type, count(*) AS n FROM (SELECT concat('ten_', cast(user_id % 3 AS string)) AS tenant_id, event_type FROM events) x
       JOIN ep ON x.tenant_id = ep.tenant_id AND active AND (evs = '' OR list_contains(string_split(evs, ','), event_type)) GROUP BY ALL""",
)
def subscribers(spark, sf):
    endpoints = spark.createDataFrame(
        [("ten_0", "e0", True, []), ("ten_1", "e1", True, ["error", "click"]), ("ten_1", "e2", True, ["error"]),
         ("ten_1", "e3", False, []), ("ten_2", "e4", True, ["signup"])],
        "tenant_id string, endpoint_id string, active boolean, events array<string>",
    ).withColumn("url", F.concat(F.lit("https://example.com/"), "endpoint_id"))
    events = A.load(spark, sf, "events").select(F.concat(F.lit("ten_"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), "event_type")
    return AL.webhook_subscribers(events, endpoints).groupBy("endpoint_id", "event_type").agg(F.count("*").alias("n"))


@register(
    "confidence",
    f"""SELECT id, {r6("CASE cast(id AS bigint) % 4 WHEN 0 THEN confidence WHEN 1 THEN 0.7 WHEN 2 THEN least(greatest((100 * confidence - 40.0) / 40.0, 0), 1) ELSE 0.5 END")} AS conf
        FROM {{signals}}""",
)
def confidences(spark, sf):
    which = F.col("id").cast("bigint") % 4
    kind = F.when(which == 0, "anomaly").when(which == 1, "absence").when(which == 2, "threshold").otherwise("other")
    threshold = F.when(which == 0, F.col("confidence")).otherwise(40.0)
    score = AL.confidence(kind, F.round(F.col("confidence") * 100), threshold)
    return A.signals(spark, sf).select("id", score.alias("conf"))


@register(
    "severity_bucket",
    """SELECT CASE WHEN confidence >= 0.85 THEN 'critical' WHEN confidence >= 0.6 THEN 'high' WHEN confidence >= 0.3 THEN 'medium' ELSE 'low' END AS severity,
       count(*) AS n FROM {signals} GROUP BY 1""",
)
def severities(spark, sf):
    bucket = AL.severity_bucket(F.col("confidence")).alias("severity")
    return A.signals(spark, sf).groupBy(bucket).agg(F.count("*").alias("n"))
