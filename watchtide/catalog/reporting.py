"""Business, usage and cost queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import business as B
from ..plans.sweep import asof_join
from ..sources import adapters as A
from .base import NOW, r6, register, rn

AS_OF = A.AS_OF


@register(
    "monthly_usage",
    """SELECT tenant_id, epoch_us(date_trunc('month', "timestamp")) AS month, count(*) AS events, cast(sum(strlen(body)) AS bigint) AS bytes
       FROM {logs} GROUP BY ALL""",
)
def usage(spark, sf):
    return B.monthly_usage(A.logs(spark, sf))


RETENTION = [("ten_0", 30), ("ten_1", 0)]
_RETENTION = "ret(tenant_id, retention_days) AS (VALUES ('ten_0', 30), ('ten_1', 0))"


def retention_of(spark):
    return spark.createDataFrame(RETENTION, "tenant_id string, retention_days int")


@register(
    "quota_usage",
    f"""WITH {_RETENTION} SELECT tenant_id, epoch_us(date_trunc('month', "timestamp")) AS month, count(*) AS events,
        cast(sum(strlen(body)) AS bigint) AS bytes, CASE WHEN max(retention_days) > 0 THEN max(retention_days) ELSE 7 END AS retention_days
        FROM {{logs}} LEFT JOIN ret USING (tenant_id) WHERE date_trunc('month', "timestamp") = date_trunc('month', {NOW}) GROUP BY 1, 2""",
)
def quota(spark, sf):
    return B.quota_usage(A.logs(spark, sf), retention_of(spark), AS_OF)


_PLANS = "plans(tenant_id, plan, ie, ig, oe, og) AS (VALUES ('ten_0', 'pro', 1000, 0.00001, 2000.0, 50000.0), ('ten_1', 'big', 100000000, 50.0, 2.0, 0.5))"
_OE, _OG = "greatest(events - coalesce(ie, 0), 0)", "greatest(bytes / 1e9::DOUBLE - coalesce(ig, 0), 0)"
_CE, _CG = rn(f"{_OE} / 1e6::DOUBLE * coalesce(oe, 0)", 2), rn(f"{_OG} * coalesce(og, 0)", 2)


@register(
    "invoice_preview",
    f"""WITH {_PLANS}, u AS (SELECT tenant_id, date_trunc('month', "timestamp") AS month, count(*) AS events, sum(strlen(body)) AS bytes FROM {{logs}} GROUP BY ALL)
        SELECT tenant_id, epoch_us(month) AS month, coalesce(plan, 'free') AS plan, events, cast(bytes AS bigint) AS bytes, {_OE} AS overage_events,
          {rn(_OG, 3)} AS overage_gb, {_CE} AS overage_events_cost, {_CG} AS overage_gb_cost, {rn(f"{_CE} + {_CG}", 2)} AS total_cost
        FROM u LEFT JOIN plans USING (tenant_id)""",
)
def invoice(spark, sf):
    plans = spark.createDataFrame(
        [("ten_0", "pro", 1000, 0.00001, 2000.0, 50000.0), ("ten_1", "big", 100_000_000, 50.0, 2.0, 0.5)],
        "tenant_id string, plan string, included_events bigint, included_gb double, overage_per_million_events double, overage_per_gb double",
    )
    return B.invoice_preview(B.monthly_usage(A.logs(spark, sf)), plans)


_RECENT = f""""timestamp" > {NOW} - INTERVAL 7 DAY AND "timestamp" <= {NOW}"""
_DAILY = f"""daily AS (SELECT tenant_id, 'logs' AS signal, cast(sum(strlen(message) + strlen(body)) AS bigint) // 7 AS daily_bytes FROM {{logs}} WHERE {_RECENT} GROUP BY tenant_id
    UNION ALL SELECT tenant_id, 'metrics', count(*) * 200 // 7 FROM {{metrics}} WHERE {_RECENT} GROUP BY tenant_id
    UNION ALL SELECT tenant_id, 'traces', count(*) * 400 // 7 FROM {{traces}} WHERE {_RECENT} GROUP BY tenant_id)"""


@register(
    "retention_cost",
    f"""WITH {_RETENTION}, {_DAILY}, s AS (SELECT tenant_id, CASE WHEN retention_days > 0 THEN retention_days ELSE 7 END AS retention_days, signal, daily_bytes
          FROM daily LEFT JOIN ret USING (tenant_id)), g AS (SELECT *, {rn("daily_bytes * retention_days / 1e9::DOUBLE", 3)} AS gb FROM s),
        c AS (SELECT *, {rn("gb * 0.10", 2)} AS usd FROM g)
        SELECT tenant_id, retention_days, signal, daily_bytes, gb AS retained_gb, usd AS monthly_usd FROM c
        UNION ALL SELECT tenant_id, retention_days, 'total', cast(sum(daily_bytes) AS bigint), {rn("sum(gb)", 3)}, {rn("sum(usd)", 2)} FROM c GROUP BY 1, 2""",
)
def cost(spark, sf):
    return B.retention_cost(A.logs(spark, sf), A.metrics(spark, sf), A.traces(spark, sf), retention_of(spark), AS_OF)


@register(
    "retention_what_if",
    f"""WITH {_DAILY}, g AS (SELECT tenant_id, d AS retention_days, {rn("daily_bytes * d * 1000 / 1e9::DOUBLE", 3)} AS gb
          FROM (SELECT *, unnest([7, 14, 30, 90, 365]) AS d FROM daily))
        SELECT tenant_id, retention_days, {rn("sum(gb)", 3)} AS total_gb, {rn(f"sum({rn('gb * 0.10', 2)})", 2)} AS total_monthly_usd FROM g GROUP BY 1, 2""",
)
def what_if(spark, sf):
    """Daily bytes times a thousand, so that the costs of the small test data do not round to nothing."""
    daily = B.daily_bytes(A.logs(spark, sf), A.metrics(spark, sf), A.traces(spark, sf), AS_OF)
    return B.retention_what_if(daily.withColumn("daily_bytes", F.col("daily_bytes") * 1000))


_BUDGET = "CASE WHEN sla IS NOT NULL THEN greatest((100.0::DOUBLE - sla) / 100.0::DOUBLE, 0) ELSE 0.05 END"


def _exposure(keys: str) -> str:
    return f"""SELECT {keys}, string_agg(DISTINCT service, ',' ORDER BY service) AS affected_services, string_agg(DISTINCT plan_tier, ',' ORDER BY plan_tier) AS affected_plan_tiers,
        count(DISTINCT customer) AS customer_count, sum(monthly_revenue) FILTER (monthly_revenue > 0) AS total, max(sla_target) FILTER (sla_target > 0) AS sla,
        count(*) AS mapping_count FROM {{business}} GROUP BY {keys}"""


@register(
    "exposure",
    f"""WITH x AS ({_exposure("tenant_id, service").replace("string_agg(DISTINCT service, ',' ORDER BY service)", "service")})
        SELECT tenant_id, service, affected_services, affected_plan_tiers, customer_count, {rn(f"total * {_BUDGET}", 2)} AS revenue_low,
          {rn("total", 2)} AS revenue_high, 'USD' AS currency, {r6("sla")} AS worst_sla_target, mapping_count FROM x""",
)
def exposure(spark, sf):
    """Revenue at risk per service."""
    return B.exposure(A.business_context(spark, sf), ("tenant_id", "service")).drop("basis")


@register(
    "exposed_customers",
    "SELECT DISTINCT tenant_id, service, customer FROM {business} WHERE customer <> ''",
)
def customers(spark, sf):
    return B.exposed_customers(A.business_context(spark, sf), ("tenant_id", "service"))


@register(
    "incident_exposure",
    f"""WITH i AS (SELECT tenant_id, service, count(*) AS signal_count FROM {{signals}} GROUP BY ALL),
        x AS (SELECT tenant_id, service, sum(monthly_revenue) FILTER (monthly_revenue > 0) AS total, max(sla_target) FILTER (sla_target > 0) AS sla, count(*) AS mapping_count
          FROM {{business}} GROUP BY ALL)
        SELECT i.tenant_id, i.service, signal_count, coalesce({rn(f"total * {_BUDGET}", 2)}, 0) AS revenue_low, coalesce({rn("total", 2)}, 0) AS revenue_high,
          coalesce(mapping_count, 0) AS mapping_count FROM i LEFT JOIN x USING (tenant_id, service)""",
)
def at_risk(spark, sf):
    incidents = A.signals(spark, sf).groupBy("tenant_id", "service").agg(F.count("*").alias("signal_count"))
    found = B.incident_exposure(incidents, A.business_context(spark, sf))
    return found.select("tenant_id", "service", "signal_count", "revenue_low", "revenue_high", "mapping_count")


@register(
    "first_event_at_or_after",
    """SELECT tenant_id, epoch_us(k.created_at) AS created_at, epoch_us((SELECT min(a.created_at) FROM {audit_log} a
       WHERE a.tenant_id = k.tenant_id AND a.created_at >= k.created_at)) AS queried_at FROM {api_keys} k""",
)
def forward(spark, sf):
    queries = A.audit_log(spark, sf).select("tenant_id", F.col("created_at").alias("queried_at"))
    return asof_join(A.api_keys(spark, sf), queries, ["tenant_id"], "created_at", "queried_at", ["queried_at"], forward=True)


@register(
    "time_to_first_query",
    f"""WITH k AS (SELECT tenant_id, min(created_at) AS o, count(*) AS n FROM {{api_keys}} GROUP BY 1), q AS (SELECT tenant_id, min(created_at) AS f FROM {{audit_log}} GROUP BY 1),
        w AS (SELECT tenant_id, epoch_us((SELECT min(a.created_at) FROM {{audit_log}} a WHERE a.tenant_id = k.tenant_id AND a.created_at >= k.created_at)) - epoch_us(k.created_at) AS us FROM {{api_keys}} k),
        m AS (SELECT tenant_id, quantile_cont(us, 0.5) AS med FROM w WHERE us IS NOT NULL GROUP BY 1)
        SELECT tenant_id, epoch_us(o) AS onboarded_at, epoch_us(f) AS first_query_at, CASE WHEN f >= o THEN {r6("(epoch_us(f) - epoch_us(o)) / 1e6::DOUBLE")} END AS ttfiq_seconds,
          coalesce(n, 0) AS cohort_count, CASE WHEN n > 1 THEN {r6("med / 1e6::DOUBLE")} END AS median_ttfiq_seconds
        FROM k FULL JOIN q USING (tenant_id) LEFT JOIN m USING (tenant_id)""",
)
def onboarding(spark, sf):
    return B.time_to_first_query(A.api_keys(spark, sf), A.audit_log(spark, sf))


def _paperwork(spark, sf):
    """Incidents out of error events and postmortems out of every third of them."""
    events = A.load(spark, sf, "events").filter("event_type = 'error'").withColumn("at", F.col("ts").cast("timestamp"))
    key = F.col("event_id")
    tenant = F.concat(F.lit("ten_"), (F.col("user_id") % 3).cast("string")).alias("tenant_id")
    severity = F.element_at(F.array(*map(F.lit, ["critical", "high", "medium", "low", ""])), (key % 5 + 1).cast("int"))
    resolved = F.when(key % 3 == 0, F.col("at") + F.expr("INTERVAL 2 HOURS"))
    incidents = events.filter(key % 7 != 0).select(
        tenant, key.cast("string").alias("incident_id"), F.concat(F.lit("svc_"), (F.col("user_id") % 7).cast("string")).alias("service"),
        severity.alias("severity"), F.when(key % 4 == 0, "resolved").otherwise("open").alias("status"), F.col("at").alias("first_seen"), resolved.alias("resolved_at"),
    )
    postmortems = events.select(
        tenant, F.concat(F.lit("pm"), key.cast("string")).alias("postmortem_id"), key.cast("string").alias("incident_id"),
        F.concat(F.lit("title "), key.cast("string")).alias("title"),
        F.when(key % 2 == 0, F.concat(F.lit("impact "), key.cast("string"))).otherwise("").alias("impact"), F.lit("summary").alias("summary"),
        F.lit("cause").alias("root_cause"), F.lit("steps").alias("timeline"),
        (F.col("at") + F.make_dt_interval(mins=(key % 600).cast("int"))).alias("created_at"),
        F.when(key % 3 == 1, F.col("at") + F.make_dt_interval(mins=(key % 900).cast("int"))).alias("published_at"),
    )
    return postmortems, incidents


_ERR = """e AS (SELECT event_id, user_id, ts, concat('ten_', cast(user_id % 3 AS string)) AS tenant_id, ['critical', 'high', 'medium', 'low', ''][cast(event_id % 5 AS int) + 1] AS sev,
    event_id % 7 <> 0 AS found, CASE WHEN event_id % 3 = 1 THEN event_id % 900 ELSE event_id % 600 END AS mins FROM events WHERE event_type = 'error')"""


@register(
    "regulatory_incident_report",
    f"""WITH {_ERR} SELECT tenant_id, concat('pm', cast(event_id AS string)) AS postmortem_id,
        CASE WHEN NOT found THEN 'operational_anomaly' WHEN sev = 'critical' THEN 'critical_infrastructure_disruption' WHEN sev = 'high' THEN 'service_disruption'
          WHEN sev = 'medium' THEN 'service_degradation' ELSE 'operational_anomaly' END AS incident_type,
        CASE WHEN found THEN epoch_us(ts) END AS detected_at, CASE WHEN found AND mins > 0 THEN {rn("mins * 60000000 / 3.6e9::DOUBLE", 2)} ELSE 0.0 END AS reported_within_hours,
        NOT found OR {rn("mins * 60000000 / 3.6e9::DOUBLE", 2)} <= 6 AS within_6h, CASE WHEN found THEN concat('svc_', cast(user_id % 7 AS string)) ELSE '' END AS affected_systems,
        CASE WHEN NOT found OR sev = '' THEN 'unknown' ELSE sev END AS severity, CASE WHEN event_id % 2 = 0 THEN concat('impact ', cast(event_id AS string)) ELSE 'summary' END AS impact,
        CASE WHEN NOT found THEN 'under_investigation' WHEN event_id % 4 = 0 OR event_id % 3 = 0 THEN 'resolved' ELSE 'ongoing' END AS status FROM e""",
)
def regulatory(spark, sf):
    report = B.regulatory_incident_report(*_paperwork(spark, sf))
    return report.drop("incident_id", "root_cause", "actions_taken")


@register(
    "open_commitments",
    f"""WITH {_ERR} SELECT tenant_id, concat('c', cast(event_id AS string)) AS commitment_id, concat('title ', cast(event_id AS string)) AS postmortem_title,
        epoch_us(ts) AS created_at FROM e WHERE event_id % 2 = 0""",
)
def commitments(spark, sf):
    postmortems, _ = _paperwork(spark, sf)
    key = F.col("incident_id").cast("bigint")
    made = A.load(spark, sf, "events").filter("event_type = 'error'").select(
        F.concat(F.lit("ten_"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("pm"), F.col("event_id").cast("string")).alias("postmortem_id"),
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("commitment_id"),
        F.when(F.col("event_id") % 2 == 0, "open").otherwise("done").alias("status"),
        F.col("ts").cast("date").alias("due_date"), F.col("ts").cast("timestamp").alias("created_at"),
    )
    found = B.open_commitments(made, postmortems)
    return found.select("tenant_id", "commitment_id", "postmortem_title", "created_at")


@register(
    "warroom_handoff",
    f"""WITH s AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS actions, string_agg(text, '|' ORDER BY turn) FILTER (role = 'user' AND trim(text) <> '') AS items,
          string_agg(DISTINCT concat(role, '=u', cast(conv_id AS string)), ',' ORDER BY concat(role, '=u', cast(conv_id AS string))) AS roles FROM conversations GROUP BY conv_id)
        SELECT cast(conv_id AS string) AS session_id, n AS timeline_count, coalesce(items, '') AS items, roles,
          floor((conv_id % 500) * 61 / 60.0::DOUBLE * 10 + 0.5) / 10.0::DOUBLE AS duration_minutes FROM s""",
)
def handoff(spark, sf):
    """Conversations as incident sessions: turns are entries, user turns are actions."""
    turns = A.load(spark, sf, "conversations")
    session = F.col("conv_id").cast("string").alias("session_id")
    tenant = F.lit("ten_1").alias("tenant_id")
    opened = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(secs=((F.col("conv_id") % 500) * 61).cast("int"))
    sessions = turns.select("conv_id").distinct().select(
        tenant, session, F.concat(F.lit("INC-"), "conv_id").alias("incident_id"), F.lit("lead").alias("commander"),
        F.lit("").alias("summary"), opened.alias("opened_at"),
    )
    entries = turns.select(
        tenant, session, F.timestamp_seconds("turn").alias("created_at"), F.col("turn").alias("entry_id"),
        F.when(F.col("role") == "user", "action").otherwise("note").alias("kind"), F.col("text").alias("body"),
    )
    roles = turns.select("conv_id", "role").distinct().select(
        tenant, session, F.timestamp_seconds(F.lit(0)).alias("assigned_at"), "role", F.concat(F.lit("u"), "conv_id").alias("assignee")
    )
    out = B.warroom_handoff(sessions, roles, entries, AS_OF)
    return out.select(
        "session_id", "timeline_count", F.array_join("action_items", "|").alias("items"), F.array_join("roles", ",").alias("roles"), "duration_minutes"
    )


@register(
    "tenant_config",
    f"""SELECT event_id AS key_hash, concat('ten_', cast(user_id % 3 AS string)) AS tenant_id,
        CASE user_id % 3 WHEN 0 THEN 65535 WHEN 1 THEN 14 ELSE 1 END AS retention_days, CASE user_id % 3 WHEN 0 THEN 'p0' ELSE '' END AS program
        FROM events WHERE event_type = 'signup' AND event_id % 5 <> 0 AND event_id % 3 <> 0 AND (event_id % 2 = 0 OR ts + INTERVAL 10 DAY > {NOW})""",
)
def settings(spark, sf):
    events = A.load(spark, sf, "events").filter("event_type = 'signup'").withColumn("at", F.col("ts").cast("timestamp"))
    key = F.col("event_id")
    keys = events.select(
        key.alias("key_hash"), F.concat(F.lit("ten_"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        F.when(key % 3 != 0, F.array(F.lit("logs:read"), F.lit("logs:ingest"))).otherwise(F.array(F.lit("logs:read"))).alias("scopes"),
        F.when(key % 5 == 0, F.col("at")).alias("revoked_at"), F.when(key % 2 != 0, F.col("at") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"),
    )
    tenants = spark.createDataFrame([("ten_0", 30), ("ten_1", 14), ("ten_2", 0)], "tenant_id string, retention_days int")
    retention = spark.createDataFrame([("ten_0", 100000, '{"email":"hash"}')], "tenant_id string, retention_days int, masking_actions string")
    programs = spark.createDataFrame([("ten_0", "p0", True), ("ten_1", "p1", False)], "tenant_id string, program string, enabled boolean")
    found = B.tenant_config(keys, tenants, retention, programs, AS_OF)
    return found.select("key_hash", "tenant_id", "retention_days", "program")


@register(
    "resolve_locale",
    """SELECT lang, doc_id % 3 AS k, CASE WHEN lower(lang) IN ('en', 'hi') THEN lower(lang) WHEN doc_id % 3 = 1 THEN 'hi' WHEN doc_id % 3 = 2 THEN 'ta' ELSE 'en' END AS locale,
       count(*) AS n FROM documents GROUP BY ALL""",
)
def locales(spark, sf):
    from ..functions.fields import resolve_locale

    docs = A.load(spark, sf, "documents").withColumn("k", F.col("doc_id") % 3)
    default = F.when(F.col("k") == 1, " HI-in ").when(F.col("k") == 2, "ta_IN").otherwise("xx")
    chosen = docs.withColumn("locale", resolve_locale(F.concat(F.upper("lang"), F.lit("-ZZ")), default))
    return chosen.groupBy("lang", "k", "locale").agg(F.count("*").alias("n"))
