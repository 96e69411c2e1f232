"""Business context: exposure, usage, cost, onboarding and incident paperwork."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import as_of_col, blank_to_null, round_n, text_or_empty
from ..functions.times import trailing
from ..plans.quantiles import exact_quantile
from ..plans.sweep import asof_join

# Budgets, plan defaults, cost model and report wording.
DEFAULT_BUDGET = 0.05
CURRENCY = "USD"
BYTES_PER_GB = 1e9
DEFAULT_RETENTION_DAYS = 7
COST_DAYS = 7
RATE_PER_GB_MONTH = 0.10
ROW_BYTES = {"metrics": 200, "traces": 400}
WHAT_IF_DAYS = [7, 14, 30, 90, 365]
QUERY_ACTIONS = ["query", "export", "auth-events"]
INCIDENT_TYPES = {
    "critical": "critical_infrastructure_disruption",
    "high": "service_disruption",
    "medium": "service_degradation",
}
OTHER_INCIDENT_TYPE = "operational_anomaly"
REPORT_HOURS = 6
FREE_PLAN = "free"


def exposure(mappings: DataFrame, by=("tenant_id",)) -> DataFrame:
    """Revenue at risk per group of business mappings, as a range.

    High is all positive monthly revenue; low is the share inside the strictest SLA's error budget, or
    5 % when none is declared. Services and plan tiers come as sorted lists; customers, of which there
    may be very many, as a count here and as rows from :func:`exposed_customers`.
    """
    by = list(by)
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    names = lambda c: F.array_sort(F.array_compact(F.collect_set(blank_to_null(c))))
    # one row per (service, tier) first, so the lists are built from few rows
    partial = mappings.groupBy(*by, "service", "plan_tier").agg(
        F.sum(positive("monthly_revenue")).alias("_revenue"),
        F.max(positive("sla_target")).alias("_sla"),
        F.count(F.lit(1)).alias("_rows"),
    )
    totals = partial.groupBy(*by).agg(
        names("service").alias("affected_services"),
        names("plan_tier").alias("affected_plan_tiers"),
        F.coalesce(F.sum("_revenue"), F.lit(0.0)).alias("_total"),
        F.max("_sla").alias("worst_sla_target"),
        F.sum("_rows").alias("mapping_count"),
    )
    customers = exposed_customers(mappings, by).groupBy(*by).agg(F.count(F.lit(1)).alias("customer_count"))
    sla = F.col("worst_sla_target")
    budget = F.when(sla.isNotNull(), F.greatest((F.lit(100.0) - sla) / F.lit(100.0), F.lit(0.0))).otherwise(DEFAULT_BUDGET)
    share = F.when(
        sla.isNotNull(), F.format_string("strictest-SLA (%.3f%%) error-budget share", sla)
    ).otherwise("5% partial-impact floor (no SLA declared)")
    basis = F.concat(
        F.lit("monthly revenue of affected customers; low = "), share, F.lit(", high = full sustained-outage exposure")
    )
    joined = totals.join(customers, by, "left")
    return joined.select(
        *by, "affected_services", "affected_plan_tiers",
        F.coalesce("customer_count", F.lit(0)).alias("customer_count"),
        round_n(F.col("_total") * budget, 2).alias("revenue_low"),
        round_n(F.col("_total"), 2).alias("revenue_high"),
        F.lit(CURRENCY).alias("currency"), "worst_sla_target", "mapping_count", basis.alias("basis"),
    )


def exposed_customers(mappings: DataFrame, by=("tenant_id",)) -> DataFrame:
    """One row per affected customer of each group."""
    return mappings.filter(text_or_empty("customer") != "").select(*by, "customer").distinct()


def incident_exposure(incidents: DataFrame, mappings: DataFrame) -> DataFrame:
    """Incidents with the exposure of their service; incidents without mappings show zero."""
    per_service = exposure(mappings, ("tenant_id", "service")).drop("affected_services")
    joined = incidents.join(per_service, ["tenant_id", "service"], "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("revenue_low", "revenue_high")}
    zero |= {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("mapping_count", "customer_count")}
    return joined.withColumns(zero)


def monthly_usage(logs: DataFrame, as_of=None) -> DataFrame:
    """Events and body bytes per tenant and calendar month; with ``as_of`` only its month."""
    if as_of is not None:
        start = F.date_trunc("month", as_of_col(as_of))
        logs = logs.filter((F.col("timestamp") >= start) & (F.col("timestamp") < F.add_months(start, 1).cast("timestamp")))
    return logs.groupBy("tenant_id", F.date_trunc("month", "timestamp").alias("month")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.octet_length("body")).cast("bigint").alias("bytes")
    )


def quota_usage(logs: DataFrame, retention: DataFrame, as_of) -> DataFrame:
    """This month's usage with the tenant's retention; missing or non-positive retention is 7 days."""
    days = F.when(F.col("retention_days") > 0, F.col("retention_days")).otherwise(DEFAULT_RETENTION_DAYS)
    usage = monthly_usage(logs, as_of).join(retention.select("tenant_id", "retention_days"), "tenant_id", "left")
    return usage.withColumn("retention_days", days)


def invoice_preview(usage: DataFrame, plans: DataFrame) -> DataFrame:
    """Overage and cost per tenant; a tenant without a plan is on the free one with nothing included."""
    columns = ["included_events", "included_gb", "overage_per_million_events", "overage_per_gb"]
    joined = usage.join(plans.select("tenant_id", "plan", *columns), "tenant_id", "left")
    joined = joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    gb = F.col("bytes") / F.lit(BYTES_PER_GB)
    over_events = F.greatest(F.col("events") - F.col("included_events"), F.lit(0.0))
    over_gb = F.greatest(gb - F.col("included_gb"), F.lit(0.0))
    events_cost = round_n(over_events / F.lit(1e6) * F.col("overage_per_million_events"), 2)
    gb_cost = round_n(over_gb * F.col("overage_per_gb"), 2)
    keep = [c for c in usage.columns if c not in ("events", "bytes")]
    return joined.select(
        *keep, F.coalesce("plan", F.lit(FREE_PLAN)).alias("plan"), "events", "bytes",
        over_events.cast("bigint").alias("overage_events"), round_n(over_gb, 3).alias("overage_gb"),
        events_cost.alias("overage_events_cost"), gb_cost.alias("overage_gb_cost"),
        round_n(events_cost + gb_cost, 2).alias("total_cost"),
    )


def daily_bytes(logs: DataFrame, metrics: DataFrame, traces: DataFrame, as_of) -> DataFrame:
    """Observed bytes per day and signal over the last week; metrics and traces are estimated per row."""
    recent = trailing("timestamp", as_of, COST_DAYS * 86400)

    def daily(df: DataFrame, signal: str, total: Column) -> DataFrame:
        sums = df.filter(recent).groupBy("tenant_id").agg(total.cast("bigint").alias("_total"))
        return sums.select("tenant_id", F.lit(signal).alias("signal"), F.expr(f"_total div {COST_DAYS}").alias("daily_bytes"))

    out = daily(logs, "logs", F.sum(F.octet_length("message") + F.octet_length("body")))
    for df, signal in ((metrics, "metrics"), (traces, "traces")):
        out = out.unionByName(daily(df, signal, F.count(F.lit(1)) * ROW_BYTES[signal]))
    return out


def _cost(daily: Column, days: Column, rate: float) -> tuple[Column, Column]:
    gb = round_n(daily.cast("double") * days / F.lit(BYTES_PER_GB), 3)
    return gb, round_n(gb * F.lit(rate), 2)


def retention_cost(
    logs: DataFrame, metrics: DataFrame, traces: DataFrame, retention: DataFrame, as_of, rate: float = RATE_PER_GB_MONTH,
) -> DataFrame:
    """Retained gigabytes and monthly cost per tenant and signal, with a ``total`` row per tenant."""
    daily = daily_bytes(logs, metrics, traces, as_of).join(retention.select("tenant_id", "retention_days"), "tenant_id", "left")
    days = F.when(F.col("retention_days") > 0, F.col("retention_days")).otherwise(DEFAULT_RETENTION_DAYS)
    gb, usd = _cost(F.col("daily_bytes"), days, rate)
    signals = daily.select("tenant_id", days.alias("retention_days"), "signal", "daily_bytes", gb.alias("retained_gb"), usd.alias("monthly_usd"))
    total = signals.groupBy("tenant_id", "retention_days").agg(
        F.lit("total").alias("signal"), F.sum("daily_bytes").alias("daily_bytes"),
        round_n(F.sum("retained_gb"), 3).alias("retained_gb"), round_n(F.sum("monthly_usd"), 2).alias("monthly_usd"),
    )
    return signals.unionByName(total)


def retention_what_if(daily: DataFrame, days=tuple(WHAT_IF_DAYS), rate: float = RATE_PER_GB_MONTH) -> DataFrame:
    """Total cost per tenant at each candidate retention."""
    candidates = daily.withColumn("retention_days", F.explode(F.array(*map(F.lit, days))))
    gb, usd = _cost(F.col("daily_bytes"), F.col("retention_days"), rate)
    return candidates.groupBy("tenant_id", "retention_days").agg(
        round_n(F.sum(gb), 3).alias("total_gb"), round_n(F.sum(usd), 2).alias("total_monthly_usd")
    )


def time_to_first_query(api_keys: DataFrame, audit: DataFrame) -> DataFrame:
    """Per tenant: onboarding, first query, seconds between them, and the median over key cohorts.

    A cohort is one key; its wait ends at the first query at or after it. The median needs more than
    one key.
    """
    queries = audit.filter(F.col("action").isin(QUERY_ACTIONS)).select("tenant_id", F.col("created_at").alias("queried_at"))
    keys = api_keys.select("tenant_id", "created_at")
    onboarding = keys.groupBy("tenant_id").agg(F.min("created_at").alias("onboarded_at"), F.count(F.lit(1)).alias("cohort_count"))
    first = queries.groupBy("tenant_id").agg(F.min("queried_at").alias("first_query_at"))
    answered = asof_join(keys, queries, ["tenant_id"], "created_at", "queried_at", ["queried_at"], forward=True)
    waits = answered.filter(F.col("queried_at").isNotNull()).select(
        "tenant_id", (F.unix_micros("queried_at") - F.unix_micros("created_at")).alias("_wait")
    )
    median = exact_quantile(waits, ["tenant_id"], "_wait", 0.5, "_median")
    joined = onboarding.join(first, "tenant_id", "full").join(median, "tenant_id", "left")
    gap = (F.unix_micros("first_query_at") - F.unix_micros("onboarded_at")) / F.lit(1e6)
    return joined.select(
        "tenant_id", "onboarded_at", "first_query_at", F.when(gap >= 0, gap).alias("ttfiq_seconds"),
        F.coalesce("cohort_count", F.lit(0)).alias("cohort_count"),
        F.when(F.col("cohort_count") > 1, F.col("_median") / F.lit(1e6)).alias("median_ttfiq_seconds"),
    )


def regulatory_incident_report(postmortems: DataFrame, incidents: DataFrame) -> DataFrame:
    """The fixed incident export per postmortem, joined to its incident inside the tenant.

    ``within_6h`` tells whether reporting met the six-hour limit.
    """
    known = incidents.select(
        "tenant_id", "incident_id", F.lit(True).alias("_found"), F.col("service").alias("_service"),
        F.col("severity").alias("_severity"), F.col("status").alias("_status"),
        F.col("first_seen").alias("_first"), F.col("resolved_at").alias("_resolved"),
    )
    joined = postmortems.join(known, ["tenant_id", "incident_id"], "left")
    kind = F.lit(OTHER_INCIDENT_TYPE)
    for severity, name in INCIDENT_TYPES.items():
        kind = F.when(F.col("_severity") == severity, name).otherwise(kind)
    reported = F.coalesce("published_at", "created_at")
    hours = (F.unix_micros(reported) - F.unix_micros("_first")) / F.lit(3.6e9)
    elapsed = F.when(hours > 0, round_n(hours, 2)).otherwise(F.lit(0.0))
    status = (
        F.when(F.col("_found").isNull(), "under_investigation")
        .when((F.col("_status") == "resolved") | F.col("_resolved").isNotNull(), "resolved")
        .otherwise("ongoing")
    )
    systems = F.when(text_or_empty("_service") != "", F.array("_service")).otherwise(F.array().cast("array<string>"))
    return joined.select(
        "tenant_id", "postmortem_id", "incident_id", kind.alias("incident_type"), F.col("_first").alias("detected_at"),
        elapsed.alias("reported_within_hours"), (elapsed <= REPORT_HOURS).alias("within_6h"),
        systems.alias("affected_systems"), F.coalesce(blank_to_null("_severity"), F.lit("unknown")).alias("severity"),
        F.coalesce(blank_to_null("impact"), text_or_empty("summary")).alias("impact"), "root_cause",
        F.col("timeline").alias("actions_taken"), status.alias("status"),
    )


def warroom_handoff(sessions: DataFrame, roles: DataFrame, entries: DataFrame, as_of) -> DataFrame:
    """Handoff summary per incident session: duration, roles, action items in order and a narrative.

    Only action entries are gathered; a session's are what people typed during one incident.
    """
    key = ["tenant_id", "session_id"]
    body = F.col("body")
    is_action = (F.col("kind") == "action") & (F.trim(body) != "")
    noted = entries.groupBy(*key).agg(
        F.count(F.lit(1)).alias("timeline_count"),
        F.array_sort(F.collect_list(F.when(is_action, F.struct("created_at", "entry_id", "body")))).alias("_actions"),
    )
    held = roles.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("assigned_at", "role", "assignee"))).alias("_roles"))
    ended = F.coalesce("closed_at", as_of_col(as_of)) if "closed_at" in sessions.columns else as_of_col(as_of)
    minutes = F.greatest((F.unix_micros(ended) - F.unix_micros("opened_at")) / F.lit(6e7), F.lit(0.0))
    empty = F.array().cast("array<string>")
    shown = sessions.join(noted, key, "left").join(held, key, "left").withColumns({
        "duration_minutes": F.floor(minutes * 10 + F.lit(0.5)) / F.lit(10.0),
        "timeline_count": F.coalesce("timeline_count", F.lit(0)),
        "action_items": F.coalesce(F.transform("_actions", lambda a: a["body"]), empty),
        "roles": F.coalesce(F.transform("_roles", lambda r: F.concat(r["role"], F.lit("="), r["assignee"])), empty),
    })
    optional = lambda test, text: F.when(test, text).otherwise(F.lit(""))
    numbered = F.transform("action_items", lambda a, i: F.concat(F.lit("  [ ] "), i + 1, F.lit(". "), a, F.lit("\n")))
    narrative = F.concat(
        F.format_string("Incident %s handoff\n", F.col("incident_id")),
        optional(text_or_empty("commander") != "", F.format_string("Commander: %s\n", F.col("commander"))),
        F.format_string(
            "Duration: %.1f min · %d timeline entries · %d action item(s)\n",
            F.col("duration_minutes"), F.col("timeline_count"), F.size("action_items"),
        ),
        optional(F.size("roles") > 0, F.concat(F.lit("Command: "), F.array_join("roles", ", "), F.lit("\n"))),
        optional(text_or_empty("summary") != "", F.format_string("Summary: %s\n", F.col("summary"))),
        F.array_join(numbered, ""),
    )
    return shown.withColumn("narrative", narrative).select(
        *key, "incident_id", "commander", "duration_minutes", "roles", "action_items", "timeline_count", "summary", "narrative"
    )


def open_commitments(commitments: DataFrame, postmortems: DataFrame, status: str | None = "open") -> DataFrame:
    """Remediation commitments with their postmortem's title, newest first."""
    rows = commitments.filter(F.col("status") == status) if status else commitments
    titles = postmortems.select("tenant_id", "postmortem_id", F.col("title").alias("postmortem_title"), "incident_id")
    return rows.join(titles, ["tenant_id", "postmortem_id"]).orderBy(F.col("created_at").desc(), F.col("commitment_id").desc())


def tenant_config(api_keys: DataFrame, tenants: DataFrame, retention: DataFrame, transforms: DataFrame, as_of, scope: str = "logs:ingest") -> DataFrame:
    """The ingest settings behind every usable key."""
    now = as_of_col(as_of)
    usable = api_keys.filter(
        F.col("revoked_at").isNull()
        & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
        & F.array_contains("scopes", scope)
    ).select("key_hash", "tenant_id", "scopes")
    settings = retention.select("tenant_id", F.col("retention_days").alias("_days"), "masking_actions")
    programs = transforms.filter("enabled").select("tenant_id", "program")
    joined = (
        usable.join(tenants.select("tenant_id", F.col("retention_days").alias("_default")), "tenant_id")
        .join(settings, "tenant_id", "left")
        .join(programs, "tenant_id", "left")
    )
    days = F.least(F.greatest(F.coalesce("_days", "_default"), F.lit(1)), F.lit(65535))
    return joined.select(
        "key_hash", "tenant_id", "scopes", days.alias("retention_days"),
        F.coalesce("masking_actions", F.lit("{}")).alias("masking_actions"),
        F.coalesce("program", F.lit("")).alias("program"),
    )
