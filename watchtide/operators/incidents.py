"""Signals folded into incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basics import blank_to_null
from ..functions.fields import fingerprint
from ..functions.folding import fold_part
from ..plans.closure import components
from ..plans.sweep import asof_join, running_totals
from ..session import reliable_checkpoint
from .alerts import ANY_SERVICE, severity_bucket
from .traces import neighbors

# Fixed value: confidence from which an incident pages.
PAGE_MIN_CONFIDENCE = 0.6


def _title(service, rule_name):
    return F.when(service == ANY_SERVICE, rule_name).otherwise(F.concat(service, F.lit(" degraded")))


def correlate_incidents(signals: DataFrame, resolves: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One incident per fingerprint and run of signals between resolves.

    ``signals``: tenant_id, service, rule_id, rule_name, confidence, deploy_id, timestamp.
    ``resolves``: tenant_id, service, timestamp. A resolve closes what was signalled up to and at its
    own instant; the next signal opens a new incident. With ``edges`` a signal first joins an open
    incident of a direct neighbour.
    """
    keyed = signals.withColumn("fingerprint", fingerprint("tenant_id", "service"))
    closes = resolves.withColumn("fingerprint", fingerprint("tenant_id", "service")).select(
        "tenant_id", "fingerprint", F.col("timestamp").alias("_closed")
    )
    by = ["tenant_id", "fingerprint"]
    if edges is None:
        islands = asof_join(keyed, closes, by, "timestamp", "_closed", ["_closed"], strict=True)
    else:
        islands = _merge_neighbors(keyed, resolves, edges)
    # First per rule, then per incident: a rule that fires all day is one row by the second step.
    nonblank = blank_to_null("deploy_id")
    when = F.col("timestamp")
    host = ["host_service"] if edges is not None else []
    per_rule = islands.groupBy(*by, "_closed", *host, "service", "rule_id").agg(
        F.count(F.lit(1)).alias("_signals"),
        F.max("confidence").alias("_confidence"),
        F.min(when).alias("_first"),
        F.max(when).alias("_last"),
        F.min_by("rule_name", when).alias("_rule_name"),
        F.min(F.when(nonblank.isNotNull(), F.struct(when.alias("at"), nonblank.alias("deploy_id")))).alias("_deploy"),
        F.min(F.when(F.col("confidence") >= PAGE_MIN_CONFIDENCE, when)).alias("_paged"),
    )
    seen = F.struct(F.col("_first").alias("at"), F.col("rule_id").alias("rule_id"))
    folded = per_rule.groupBy(*by, "_closed", *host).agg(
        F.min_by("service", "_first").alias("service"),
        F.min_by("_rule_name", "_first").alias("_rule_name"),
        F.sum("_signals").alias("signal_count"),
        F.max("_confidence").alias("confidence"),
        F.min("_first").alias("first_seen"),
        F.max("_last").alias("last_seen"),
        F.min("_deploy").alias("_deploy"),
        F.min("_paged").alias("paged_at"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(seen)), lambda s: s["rule_id"])).alias("correlated_rules"),
    )
    ends = closes.withColumnRenamed("_closed", "resolved_at")
    ended = asof_join(folded, ends, by, "last_seen", "resolved_at", ["resolved_at"], forward=True)
    service = F.col("host_service") if edges is not None else F.col("service")
    return ended.select(
        "tenant_id", "fingerprint", service.alias("service"),
        _title(service, F.col("_rule_name")).alias("title"),
        severity_bucket(F.col("confidence")).alias("severity"),
        "confidence", "signal_count", "first_seen", "last_seen",
        F.coalesce(F.col("_deploy.deploy_id"), F.lit("")).alias("deploy_id"),
        "correlated_rules",
        F.col("paged_at").isNotNull().alias("paged"), "paged_at",
        F.when(F.col("resolved_at").isNull(), "open").otherwise("resolved").alias("status"), "resolved_at",
    )


def _merge_neighbors(signals: DataFrame, resolves: DataFrame, edges: DataFrame) -> DataFrame:
    """Each signal with the incident it lands in when open neighbour incidents take it over.

    Between two resolves anywhere in a connected part of the service graph a service keeps one target:
    an open service's neighbours cannot open, and of several open neighbours the first opened wins. So
    signals shrink to one row per (service, stretch between resolves) before the order-dependent fold.
    A fold starts where nothing can be open in its part (:func:`_busy`) and holds what happens until that is so again.
    """
    near = reliable_checkpoint(neighbors(edges))
    parts = components(near, ["tenant_id"], "service", "neighbor").withColumnRenamed("component", "_part")

    def with_part(df: DataFrame) -> DataFrame:
        placed = df.join(parts, ["tenant_id", "service"], "left")
        return placed.withColumn("_part", F.coalesce("_part", "service"))

    marked, closing = with_part(signals), with_part(resolves)
    stretch = closing.select("tenant_id", "_part", F.col("timestamp").alias("_stretch"))
    cut = asof_join(marked, stretch, ["tenant_id", "_part"], "timestamp", "_stretch", ["_stretch"], strict=True)
    firsts = cut.groupBy("tenant_id", "_part", "service", "_stretch").agg(F.min("timestamp").alias("at"))
    facts = firsts.withColumn("what", F.lit("signal")).unionByName(
        closing.select("tenant_id", "_part", "service", F.col("timestamp").alias("at"), F.lit("resolve").alias("what")),
        allowMissingColumns=True,
    )
    links = near.groupBy("tenant_id", "service").agg(F.array_sort(F.collect_set("neighbor")).alias("near"))
    starts = _busy(marked, closing)
    facts = asof_join(facts, starts, ["tenant_id", "_part"], "at", "_busy", ["_busy"]).filter(F.col("_busy").isNotNull())
    facts = facts.join(links, ["tenant_id", "service"], "left").select(
        "tenant_id", F.col("_part").alias("part"), "_busy", "service", F.col("_stretch").alias("stretch"), "at", "what",
        F.coalesce("near", F.array().cast("array<string>")).alias("near"),
    )
    schema = "tenant_id string, part string, service string, stretch timestamp, host string, opened timestamp"
    placed = facts.groupBy("tenant_id", "part", "_busy").applyInPandas(fold_part, schema)
    target = placed.select(
        "tenant_id", F.col("part").alias("_part"), "service", F.col("stretch").alias("_stretch"),
        F.col("host").alias("host_service"), F.col("opened").alias("_closed"),
    )
    same = (
        (F.col("s.tenant_id") == F.col("t.tenant_id")) & (F.col("s._part") == F.col("t._part"))
        & (F.col("s.service") == F.col("t.service")) & F.col("s._stretch").eqNullSafe(F.col("t._stretch"))
    )
    joined = cut.alias("s").join(target.alias("t"), same).select("s.*", "t.host_service", "t._closed")
    return joined.withColumn("fingerprint", fingerprint("tenant_id", "host_service"))


def _busy(signals: DataFrame, resolves: DataFrame) -> DataFrame:
    """(tenant_id, _part, _busy): the instants at which something may open in a part where nothing could be open before.

    A service can be open from its first signal after a resolve until its next resolve, whatever its neighbours do. The
    number of such services is a running total, cut into time slices like all others.
    """
    by = ["tenant_id", "_part", "service"]
    closes = resolves.select(*by, F.col("timestamp").alias("_end"))
    since = asof_join(signals.select(*by, "timestamp"), closes, by, "timestamp", "_end", ["_end"], strict=True)
    opened = since.groupBy(*by, "_end").agg(F.min("timestamp").alias("at")).drop("_end")
    closed = asof_join(opened, closes, by, "at", "_end", ["_end"], forward=True).filter(F.col("_end").isNotNull())
    steps = opened.select(*by, "at", F.lit(0).alias("order"), F.lit(1).alias("open")).unionByName(
        closed.select(*by, F.col("_end").alias("at"), F.lit(1).alias("order"), F.lit(-1).alias("open"))
    )
    counted = running_totals(steps.withColumn("_at", F.unix_micros("at")), ["tenant_id", "_part"], "_at", ["order", "service"], ["open"])
    return counted.filter((F.col("open") == 1) & (F.col("run_open") == 1)).select("tenant_id", "_part", F.col("at").alias("_busy"))
