"""Change impact: health around a change, culprits, rollback targets and likely causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basics import as_of_col, clamp01, epoch_seconds, round_n, text_or_empty
from ..functions.times import trailing
from ..plans.ranking import top_n_per_group
from ..plans.sweep import asof_join, running_totals

# Weights and limits of the culprit and cause scores.
CHANGE_WEIGHTS = {"deploy": 1.0, "rollback": 0.95, "config": 0.75, "flag": 0.65}
OTHER_CHANGE_WEIGHT = 0.70
DEGRADED_DELTA = 0.02
RCA_WEIGHTS = {"type": 0.35, "recency": 0.30, "error_rate": 0.25, "blast": 0.10}
TYPE_FEATURE = {"deploy": 1.0, "dependency": 0.6}
OTHER_TYPE_FEATURE = 0.4
RECENCY_SECONDS = 3600.0
BLAST_LOG10_CAP = 4.0

BY_SERVICE = ["tenant_id", "service"]


def _second(ts="timestamp") -> Column:
    return F.date_trunc("second", F.col(ts))


def health_delta(df: DataFrame) -> DataFrame:
    """Error rates before and after, their difference and whether it counts as degraded."""

    def rate(part: str) -> Column:
        total = F.col(f"{part}_total")
        return F.when(total > 0, F.col(f"{part}_err") / total).otherwise(F.lit(0.0))

    raw = rate("after") - rate("before")
    return df.select(
        "*",
        round_n(rate("before"), 4).alias("before_rate"),
        round_n(rate("after"), 4).alias("after_rate"),
        round_n(raw, 4).alias("delta"),
        ((F.col("after_total") > 0) & (round_n(raw, 4) > DEGRADED_DELTA)).alias("degraded"),
    )


def _log_seconds(logs: DataFrame) -> DataFrame:
    """Log counts per service and second, instants on a whole second apart from the rest.

    Everything the health windows need: their bounds are whole seconds and inclusive. A service that
    writes a third of all logs shrinks to two rows per second before anything is shuffled.
    """
    us = F.unix_micros("timestamp")
    second = F.floor(us / F.lit(1e6)).cast("bigint") * 1_000_000
    slot = F.when(us == second, second).otherwise(second + 1)
    return logs.groupBy(*BY_SERVICE, slot.alias("_us")).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col("level").isin("error", "fatal")).alias("_err")
    )


def change_health(changes: DataFrame, logs: DataFrame, as_of, window: int = 3600) -> DataFrame:
    """Log and error counts in the half windows before and after each change, both ends inclusive.

    ``id`` identifies a change inside a tenant. Each change asks four running totals of its service,
    so the cost grows with changes plus seconds of logs, never with pairs of the two.
    """
    half = max(int(window) // 4, 300) * 1_000_000
    now = epoch_seconds(as_of) * 1_000_000
    at = F.unix_micros(_second())
    probes = F.array(
        *[
            F.struct(F.lit(name).alias("_probe"), us.alias("_us"), F.lit(order).alias("_order"))
            for name, us, order in (
                ("start", at - half, 0),
                ("before", at, 2),
                ("after", at, 0),
                ("end", F.least(at + half, F.lit(now)), 2),
            )
        ]
    )
    asked = changes.select(*BY_SERVICE, "id", F.explode(probes).alias("_p")).select(*BY_SERVICE, "id", "_p.*")
    asked = asked.withColumn("_all", F.lit(0).cast("bigint")).withColumn("_err", F.lit(0).cast("bigint"))
    events = _log_seconds(logs).withColumn("_order", F.lit(1)).unionByName(asked, allowMissingColumns=True)
    totals = running_totals(events, BY_SERVICE, "_us", ["_order"], ["_all", "_err"]).filter(F.col("_probe").isNotNull())

    def at_probe(name: str, column: str) -> Column:
        return F.max(F.when(F.col("_probe") == name, F.col(column)))

    counts = totals.groupBy(*BY_SERVICE, "id").agg(
        *[
            (at_probe(last, f"run_{c}") - at_probe(first, f"run_{c}")).cast("bigint").alias(f"{part}{suffix}")
            for part, first, last in (("before", "start", "before"), ("after", "after", "end"))
            for c, suffix in (("_all", "_total"), ("_err", "_err"))
        ]
    )
    return health_delta(changes.join(counts, [*BY_SERVICE, "id"]))


def _change_weight(kind: Column) -> Column:
    out = F.lit(OTHER_CHANGE_WEIGHT)
    for name, weight in CHANGE_WEIGHTS.items():
        out = F.when(kind == name, F.lit(weight)).otherwise(out)
    return out


def _age(as_of) -> Column:
    return F.greatest(F.unix_seconds(as_of_col(as_of)) - F.unix_seconds(F.col("timestamp")), F.lit(0))


def culprit_score(kind: Column, age: Column, window: int, after_total: Column, delta: Column) -> Column:
    structural = F.exp(-age / F.lit(float(window))) * _change_weight(kind)
    correlated = F.lit(0.55) * structural + F.lit(0.45) * clamp01(delta * 5)
    return round_n(F.when(F.coalesce(after_total, F.lit(0)) == 0, structural).otherwise(correlated), 2)


def rank_deploy_culprits(changes: DataFrame, logs: DataFrame, as_of, window: int = 3600, limit: int | None = None) -> DataFrame:
    """The changes per service in the window, or the newest ``limit``, most likely culprit first.

    ``position`` ranks within a service. The top culprit carries a rollback target when it is a
    degraded deploy with an earlier deploy to return to.
    """
    window = window if window > 0 else 3600
    recent = changes.filter(trailing("timestamp", as_of, window))
    newest = top_n_per_group(recent, BY_SERVICE, [F.col("timestamp").desc(), F.col("id").desc()], limit)
    reach = window + max(window // 4, 300)
    near = logs.filter(
        (F.col("timestamp") >= as_of_col(as_of) - F.make_dt_interval(secs=F.lit(reach + 1)))
        & (F.col("timestamp") <= as_of_col(as_of))
    )
    scored = change_health(newest, near, as_of, window).withColumn("age_seconds", _age(as_of))
    scored = scored.withColumn(
        "score", culprit_score(F.col("kind"), F.col("age_seconds"), window, F.col("after_total"), F.col("delta"))
    )
    order = [F.col("score").desc(), F.col("timestamp").desc(), F.col("id").desc()]
    ranked = scored.withColumn("position", F.row_number().over(Window.partitionBy(*BY_SERVICE).orderBy(*order)))
    prior = prior_deploy(ranked, changes.filter(F.col("timestamp") <= as_of_col(as_of)))
    suggest = (F.col("position") == 1) & (F.col("kind") == "deploy") & F.col("degraded")
    return prior.withColumn("reason", culprit_reason()).withColumns(
        {c: F.when(suggest, F.col(c)) for c in ("rollback_git_sha", "rollback_deploy_id")}
    )


def culprit_reason() -> Column:
    """Why a change ranks where it does, in words."""
    kind = F.ltrim(F.concat(F.col("kind"), F.lit(" change")))
    ago = F.format_string("%s ~%ds ago", kind, F.col("age_seconds"))
    rates = F.format_string("%.1f%%→%.1f%%", F.col("before_rate") * 100, F.col("after_rate") * 100)
    return (
        F.when(F.col("after_total") == 0, F.concat(ago, F.lit(" (no post-change telemetry to correlate)")))
        .when(F.col("degraded"), F.concat(ago, F.lit("; error rate rose "), rates, F.lit(" after the change")))
        .otherwise(F.concat(ago, F.lit("; error rate stable ("), rates, F.lit(")")))
    )


def prior_deploy(changes: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Each change with the latest deploy of its service in an earlier second.

    When that deploy has neither sha nor id there is no target, even if an older one has.
    """
    history = changes if history is None else history
    deploys = history.filter(F.col("kind") == "deploy").select(
        *BY_SERVICE,
        _second().alias("_deployed"),
        F.unix_micros("timestamp").alias("_us"),
        text_or_empty("git_sha").alias("rollback_git_sha"),
        text_or_empty("deploy_id").alias("rollback_deploy_id"),
    )
    values = ["_us", "rollback_git_sha", "rollback_deploy_id"]
    marked = changes.withColumn("_second", _second())
    found = asof_join(marked, deploys, BY_SERVICE, "_second", "_deployed", values, strict=True)
    blank = (F.coalesce("rollback_git_sha", F.lit("")) == "") & (F.coalesce("rollback_deploy_id", F.lit("")) == "")
    return found.withColumns(
        {c: F.when(~blank, F.col(c)) for c in ("rollback_git_sha", "rollback_deploy_id")}
    ).drop("_second", "_us")


def nearby_deploy(signals: DataFrame, changes: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Each signal with the latest deploy of its service at most three rule windows old, else ``''``."""
    deploys = changes.filter(F.col("kind") == "deploy").select(
        *BY_SERVICE, F.col("timestamp").alias("_deployed"), F.col("deploy_id").alias("nearby_deploy_id")
    )
    found = asof_join(signals, deploys, BY_SERVICE, ts, "_deployed", ["_deployed", "nearby_deploy_id"])
    horizon = F.unix_micros(F.col(ts)) - F.col("window_seconds").cast("bigint") * 3_000_000
    inside = (F.unix_micros("_deployed") > horizon) & (F.col("service") != "*")
    return found.withColumn(
        "nearby_deploy_id", F.when(inside, F.col("nearby_deploy_id")).otherwise(F.lit(""))
    ).drop("_deployed")


def rca_candidates(changes: DataFrame, edges: DataFrame, as_of, window: int = 3600, limit: int | None = None) -> DataFrame:
    """Suspects per service: its changes and the erring services it calls, best first.

    ``limit`` keeps that many of the newest changes and of the best suspects.
    """
    window = window if window > 0 else 3600
    recent = changes.filter(trailing("timestamp", as_of, window))
    newest = top_n_per_group(recent, BY_SERVICE, [F.col("timestamp").desc(), F.col("id").desc()], limit)
    deploys = newest.withColumn("age_seconds", _age(as_of)).select(
        *BY_SERVICE,
        F.lit("deploy").alias("type"),
        F.concat_ws(" ", "kind", "title").alias("subject"),
        round_n(F.lit(0.9) * F.exp(-F.col("age_seconds") / F.lit(float(window))), 2).alias("score"),
        F.col("age_seconds").cast("double"),
        "git_sha",
        "deploy_id",
        F.col("id").alias("_tie"),
        F.unix_micros("timestamp").alias("_us"),
    )
    rate = F.when(F.col("calls") > 0, F.col("errors") / F.col("calls")).otherwise(F.lit(0.0))
    dependencies = edges.filter(F.col("errors") > 0).select(
        "tenant_id",
        F.col("caller").alias("service"),
        F.lit("dependency").alias("type"),
        F.col("callee").alias("subject"),
        round_n(F.lit(0.4) + F.lit(0.5) * F.least(rate, F.lit(1.0)), 2).alias("score"),
        F.col("calls"),
        F.col("errors"),
        F.col("callee").alias("_tie"),
    )
    both = deploys.unionByName(dependencies, allowMissingColumns=True)
    # deploys come first among equals, newer before older
    order = [F.col("score").desc(), F.col("type").desc(), F.col("_us").desc(), F.col("_tie")]
    return top_n_per_group(both, BY_SERVICE, order, limit).drop("_tie", "_us")


def rca_rank(candidates: DataFrame, weights: dict[str, float] | None = None, gate: float | None = None, use_age: bool = False) -> DataFrame:
    """Re-score candidates by type, recency, error rate and blast, best first per service.

    Recency comes from a deploy's own score; ``use_age`` takes ``age_seconds`` where present instead.
    ``gate`` drops candidates below it.
    """
    weights = {**RCA_WEIGHTS, **(weights or {})}
    total = sum(weights.values())
    total = total if total > 0 else 1.0
    kind = F.lit(OTHER_TYPE_FEATURE)
    for name, feature in TYPE_FEATURE.items():
        kind = F.when(F.col("type") == name, F.lit(feature)).otherwise(kind)
    recency = F.when(F.col("type") == "deploy", clamp01(F.col("score"))).otherwise(F.lit(0.0))
    if use_age:
        decayed = clamp01(F.exp(-F.greatest(F.col("age_seconds"), F.lit(0.0)) / F.lit(RECENCY_SECONDS)))
        recency = F.when(F.col("age_seconds").isNotNull(), decayed).otherwise(recency)
    has_calls = F.coalesce(F.col("calls") > 0, F.lit(False))
    error_rate = F.when(has_calls & F.col("errors").isNotNull(), clamp01(F.col("errors") / F.col("calls"))).otherwise(F.lit(0.0))
    blast = F.when(has_calls, clamp01(F.log10(F.lit(1.0) + F.col("calls")) / F.lit(BLAST_LOG10_CAP))).otherwise(F.lit(0.0))
    weighted = (
        F.lit(weights["type"]) * kind + F.lit(weights["recency"]) * recency
        + F.lit(weights["error_rate"]) * error_rate + F.lit(weights["blast"]) * blast
    )
    scored = candidates.withColumn("rank_score", round_n(clamp01(weighted / F.lit(total)), 2))
    if gate is not None:
        scored = scored.filter(F.col("rank_score") >= gate)
    order = [F.col("rank_score").desc(), F.col("score").desc(), F.col("type").desc(), F.col("subject")]
    return scored.withColumn("position", F.row_number().over(Window.partitionBy(*BY_SERVICE).orderBy(*order)))


def rca_label_eval(ranked: DataFrame, feedback: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Ranked candidates with operator verdicts, and precision at ``k`` per tenant."""
    keys = [*BY_SERVICE, "type", "subject"]
    verdicts = feedback.groupBy(*keys).agg(F.max(F.col("was_root_cause").cast("int")).alias("was_root_cause"))
    labelled = ranked.join(verdicts, keys)
    top = labelled.filter(F.col("position") <= k).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("judged"),
        F.sum("was_root_cause").alias("correct"),
        F.avg("was_root_cause").alias("precision_at_k"),
    )
    return labelled, top
