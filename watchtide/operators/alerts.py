"""Alert rules, baselines, anomalies, confidence, state changes, routing and subscriptions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import as_of_col, clamp01, epoch_seconds
from ..functions.times import bucket_seconds, trailing
from ..plans.sweep import asof_join
from .rules import ANY_SERVICE, as_rule_table, longest_window, matching, route, route_table

# Baseline length, minimum history, sensitivity, gates and calibration.
BASELINE_WINDOWS = 12
MIN_BUCKETS = 4
ADAPTIVE_SIGMAS = 3
CERTAIN_Z = 6.0
ABSENCE_CONFIDENCE = 0.7
NEUTRAL_CONFIDENCE = 0.5
SEVERITIES = [(0.85, "critical"), (0.6, "high"), (0.3, "medium")]
LOWEST_SEVERITY = "low"
ANOMALY_MIN_SCORE = 0.5
CALIBRATION_DAYS = 90
CALIBRATION_MIN_SAMPLES = 5
CALIBRATION_FLOOR, CALIBRATION_SPAN = 0.5, 0.65


@dataclass(frozen=True)
class AlertRule:
    """One rule. ``condition`` is a tuple of ``(field, op, value)`` clauses, all of which must hold."""

    id: str
    tenant_id: str
    name: str = ""
    kind: str = "threshold"
    service: str = ""
    condition: tuple = ()
    threshold: float | None = None
    window_seconds: int = 300
    enabled: bool = True
    channels: tuple = ()


def evaluate_alert_rules(logs: DataFrame, rules, as_of) -> DataFrame:
    """Count and static firing state of every enabled rule, in one pass over the logs.

    ``rules`` is a table (:data:`.rules.RULES_SCHEMA`) or a list of :class:`AlertRule`. Hits are counted per rule before
    they move. Rules that match nothing stay with a count of zero.
    """
    table = as_rule_table(logs.sparkSession, rules)
    rows = logs.filter(trailing("timestamp", as_of, longest_window(table)))
    end = epoch_seconds(as_of)
    hits = matching(rows, table, lambda w: F.col("timestamp") > F.timestamp_seconds(F.lit(end) - w), ("timestamp",))
    counts = hits.groupBy("tenant_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    counted = table.drop("condition").join(counts, ["tenant_id", "rule_id"], "left")
    count = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    firing = (
        F.when(F.col("kind") == "threshold", F.coalesce(count > F.col("threshold"), F.lit(False)))
        .when(F.col("kind") == "absence", count == 0)
        .otherwise(F.lit(False))
    )
    return counted.select(
        "rule_id", "tenant_id", "rule_name", "kind", "service", "threshold", "window_seconds",
        count.alias("count"), firing.alias("firing"),
    )


def _check_windows(windows: int) -> None:
    if windows < MIN_BUCKETS:
        raise ValueError(f"a baseline needs {MIN_BUCKETS} windows at least, not {windows}")


def rolling_baseline(logs: DataFrame, rules, as_of, windows: int = BASELINE_WINDOWS) -> DataFrame:
    """Mean and deviation of each threshold rule's count over the windows before the current one.

    Buckets are epoch-aligned and only those with rows count; fewer than four withhold the rule. ``rules`` as for
    :func:`evaluate_alert_rules`.
    """
    _check_windows(windows)
    table = as_rule_table(logs.sparkSession, rules).filter("kind = 'threshold'")
    end = epoch_seconds(as_of)

    def before(w: Column) -> Column:
        at = F.col("timestamp")
        return (at > F.timestamp_seconds(F.lit(end) - (windows + 1) * w.cast("bigint"))) & (at <= F.timestamp_seconds(F.lit(end) - w))

    rows = logs.filter(trailing("timestamp", as_of, longest_window(table) * (windows + 1)))
    hits = matching(rows, table, before, ("timestamp",))
    epoch = F.unix_seconds("timestamp")
    bucket = (epoch - F.pmod(epoch, F.col("window_seconds").cast("bigint"))).alias("bucket")
    buckets = hits.groupBy("tenant_id", "rule_id", bucket).agg(F.count(F.lit(1)).alias("n"))
    stats = buckets.groupBy("rule_id", "tenant_id").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.count(F.lit(1)).alias("windows"))
    return stats.filter(F.col("windows") >= MIN_BUCKETS)


def adaptive_firing(evals: DataFrame, baselines: DataFrame) -> DataFrame:
    """Evaluations joined to their baselines: static firing, adaptive firing and either of them."""
    stats = baselines.select("rule_id", "tenant_id", "mean", "std", "windows")
    joined = evals.withColumnRenamed("firing", "static_firing").join(stats, ["rule_id", "tenant_id"], "left")
    outlier = (F.col("std") > 0) & (F.col("count") > F.col("mean") + ADAPTIVE_SIGMAS * F.col("std"))
    adaptive = F.coalesce(outlier, F.lit(False))
    return joined.withColumn("adaptive_firing", adaptive).withColumn("firing", F.col("static_firing") | adaptive)


def confidence(kind, count, threshold, mean=None, std=None) -> Column:
    """How sure a firing is, in [0, 1]. An anomaly passes its score as ``threshold``."""
    count = count.cast("double")
    against_threshold = F.when(threshold > 0, clamp01((count - threshold) / threshold)).otherwise(NEUTRAL_CONFIDENCE)
    if std is not None:
        against_threshold = F.when(std > 0, clamp01((count - mean) / std / CERTAIN_Z)).otherwise(against_threshold)
    return (
        F.when(kind == "anomaly", clamp01(threshold))
        .when(kind == "absence", ABSENCE_CONFIDENCE)
        .when(kind == "threshold", against_threshold)
        .otherwise(NEUTRAL_CONFIDENCE)
    )


def severity_bucket(score) -> Column:
    out = F.lit(LOWEST_SEVERITY)
    for floor, name in reversed(SEVERITIES):
        out = F.when(score >= floor, name).otherwise(out)
    return out


def anomaly_score(current: Column, mean: Column, std: Column) -> Column:
    """Outlier score in [0, 1]; the deviation is floored so a flat baseline cannot hide a spike."""
    z = (current - mean) / F.greatest(std, F.sqrt(F.greatest(mean, F.lit(1.0))))
    return F.when(z <= 0, F.lit(0.0)).otherwise(F.least(z / CERTAIN_Z, F.lit(1.0)))


def anomaly_sweep(
    logs: DataFrame, as_of, window: int = 300, windows: int = BASELINE_WINDOWS, min_score: float = ANOMALY_MIN_SCORE,
) -> DataFrame:
    """Services whose error count in the current window stands out from the windows before it."""
    window = window if window > 0 else 300
    _check_windows(windows)
    current = F.col("timestamp") > as_of_col(as_of) - F.make_dt_interval(secs=F.lit(window))
    errors = logs.filter(F.col("level").isin("error", "fatal") & trailing("timestamp", as_of, window * (windows + 1)))
    buckets = errors.groupBy(
        "tenant_id", "service", current.alias("_now"),
        F.when(~current, bucket_seconds("timestamp", window)).alias("_bucket"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return score_buckets(buckets, min_score)


def error_counts(logs: DataFrame, window: int = 300) -> DataFrame:
    """Error lines per service, bucket and second, as counts that add up, for :func:`swept_counts`.

    ``second`` is the first whole second at or after a line, so that reference times split no count. ``newest`` is the
    latest line of any level; it comes with a row of its own, without a service.
    """
    errors = logs.filter(F.col("level").isin("error", "fatal")).groupBy(
        "tenant_id", "service", bucket_seconds("timestamp", window).alias("bucket"),
        (F.unix_seconds("timestamp") + (F.pmod(F.unix_micros("timestamp"), F.lit(1_000_000)) > 0).cast("bigint")).alias("second"),
    ).agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("newest"))
    edge = logs.agg(F.max("timestamp").alias("newest")).withColumn("n", F.lit(0).cast("bigint"))
    return add_counts(errors.unionByName(edge.filter("newest is not null"), allowMissingColumns=True))


def add_counts(counts: DataFrame) -> DataFrame:
    """One row per service, bucket and second."""
    return counts.groupBy("tenant_id", "service", "bucket", "second").agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))


def swept_counts(counts: DataFrame, as_of, window: int = 300, windows: int = BASELINE_WINDOWS, min_score: float = ANOMALY_MIN_SCORE) -> DataFrame:
    """:func:`anomaly_sweep` out of counts made with the same ``window``, merged or not."""
    _check_windows(windows)
    now = F.unix_seconds(as_of_col(as_of))
    current = F.col("second") > now - window
    recent = counts.filter((F.col("second") <= now) & (F.col("second") > now - window * (windows + 1)))
    buckets = recent.groupBy("tenant_id", "service", current.alias("_now"), F.when(~current, F.col("bucket")).alias("_bucket")).agg(F.sum("n").alias("n"))
    return score_buckets(buckets, min_score)


def score_buckets(buckets: DataFrame, min_score: float = ANOMALY_MIN_SCORE) -> DataFrame:
    """Scores out of the error counts ``n`` per service and past ``_bucket``, and of the window ``_now``."""
    past = F.when(~F.col("_now"), F.col("n").cast("double"))
    stats = buckets.groupBy("tenant_id", "service").agg(
        F.sum(F.when(F.col("_now"), F.col("n"))).cast("double").alias("current"),
        F.avg(past).alias("mean"), F.stddev_pop(past).alias("std"), F.count(past).alias("windows"),
    )
    scored = stats.filter(F.col("current").isNotNull() & (F.col("windows") >= MIN_BUCKETS)).withColumn(
        "score", anomaly_score(F.col("current"), F.col("mean"), F.col("std"))
    )
    return scored.filter(F.col("score") >= min_score).drop("windows")


def alert_transitions(evals: DataFrame, at: str = "cycle") -> DataFrame:
    """Changes of firing state over evaluation cycles.

    A rule starts not firing. A resolve keeps the time it had fired; a new firing clears the resolve.
    """
    by = ["tenant_id", "rule_id"]
    before = evals.select(*by, at, F.col("firing").alias("_was"))
    changed = asof_join(evals, before, by, at, at, ["_was"], strict=True).filter(
        F.coalesce("_was", F.lit(False)) != F.col("firing")
    )
    fired = changed.filter("firing").select(*by, F.col(at).alias("_fired"))
    dated = asof_join(changed, fired, by, at, "_fired", ["_fired"])
    return dated.select(
        *by, at, "firing", F.col("_fired").alias("fired_at"),
        F.when(~F.col("firing"), F.col(at)).alias("resolved_at"),
    )


def calibration_factors(feedback: DataFrame, as_of) -> DataFrame:
    """Confidence multiplier per (tenant, service) from recent operator verdicts; few verdicts are neutral."""
    recent = feedback.filter(trailing("created_at", as_of, CALIBRATION_DAYS * 86400))
    votes = recent.groupBy("tenant_id", "service").agg(
        F.count_if(F.col("verdict") == "actionable").alias("actionable"),
        F.count_if(F.col("verdict") == "noise").alias("noise"),
    )
    total = F.col("actionable") + F.col("noise")
    judged = (total >= CALIBRATION_MIN_SAMPLES) & ~F.col("service").isin("", ANY_SERVICE)
    factor = F.when(judged, F.lit(CALIBRATION_FLOOR) + F.lit(CALIBRATION_SPAN) * F.col("actionable") / total).otherwise(F.lit(1.0))
    return votes.withColumn("factor", factor)


def calibrate(signals: DataFrame, factors: DataFrame) -> DataFrame:
    """Signals with their confidence scaled by the service's factor and clamped."""
    known = factors.select("tenant_id", "service", "factor")
    scaled = clamp01(F.col("confidence") * F.coalesce("factor", F.lit(1.0)))
    return signals.join(known, ["tenant_id", "service"], "left").withColumn("confidence", scaled).drop("factor")


# ---- routing -------------------------------------------------------------------------------

@dataclass(frozen=True)
class RoutingRule:
    """Where alerts go. ``condition`` holds AND-separated clauses such as ``level >= error and env = prod``."""

    id: str
    service: str = ""
    condition: str = ""
    enabled: bool = True
    channels: tuple = field(default_factory=tuple)
    tenant_id: str | None = None


def route_alerts(events: DataFrame, rules) -> DataFrame:
    """Events with the rules they match and the distinct channels those rules deliver to.

    Events need ``tenant_id``, ``service``, ``severity`` and a ``labels`` map. ``rules`` is a table
    (:data:`.rules.ROUTES_SCHEMA`) or a list of :class:`RoutingRule`.
    """
    return route(events, rules if isinstance(rules, DataFrame) else route_table(events.sparkSession, rules))


def webhook_subscribers(events: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Each event with every active endpoint of its tenant that listens to its type.

    An endpoint that lists no events listens to all. Both cases are equal keys, so the join stays an
    equi-join on (tenant, event type).
    """
    everything = F.array(F.lit(ANY_SERVICE))
    listens = F.when(F.size("events") == 0, everything).otherwise(F.array_distinct("events"))
    subscribed = endpoints.filter("active").select(
        "tenant_id", "endpoint_id", "url", F.explode(listens).alias("_key")
    )
    asked = events.withColumn("_key", F.explode(F.array(F.col("event_type"), F.lit(ANY_SERVICE))))
    return asked.join(subscribed, ["tenant_id", "_key"]).drop("_key")
