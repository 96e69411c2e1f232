"""Trend, seasonality and capacity over bucketed metric series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basics import as_of_col, round_n
from ..functions.times import bucket_seconds, trailing

# Smoothing and season of the capacity report.
EWMA_ALPHA = 0.3
DAY_SECONDS = 86400
SERIES = ["tenant_id", "service", "metric_name"]
WITHHELD = "insufficient history for a trend (need >= 2 windows)"


def bucketed_series(metrics: DataFrame, as_of, window: int = 300, lookback: int | None = None) -> DataFrame:
    """Average per series and bucket with the bucket's index, over ``lookback`` seconds or all that came before."""
    before = trailing("timestamp", as_of, lookback) if lookback else F.col("timestamp") <= as_of_col(as_of)
    points = metrics.filter(before).groupBy(
        *SERIES, bucket_seconds("timestamp", window).alias("bucket")
    ).agg(F.avg("value").alias("v"))
    index = F.row_number().over(Window.partitionBy(*SERIES).orderBy("bucket")) - 1
    return points.withColumn("idx", index)


def trend_columns(value: Column, index: Column) -> tuple[Column, Column]:
    """Least-squares slope and intercept aggregates over ``index``; one point is flat, none is zero."""
    n = F.count(value)
    slope = F.when(n >= 2, F.regr_slope(value, index)).otherwise(F.lit(0.0))
    level = F.when(n >= 2, F.regr_intercept(value, index)).when(n == 1, F.max(value)).otherwise(F.lit(0.0))
    return slope, level


def linear_trend(series: DataFrame, by=SERIES) -> DataFrame:
    """Slope and intercept per series of ``(idx, v)`` rows."""
    slope, intercept = trend_columns(F.col("v"), F.col("idx"))
    return series.groupBy(*by).agg(F.count("v").alias("points"), slope.alias("slope"), intercept.alias("intercept"))


def project(points: Column, slope: Column, intercept: Column, steps) -> Column:
    """The trend ``steps`` past its last point."""
    return slope * (points - 1 + F.lit(steps)) + intercept


def time_to_threshold(current: Column, slope: Column, threshold: Column) -> Column:
    """Steps until the trend reaches the threshold; NULL when it never does."""
    gap = threshold - current
    return F.when(gap == 0, F.lit(0.0)).when((slope == 0) | (F.signum(gap) != F.signum(slope)), None).otherwise(
        F.try_divide(gap, slope)
    )


def smoothing(alpha: float) -> float:
    return EWMA_ALPHA if alpha <= 0 else min(alpha, 1.0)


def ewma_of(values: Column, alpha: float = EWMA_ALPHA) -> Column:
    """Exponential smoothing of a short ordered array of doubles; an empty array gives 0."""
    a = smoothing(alpha)
    smoothed = F.aggregate(
        F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))),
        F.try_element_at(values, F.lit(1)),
        lambda s, x: F.lit(a) * x + F.lit(1 - a) * s,
    )
    return F.coalesce(smoothed, F.lit(0.0))


def ewma_total(value: Column, position: Column, count: Column, alpha: float = EWMA_ALPHA) -> Column:
    """Aggregate: exponential smoothing of ``count`` values at ``position`` 0, 1, ...; no values give 0.

    Every value has the weight that the recurrence leaves it with after the last one, so the smoothed level is a sum
    that Spark combines in parts: no series is ever a list. Rows with a NULL position take no part; a NULL value adds nothing.
    """
    a = smoothing(alpha)
    left = F.pow(F.lit(1.0 - a), count - 1 - position)
    weight = F.when(position == 0, left).otherwise(F.lit(a) * left)
    return F.coalesce(F.sum(F.when(position >= 0, value * weight)), F.lit(0.0))


def ewma(series: DataFrame, alpha: float = EWMA_ALPHA, by=SERIES) -> DataFrame:
    """Smoothed level per series of ``(idx, v)`` rows, ``idx`` counting from 0."""
    counted = series.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return counted.groupBy(*by).agg(ewma_total(F.col("v"), F.col("idx"), F.col("_n"), alpha).alias("ewma"))


def deploy_reset(series: DataFrame, changes: DataFrame, as_of=None, lookback: int | None = None) -> DataFrame:
    """Series with ``reset``: index of the first bucket at or after the service's latest deploy, else -1.

    A deploy ahead of the series or after its last bucket resets nothing.
    """
    deploys = changes.filter(F.col("kind") == "deploy")
    if as_of is not None and lookback:
        deploys = deploys.filter(trailing("timestamp", as_of, lookback))
    latest = deploys.groupBy("tenant_id", "service").agg(F.unix_seconds(F.max("timestamp")).alias("_deployed"))
    joined = series.join(latest, ["tenant_id", "service"], "left")
    first = F.min(F.when(F.col("bucket") >= F.col("_deployed"), F.col("idx"))).over(Window.partitionBy(*SERIES))
    return joined.withColumn("reset", F.when(first > 0, first).otherwise(F.lit(-1))).drop("_deployed")


def seasonal_mean(value: Column, index: Column, points: Column, reset: Column, period: int) -> Column:
    """Aggregate: mean of the points whole periods before the next one, not reaching behind the reset."""
    back = points - index
    same_phase = (F.pmod(back, F.lit(period)) == 0) & (index >= F.greatest(reset, F.lit(0)))
    return F.avg(F.when(same_phase, value))


def seasonal_baseline(series: DataFrame, period: int, by=SERIES) -> DataFrame:
    """Seasonal-naive baseline per series; series without a matching point, or ``period < 1``, are left out.

    ``series`` may carry a ``reset`` column.
    """
    if period < 1:
        return series.select(*by, F.lit(None).cast("double").alias("seasonal_baseline")).limit(0)
    reset = F.col("reset") if "reset" in series.columns else F.lit(-1)
    counted = series.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    mean = seasonal_mean(F.col("v"), F.col("idx"), F.col("_n"), reset, period)
    return counted.groupBy(*by).agg(mean.alias("seasonal_baseline")).filter(F.col("seasonal_baseline").isNotNull())


def deviation(actual: Column, baseline: Column) -> Column:
    return (actual - baseline) / F.greatest(F.abs(baseline), F.lit(1.0))


def forecast_capacity(
    metrics: DataFrame, changes: DataFrame, as_of, window: int = 300, horizon: int = 12,
    thresholds: dict[str, float] | float | None = None, buckets: int | None = None,
) -> DataFrame:
    """Capacity report of every (tenant, service, metric) series.

    The trend and the smoothed level use points since the latest deploy. Index, reset and report share
    one partitioning by series. ``buckets`` cuts the history to that many windows before the reference time.
    """
    lookback = window * buckets if buckets else None
    series = deploy_reset(bucketed_series(metrics, as_of, window, lookback), changes, as_of, lookback)
    points = series.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*SERIES)))
    since = F.col("idx") - F.greatest(F.col("reset"), F.lit(0))
    used, position = F.when(since >= 0, F.col("v")), F.when(since >= 0, since)
    slope, intercept = trend_columns(used, position)
    period = DAY_SECONDS // window
    season = seasonal_mean(F.col("v"), F.col("idx"), F.col("n"), F.col("reset"), period) if period >= 2 else F.lit(None).cast("double")
    stats = points.groupBy(*SERIES).agg(
        F.max("n").alias("points"),
        F.max("reset").alias("deploy_reset_index"),
        F.max_by("v", "idx").alias("current"),
        F.count(used).alias("_used"),
        slope.alias("_slope"),
        intercept.alias("_intercept"),
        ewma_total(used, position, F.col("n") - F.greatest(F.col("reset"), F.lit(0))).alias("_ewma"),
        season.alias("_season"),
    )
    if isinstance(thresholds, dict):
        limit = F.lit(None).cast("double")
        for metric, value in thresholds.items():
            limit = F.when(F.col("metric_name") == metric, F.lit(float(value))).otherwise(limit)
    else:
        limit = F.lit(thresholds).cast("double")
    enough = F.col("points") >= 2
    steps = time_to_threshold(F.col("current"), F.col("_slope"), limit)

    def trended(value: Column, short=None) -> Column:
        return F.when(enough, value).otherwise(short) if short is not None else F.when(enough, value)

    return stats.select(
        *SERIES,
        F.col("points").cast("bigint").alias("points"),
        F.when(enough, F.col("deploy_reset_index")).otherwise(-1).alias("deploy_reset_index"),
        "current",
        trended(round_n(F.col("_slope"), 6), F.lit(0.0)).alias("slope"),
        trended(round_n(F.col("_intercept"), 6), F.col("current")).alias("intercept"),
        trended(round_n(project(F.col("_used"), F.col("_slope"), F.col("_intercept"), horizon), 6), F.col("current")).alias("projected_value"),
        trended(round_n(F.col("_ewma"), 6), F.lit(0.0)).alias("ewma"),
        trended(round_n(F.col("_season"), 6)).alias("seasonal_baseline"),
        trended(round_n(deviation(F.col("current"), F.col("_season")), 4)).alias("deviation"),
        limit.alias("threshold"),
        trended(F.when(limit.isNotNull(), steps.isNotNull()), F.lit(False)).alias("will_breach"),
        trended(round_n(steps, 4)).alias("time_to_threshold"),
        trended(round_n(steps * window, 2)).alias("time_to_threshold_seconds"),
        F.when(enough, F.lit("")).otherwise(WITHHELD).alias("note"),
    )
