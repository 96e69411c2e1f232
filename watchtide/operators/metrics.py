"""Metric selectors, rates, aggregation across series, rollups and series output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import at_seconds, epoch_seconds
from ..functions.fields import canonical_labels, metric_label, series_key
from ..functions.times import bucket_seconds, trailing
from ..plans.sweep import paged
from .scope import tenant_scope

# Default lookback, step and cardinality cap.
LOOKBACK = 300
RANGE_DEFAULT = (3600, 60)
CARDINALITY_CAP = 50_000
# Points of one page of a series.
PAGE = 10_000
SERIES = ["service", "environment", "attributes"]
AGGREGATIONS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def label_matcher(name: str, op: str, value: str) -> Column:
    """One matcher; regular expressions match the whole label and a missing label reads as ``''``."""
    left = metric_label(name)
    if op == "=":
        return left == value
    if op == "!=":
        return left != value
    if op in ("=~", "!~"):
        matched = left.rlike(f"^(?:{value})$")
        return matched if op == "=~" else ~matched
    raise ValueError(f"unsupported matcher {op!r}")


def label_matchers(df: DataFrame, matchers) -> DataFrame:
    for name, op, value in matchers:
        df = df.filter(label_matcher(name, op, value))
    return df


def _samples(df: DataFrame, tenant: str, metric: str, matchers, start: int, end: int) -> DataFrame:
    rows = tenant_scope(df, tenant).filter(F.col("metric_name") == metric)
    rows = rows.filter((F.col("timestamp") >= at_seconds(start)) & (F.col("timestamp") <= at_seconds(end)))
    return label_matchers(rows, matchers)


def _latest(df: DataFrame) -> Column:
    ns = F.col("ts_ns") if "ts_ns" in df.columns else F.unix_micros("timestamp")
    return F.max_by("value", F.struct(ns, F.col("id")))


def _per_series(df: DataFrame, metric: str, step: int, value: Column) -> DataFrame:
    grouped = df.groupBy(*SERIES, bucket_seconds("timestamp", step).alias("bucket"))
    return grouped.agg(value.alias("value")).withColumn("metric_name", F.lit(metric))


def instant_vector(
    metrics: DataFrame, tenant: str, metric: str, matchers=(), at=None, lookback: int = LOOKBACK, latest_only: bool = False,
) -> DataFrame:
    """The latest sample per series and lookback-wide bucket in ``[at - lookback, at]``.

    A window that straddles two epoch-aligned buckets yields two rows per series, as the reference
    time decides; ``latest_only`` keeps just the newest.
    """
    end = epoch_seconds(at)
    lookback = lookback if lookback > 0 else LOOKBACK
    rows = _samples(metrics, tenant, metric, matchers, end - lookback, end)
    vector = _per_series(rows, metric, lookback, _latest(metrics))
    if not latest_only:
        return vector
    newest = vector.groupBy(*SERIES).agg(F.max_by("value", "bucket").alias("value"), F.max("bucket").alias("bucket"))
    return newest.withColumn("metric_name", F.lit(metric))


def _range(start, end, step: int | None) -> tuple[int, int, int]:
    stop = epoch_seconds(end)
    begin = epoch_seconds(start) if start is not None else stop - RANGE_DEFAULT[0]
    step = RANGE_DEFAULT[1] if step is None else step
    if stop <= begin or step <= 0:
        raise ValueError("need end > start and step > 0")
    return begin, stop, step


def range_vector(metrics: DataFrame, tenant: str, metric: str, matchers=(), start=None, end=None, step: int | None = None) -> DataFrame:
    """The latest sample per series and step bucket; buckets without samples are absent."""
    begin, stop, step = _range(start, end, step)
    return _per_series(_samples(metrics, tenant, metric, matchers, begin, stop), metric, step, _latest(metrics))


def counter_rate(
    metrics: DataFrame, tenant: str, metric: str, matchers=(), start=None, end=None, step: int | None = None,
    range_sec: int | None = None,
) -> DataFrame:
    """``(max - min) / range`` per series and step bucket; no reset handling, no extrapolation."""
    begin, stop, step = _range(start, end, step)
    seconds = range_sec if range_sec and range_sec > 0 else step
    spread = (F.max("value") - F.min("value")) / F.lit(float(seconds))
    return _per_series(_samples(metrics, tenant, metric, matchers, begin, stop), metric, step, spread)


def aggregate_by(vector: DataFrame, fn: str, by=()) -> DataFrame:
    """Aggregate a vector across series; with no labels everything becomes one series."""
    if fn not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {fn!r}")
    keys = [metric_label(name).alias(name) for name in by]
    value = F.count(F.lit(1)).cast("double") if fn == "count" else AGGREGATIONS[fn]("value")
    return vector.groupBy(*keys, "bucket").agg(value.alias("value"))


def _series_labels(df: DataFrame) -> Column:
    """Every label of a vector row as one map, the metric name stamped as ``__name__``."""
    names = [c for c in df.columns if c not in ("attributes", "bucket", "value", "metric_name", "__name__")]
    pairs = [x for c in names for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    if "metric_name" in df.columns or "__name__" in df.columns:
        source = "metric_name" if "metric_name" in df.columns else "__name__"
        pairs += [F.lit("__name__"), F.col(source)]
    fixed = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    if "attributes" not in df.columns:
        return fixed
    taken = [*names, "__name__"]
    return F.map_concat(F.map_filter("attributes", lambda k, _: ~k.isin(taken)), fixed)


def _finite(df: DataFrame) -> DataFrame:
    return df.filter(~F.isnan("value") & (F.abs("value") != float("inf")))


def to_matrix(vector: DataFrame, page_size: int = PAGE) -> DataFrame:
    """Series as pages of ordered ``[ts, value]`` points.

    A series is as many rows as it has pages: the lists of ``page`` 0, 1, ... follow each other and all but the
    last hold ``page_size`` points.
    """
    rows = _finite(vector).withColumn("metric", _series_labels(vector))
    points = rows.select(
        series_key(F.col("metric")).alias("series_key"), canonical_labels(F.col("metric")).alias("metric"),
        F.struct(F.col("bucket").alias("ts"), F.col("value").alias("value")).alias("point"), (F.col("bucket").cast("bigint") * 1_000_000).alias("_us"),
    )
    return paged(points, ["series_key"], "_us", ["point"], page_size).groupBy("series_key", "page").agg(
        F.map_from_entries(F.first("metric", ignorenulls=True)).alias("metric"),
        F.array_sort(F.collect_list("point")).alias("values"),
    )


def to_vector(vector: DataFrame) -> DataFrame:
    """One ``[ts, value]`` per row with its label set."""
    rows = _finite(vector).withColumn("_labels", _series_labels(vector))
    return rows.select(
        series_key(F.col("_labels")).alias("series_key"),
        F.map_from_entries(canonical_labels(F.col("_labels"))).alias("metric"),
        F.struct(F.col("bucket").alias("ts"), F.col("value").alias("value")).alias("value"),
    )


def label_cardinality(metrics: DataFrame, as_of, window: int = 3600) -> DataFrame:
    """Distinct label sets per tenant and metric in the trailing hour.

    Distinct first, count second: a metric with very many series spreads over all tasks.
    """
    recent = metrics.filter(trailing("timestamp", as_of, window))
    sets = recent.select("tenant_id", "metric_name", F.array_sort(F.map_entries("attributes")).alias("_labels")).distinct()
    return sets.groupBy("tenant_id", "metric_name").agg(F.count(F.lit(1)).alias("cardinality"))


def assert_cardinality(metrics: DataFrame, tenant: str, metric: str, as_of, cap: int = CARDINALITY_CAP) -> int:
    """The metric's cardinality, or an error above the cap. Runs one small action."""
    rows = tenant_scope(metrics, tenant).filter(F.col("metric_name") == metric)
    found = label_cardinality(rows, as_of).first()
    count = found["cardinality"] if found else 0
    if count > cap:
        raise ValueError(f"metric {metric!r} has {count} label sets in the last hour; the cap is {cap}")
    return count


ROLLUP_KEYS = ["tenant_id", "service", "environment", "metric_name", "metric_type", "attributes"]
GRAIN_SECONDS = {"5 minutes": 300, "1 hour": 3600}


def _grain(grain: str | int) -> int:
    if isinstance(grain, int):
        return grain
    if grain not in GRAIN_SECONDS:
        raise ValueError(f"unknown grain {grain!r}; expected one of {', '.join(GRAIN_SECONDS)}")
    return GRAIN_SECONDS[grain]


def _rollup_keys() -> list[Column]:
    """Series keys with labels in canonical order, so equal label sets group whatever their order."""
    labels = F.map_from_entries(F.array_sort(F.map_entries("attributes"))).alias("attributes")
    return [F.col(k) for k in ROLLUP_KEYS[:-1]] + [labels]


def rollup_metrics(metrics: DataFrame, grain: str | int = "5 minutes") -> DataFrame:
    """Mergeable per-bucket states of every series."""
    bucket = F.timestamp_seconds(bucket_seconds("timestamp", _grain(grain))).alias("bucket")

    def total(name: str, kind: str) -> Column:
        return F.sum(F.col(name) if name in metrics.columns else F.lit(0).cast(kind))

    return metrics.groupBy(*_rollup_keys(), bucket).agg(
        F.sum("value").alias("value_sum"),
        F.min("value").alias("value_min"),
        F.max("value").alias("value_max"),
        F.count(F.lit(1)).alias("sample_count"),
        total("count", "bigint").alias("histo_count"),
        total("sum", "double").alias("histo_sum"),
    )


def merge_rollup(rollup: DataFrame, grain: str | int = "1 hour") -> DataFrame:
    """Coarser buckets from finer states."""
    bucket = F.timestamp_seconds(bucket_seconds("bucket", _grain(grain))).alias("bucket")
    return rollup.groupBy(*_rollup_keys(), bucket).agg(
        F.sum("value_sum").alias("value_sum"),
        F.min("value_min").alias("value_min"),
        F.max("value_max").alias("value_max"),
        F.sum("sample_count").alias("sample_count"),
        F.sum("histo_count").alias("histo_count"),
        F.sum("histo_sum").alias("histo_sum"),
    )


def read_rollup(rollup: DataFrame) -> DataFrame:
    """States as final values: the average is the sum over the sample count."""
    return rollup.withColumn("value_avg", F.col("value_sum") / F.col("sample_count"))
