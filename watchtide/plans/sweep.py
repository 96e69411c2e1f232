"""Ordered scans over time, cut into (key, time slice) groups.

A running total or an as-of lookup needs its rows in time order. Partitioning the window by
key alone would put a heavy key into one task, so the window runs per key *and* time slice, and
what earlier slices contribute is carried in as one extra row at the start of each slice. The
carried rows come from an aggregate per slice, combined before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_SECONDS = 3600
_BEFORE_ALL = -(2**63) + 1


def _slices(us: Column, seconds: int) -> Column:
    return F.floor(us / F.lit(float(seconds) * 1e6)).cast("bigint")


def running_totals(
    df: DataFrame, by: list[str], us: str, order: list[str], totals: list[str], slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Inclusive running sums ``run_<name>`` of the ``totals`` columns, ordered by (us, order)."""
    rows = df.withColumn("_slice", _slices(F.col(us), slice_seconds)).withColumn("_carry", F.lit(False))
    per_slice = rows.groupBy(*by, "_slice").agg(*[F.sum(c).alias(c) for c in totals])
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(
        *by,
        "_slice",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in totals],
        F.lit(_BEFORE_ALL).alias(us),
        F.lit(True).alias("_carry"),
    )
    inside = (
        Window.partitionBy(*by, "_slice").orderBy(us, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.unionByName(carried, allowMissingColumns=True)
        .select("*", *[F.sum(c).over(inside).alias(f"run_{c}") for c in totals])
        .filter(~F.col("_carry"))
        .drop("_slice", "_carry")
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_ts: str,
    right_ts: str,
    values: list[str],
    forward: bool = False,
    strict: bool = False,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Each left row with the ``values`` of its nearest right row in time, NULL when there is none.

    Backward takes the latest right row at or before the left row, forward the earliest at or
    after it; ``strict`` leaves out equal instants. Of several right rows at one instant the
    greatest ``values`` win. ``right_ts`` comes along when listed in ``values``.
    """
    sign = -1 if forward else 1
    match = F.struct(*[F.col(c) for c in values])
    hits = (
        right.withColumn("_us", F.unix_micros(F.col(right_ts)) * sign)
        .filter(F.col("_us").isNotNull())
        .groupBy(*by, "_us")
        .agg(F.max(match).alias("_match"))
        .withColumn("_side", F.lit(2 if strict else 0))
        .withColumn("_slice", _slices(F.col("_us"), slice_seconds))
    )
    probes = (
        left.withColumn("_row", F.struct(*[F.col(c) for c in left.columns]))
        .withColumn("_us", F.unix_micros(F.col(left_ts)) * sign)
        .select(*by, "_row", "_us", F.lit(1).alias("_side"), _slices(F.col("_us"), slice_seconds).alias("_slice"))
    )
    last_in_slice = hits.groupBy(*by, "_slice").agg(F.max_by("_match", "_us").alias("_match"))
    touched = probes.select(*by, "_slice").distinct().unionByName(last_in_slice, allowMissingColumns=True)
    earlier = Window.partitionBy(*by).orderBy("_slice").rangeBetween(Window.unboundedPreceding, -1)
    carried = (
        touched.withColumn("_match", F.last("_match", ignorenulls=True).over(earlier))
        .filter(F.col("_match").isNotNull())
        .groupBy(*by, "_slice")
        .agg(F.first("_match").alias("_match"))
        .select(*by, "_slice", "_match", F.lit(_BEFORE_ALL).alias("_us"), F.lit(0).alias("_side"))
    )
    inside = (
        Window.partitionBy(*by, "_slice")
        .orderBy("_us", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        probes.unionByName(hits, allowMissingColumns=True)
        .unionByName(carried, allowMissingColumns=True)
        .withColumn("_found", F.last("_match", ignorenulls=True).over(inside))
        .filter(F.col("_side") == 1)
        .select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in values])
    )


def paged(rows: DataFrame, by: list[str], us: str, order: list[str], size: int) -> DataFrame:
    """``rows`` with ``page``, from 0: every ``size`` rows of a key in the order of (us, order) are a page."""
    if size < 1:
        raise ValueError("a page holds at least one row")
    numbered = running_totals(rows.withColumn("_row", F.lit(1).cast("bigint")), by, us, order, ["_row"])
    return numbered.withColumn("page", F.floor((F.col("run__row") - 1) / F.lit(size)).cast("bigint")).drop("_row", "run__row")
