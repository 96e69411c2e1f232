"""Exact quantiles of whole-number values without collecting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A value is binned by its leading bits, so one bin spans at most 1/1024 of the value itself and
# one key has at most about 54 000 bins, whatever the number of rows.
_BITS = 10


def _bin(value: Column) -> Column:
    """Lower edge of the bin: the value with all but its leading bits cleared."""
    guess = F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double"))).cast("int")
    one = F.lit(1).cast("bigint")
    exponent = (
        F.when(F.call_function("shiftleft", one, guess) > value, guess - 1)
        .when((guess < 61) & (F.call_function("shiftleft", one, guess + 1) <= value), guess + 1)
        .otherwise(guess)
    )
    drop = F.greatest(exponent - _BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def exact_quantile(
    df: DataFrame, by: list[str], value: str, p: float, name: str, count: str | None = None, flags: dict[str, Column] | None = None
) -> DataFrame:
    """``by`` and the linearly interpolated ``p`` quantile of a non-negative whole-number column.

    ``count`` adds the number of rows and ``flags`` how many rows meet a condition, out of the same pass.
    Rows without a value count but have no rank; a key without any value has a NULL quantile.

    Rows are first counted per (key, value), which spreads a heavy key by its values. The bin
    holding the wanted rank comes from the bin counts; only that bin's values are then ranked.
    """
    flags = flags or {}
    # flags are grouping keys, so both uses of the counts below share one shuffle
    keys = [*by, F.col(value).cast("bigint").alias("_v"), *[F.coalesce(test, F.lit(False)).alias(c) for c, test in flags.items()]]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bins = counts.groupBy(*by, _bin(F.col("_v")).alias("_bin")).agg(
        F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0)).alias("_n"), F.sum("_n").alias("_all"),
        *[F.coalesce(F.sum(F.when(F.col(c), F.col("_n"))), F.lit(0)).alias(c) for c in flags],
    )
    # the rows without a value are the first bin, which holds no rank
    in_order = Window.partitionBy(*by).orderBy(F.col("_bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    rank = (F.sum("_n").over(whole) - 1) * F.lit(float(p))
    totals = {count: F.sum("_all").over(whole)} if count else {}
    totals |= {c: F.sum(c).over(whole) for c in flags}
    placed = bins.select(
        *by, "_bin", F.sum("_n").over(in_order).alias("_upto"), "_n", rank.alias("_rank"), *[t.alias(c) for c, t in totals.items()]
    )
    low, high = F.floor("_rank"), F.ceil("_rank")
    wanted = placed.withColumn("_below", F.col("_upto") - F.col("_n")).filter(
        ((low >= F.col("_below")) & (low < F.col("_upto"))) | ((high >= F.col("_below")) & (high < F.col("_upto")))
    )
    inside = counts.select(*by, "_v", "_n", _bin(F.col("_v")).alias("_bin")).join(
        wanted.select(*by, "_bin", "_below", "_rank", *totals), [*by, "_bin"]
    )
    ordered = Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inside.withColumn("_end", F.col("_below") + F.sum("_n").over(ordered)).withColumn(
        "_start", F.col("_end") - F.col("_n")
    )

    def at(position: Column) -> Column:
        return F.max(F.when((position >= F.col("_start")) & (position < F.col("_end")), F.col("_v"))).cast("double")

    picked = ranked.groupBy(*by).agg(
        at(low).alias("_lo"), at(high).alias("_hi"), F.max("_rank").alias("_rank"), *[F.max(c).alias(c) for c in totals]
    )
    ranked_keys = picked.select(
        *by,
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_rank") - F.floor("_rank"))).alias(name),
        *totals,
    )
    valueless = placed.filter(F.col("_bin").isNull() & (F.col("_rank") == F.lit(-float(p)))).select(*by, F.lit(None).cast("double").alias(name), *totals)
    return ranked_keys.unionByName(valueless)
