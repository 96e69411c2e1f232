"""Top rows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basics import limited


def top_n_per_group(df: DataFrame, by: list[str], order: list[Column], n: int | None, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group.

    Spark trims every map task to ``n`` rows per group ahead of the shuffle (WindowGroupLimit), so a
    heavy group never travels whole. ``rank`` keeps the 1-based position under that name. Without ``n``
    all rows stay.
    """
    if n is None and rank is None:
        return df
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    ranked = ranked if n is None else ranked.filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def keep_last_n(df: DataFrame, newest: list[Column], oldest: list[Column], n: int | None) -> DataFrame:
    """The newest ``n`` rows of a feed, or all of it, shown oldest first."""
    return (df if n is None else limited(df.orderBy(*newest), n)).orderBy(*oldest)
