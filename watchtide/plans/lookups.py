"""Attaching a lookup table to a large one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64


def attach(left: DataFrame, lookup: DataFrame, on: list[str], values: list[str], spread_by: str | None = None) -> DataFrame:
    """Left join of a lookup with one row per key.

    Whether the lookup is small enough to broadcast is left to Spark, which knows its bytes, and so is
    splitting heavy keys of the large side. ``spread_by`` spreads them beforehand, by repeating each lookup
    row ``SALTS`` times.
    """
    lookup, keys = lookup.select(*on, *values), list(on)
    if spread_by:
        left = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
        lookup = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keys.append("_salt")
    return left.join(lookup, keys, "left").drop("_salt")
