"""Small column helpers shared by everything else."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body`` without repeating its cost."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(column) -> Column:
    return F.coalesce(as_col(column), F.lit(""))


def blank_to_null(column) -> Column:
    return F.nullif(as_col(column), F.lit(""))


def as_of_col(as_of) -> Column:
    """The reference time as a whole-second timestamp column.

    Naive datetimes and strings are UTC.
    """
    if isinstance(as_of, Column):
        return F.date_trunc("second", as_of)
    return F.timestamp_seconds(F.lit(epoch_seconds(as_of)))


def epoch_seconds(as_of) -> int:
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of.replace("Z", "+00:00"))
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    return int(as_of.timestamp())


def at_seconds(seconds: int) -> Column:
    return F.timestamp_seconds(F.lit(int(seconds)))


def round_n(value: Column, digits: int) -> Column:
    """Half away from zero on the scaled double, as ``round(x * 10^n) / 10^n``."""
    scale = float(10**digits)
    return F.round(value * F.lit(scale)) / F.lit(scale)


def clamp01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def bounded_limit(limit: int | None, default: int | None = None, maximum: int | None = None) -> int | None:
    """The rows to keep: a missing limit takes the default, and no default means all.

    A limit is honoured exactly or refused: one below 1 or above the maximum is an error.
    """
    limit = default if limit is None else limit
    if limit is not None and (limit < 1 or (maximum is not None and limit > maximum)):
        raise ValueError(f"limit {limit} is not between 1 and {maximum or 'any number'}")
    return limit


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows, or all."""
    limit = bounded_limit(limit)
    return df if limit is None else df.limit(limit)


def settled(value: Column) -> Column:
    """``value``, computed where it stands.

    Spark copies a column's definition into every filter above it. For the result of a long chain of
    steps that means computing the chain once more per mention, so the chain ends in a value the
    optimizer does not copy. A random number compared with a constant as it is would not do: Spark
    knows that ``rand() >= 0`` always holds and drops it.
    """
    return F.when(F.rand(0) + 1 > 0, value)
