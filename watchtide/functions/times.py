"""Timestamps: normalisation, relative bounds and epoch-aligned buckets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import as_col, as_of_col, let, text_or_empty

# Accepted text forms, epoch unit limits and duration units.
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
PLAIN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]*)?$"
EPOCH = r"^-?[0-9]{1,19}$"
SECOND_LIMIT, MILLI_LIMIT, MICRO_LIMIT = 10**12, 10**15, 10**18
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def _text_ns(text: Column) -> Column:
    """Nanoseconds since the epoch of a date-time text, NULL when it does not parse."""
    stamp = F.try_to_timestamp(F.regexp_replace(F.upper(text), r"\.$", ""))
    fraction = F.rpad(F.regexp_extract(text, r"\.([0-9]+)", 1), 9, "0")
    below_micro = F.coalesce(F.substring(fraction, 7, 3).try_cast("int"), F.lit(0))
    return F.try_add(F.try_multiply(F.unix_micros(stamp), F.lit(1000)), below_micro)


def _epoch_ns(text: Column) -> Column:
    number = text.try_cast("bigint")
    size = F.abs(number)
    return (
        F.when(size < SECOND_LIMIT, F.try_multiply(number, F.lit(10**9)))
        .when(size < MILLI_LIMIT, F.try_multiply(number, F.lit(10**6)))
        .when(size < MICRO_LIMIT, F.try_multiply(number, F.lit(1000)))
        .otherwise(number)
    )


def normalize_timestamp_ns(column, as_of) -> Column:
    """Nanoseconds since the epoch of a timestamp given as text.

    Accepts RFC 3339, ``YYYY-MM-DD HH:MM:SS[.f]`` in UTC and whole epoch numbers whose unit
    follows from their size. Everything else becomes ``as_of``.
    """
    fallback = F.unix_micros(as_of_col(as_of)) * 1000
    return let(
        F.trim(text_or_empty(column)),
        lambda t: F.coalesce(
            F.when(t.rlike(EPOCH), _epoch_ns(t)).when(t.rlike(RFC3339) | t.rlike(PLAIN), _text_ns(t)),
            fallback,
        ),
    )


def ns_to_timestamp(ns) -> Column:
    return F.timestamp_micros(F.floor(as_col(ns) / F.lit(1000).cast("decimal(20,0)")).cast("bigint"))


def normalize_timestamp(column, as_of) -> Column:
    return ns_to_timestamp(normalize_timestamp_ns(column, as_of))


def duration_seconds(text: str) -> int:
    match = re.fullmatch(r"([0-9]+)([smhd])", text)
    if not match:
        raise ValueError(f"bad duration {text!r}; write a number and one of s, m, h, d")
    return int(match[1]) * UNIT_SECONDS[match[2]]


def rel(as_of, offset: str = "") -> Column:
    """``as_of`` moved by a signed duration such as ``-1h``."""
    base = as_of_col(as_of)
    if not offset:
        return base
    sign = -1 if offset[0] == "-" else 1
    return base + F.make_dt_interval(secs=F.lit(sign * duration_seconds(offset.lstrip("+-"))))


def bucket_seconds(column, seconds: int) -> Column:
    """Epoch second at which the tumbling bucket of a timestamp starts."""
    epoch = F.unix_seconds(as_col(column))
    return epoch - F.pmod(epoch, F.lit(int(seconds)).cast("bigint"))


def time_bucket(column, seconds: int) -> Column:
    return F.timestamp_seconds(bucket_seconds(column, seconds))


def trailing(column, as_of, seconds: int, inclusive: bool = False) -> Column:
    """``as_of - seconds < column <= as_of``, as two bounds the scan can push down.

    ``inclusive`` lets the older edge in.
    """
    end = as_of_col(as_of)
    start = end - F.make_dt_interval(secs=F.lit(int(seconds)))
    older = as_col(column) >= start if inclusive else as_col(column) > start
    return older & (as_col(column) <= end)
