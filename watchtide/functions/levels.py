"""Log levels and severities."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import as_col, text_or_empty

# Severity order, accepted spellings and numeric severity bands.
LEVELS = ["trace", "debug", "info", "warn", "error", "fatal"]
LEVEL_SPELLINGS = {
    "trace": ["trace"],
    "debug": ["debug", "dbg"],
    "warn": ["warn", "warning"],
    "error": ["err", "error"],
    "fatal": ["fatal", "critical", "crit", "panic", "emergency"],
}
SYSLOG_LEVELS = ["fatal", "fatal", "fatal", "error", "warn", "info", "info", "debug"]
ROUTING_RANKS = {
    "trace": 0, "debug": 1, "info": 2, "warn": 3, "warning": 3,
    "error": 4, "err": 4, "fatal": 5, "critical": 5, "crit": 5,
}

ORDERINGS = {
    "=": operator.eq, "!=": operator.ne,
    "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
}


def normalize_level(column) -> Column:
    """Trim, lower-case and fold spellings; anything unknown is ``info``."""
    raw = F.lower(F.trim(text_or_empty(column)))
    out = F.lit("info")
    for level, spellings in LEVEL_SPELLINGS.items():
        out = F.when(raw.isin(spellings), level).otherwise(out)
    return out


def level_rank(column) -> Column:
    """1-based severity; 0 for an unknown level. Case-sensitive."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), as_col(column)), F.lit(0)).cast("int")


def level_cmp(op: str, level: str, column="level") -> Column:
    """Compare a stored level with ``level``: ordering by severity, equality by text."""
    if op in ("=", "!="):
        return ORDERINGS[op](as_col(column), F.lit(level))
    return by_rank(lambda rank: ORDERINGS[op](rank, LEVELS.index(level) + 1 if level in LEVELS else 0), column)


def by_rank(holds, column="level") -> Column:
    """Whether ``holds`` of the level's rank (0 for unknown levels and NULL), as a list of levels that a
    Parquet scan can use."""
    stored = as_col(column)
    if holds(0):
        return stored.isNull() | ~stored.isin([v for i, v in enumerate(LEVELS, 1) if not holds(i)])
    return stored.isNotNull() & stored.isin([v for i, v in enumerate(LEVELS, 1) if holds(i)])


def level_at_least(level: str, column="level") -> Column:
    """Severity at or above ``level``; an unknown level is below all."""
    return level_cmp(">=", level, column)


def tail_level_rank(column) -> Column:
    """Live-tail ranking: case-insensitive, 0-based, -1 for unknown."""
    return level_rank(F.lower(as_col(column))) - 1


def syslog_level(severity: Column) -> Column:
    names = F.array(*map(F.lit, SYSLOG_LEVELS))
    return F.element_at(names, F.least(F.greatest(severity.cast("int"), F.lit(0)), F.lit(7)) + 1)


def otlp_level(number: Column) -> Column:
    """OTLP severity numbers 1-24 come in bands of four; outside them the level is ``info``."""
    names = F.array(*map(F.lit, LEVELS))
    band = ((number.cast("int") - 1) / 4).cast("int") + 1
    return F.when(number.between(1, 24), F.element_at(names, band)).otherwise("info")


def routing_rank(column: Column) -> Column:
    pairs = [F.lit(x) for item in ROUTING_RANKS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.lower(column))
