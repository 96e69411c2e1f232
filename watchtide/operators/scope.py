"""Tenant guard, projection, predicates and bounded ordering."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import limited
from ..functions.fields import json_field, label
from ..functions.levels import ORDERINGS, level_cmp
from ..schemas import DEFAULT_PROJECTION, check_table, signal_schema

AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def tenant_scope(df: DataFrame, tenant: str) -> DataFrame:
    """Only the caller's rows; every per-tenant operator starts here."""
    return df.filter(F.col("tenant_id") == F.lit(tenant))


def resolve_field(table: str, name: str) -> Column:
    """The column a field name stands for; unknown names are an error.

    Dotted names read JSON text (``body.a.b``, ``resource.x``, ``attributes.x`` on traces), metric
    labels (``attributes.k``) or identity columns (``auth.c``).
    """
    columns = set(signal_schema(check_table(table)).names)
    head, _, path = name.partition(".")
    head = head.lower()
    if not path:
        head = {"time": "timestamp", "tenant": "tenant_id"}.get(head, head)
        if head not in columns:
            raise ValueError(f"unknown field {name!r} on {table}")
        return F.col(head)
    if head == "body" and table == "logs":
        return json_field("body", path)
    if head == "resource" and table != "auth_events":
        return json_field("resource", path)
    if head in ("attr", "attribute", "attributes"):
        if table == "traces":
            return json_field("attributes", path)
        if table == "metrics" and "." not in path:
            return label(path)
    if head == "auth" and table == "auth_events":
        return auth_field(path)
    raise ValueError(f"unknown field {name!r} on {table}")


def auth_field(name: str) -> Column:
    """An identity-event column; anything outside the table's schema is an error."""
    if name.lower() not in signal_schema("auth_events").names:
        raise ValueError(f"unknown auth field {name!r}")
    return F.col(name.lower())


def pred(table: str, field: str, op: str, value) -> Column:
    """One comparison. A tenant predicate is always true here: the guard alone decides the tenant."""
    if op == "==":
        op = "="
    if op not in ORDERINGS:
        raise ValueError(f"unknown comparison {op!r}")
    lowered = field.lower()
    if lowered in ("tenant", "tenant_id"):
        return F.lit(True)
    if lowered == "level" and isinstance(value, str):
        return level_cmp(op, value)
    right = value if isinstance(value, Column) else F.lit(value)
    return ORDERINGS[op](resolve_field(table, field), right)


def all_of(*predicates: Column) -> Column:
    return functools.reduce(operator.and_, predicates, F.lit(True))


def any_of(*predicates: Column) -> Column:
    return functools.reduce(operator.or_, predicates, F.lit(False))


def select_fields(df: DataFrame, table: str, items=("*",)) -> DataFrame:
    """Project fields. An item is a name or a ``(name, alias)`` pair; ``*`` is the default projection."""
    columns = []
    for item in items:
        name, alias = item if isinstance(item, tuple) else (item, None)
        if name == "*":
            columns += [F.col(c) for c in DEFAULT_PROJECTION[table] if c in df.columns]
        else:
            columns.append(resolve_field(table, name).alias(alias or name.split(".")[-1]))
    return df.select(*columns)


def select_aggregate(
    df: DataFrame,
    table: str,
    tenant: str,
    aggs,
    group_by=(),
    where: Column | None = None,
    order_by=None,
    descending: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Grouped aggregates of one table for one tenant.

    ``aggs`` holds ``(function, field)`` or ``(function, field, alias)``; only ``count`` takes ``*``.
    ``group_by`` holds fields or ``(field, alias)``. ``order_by`` names an output column. All groups
    come back unless ``limit`` asks for the first few.
    """
    scoped = tenant_scope(df, tenant)
    if where is not None:
        scoped = scoped.filter(where)
    outputs = []
    for spec in aggs:
        fn, field, *alias = spec
        if fn not in AGGREGATES:
            raise ValueError(f"unknown aggregate {fn!r}")
        if field == "*":
            if fn != "count":
                raise ValueError(f"{fn}(*) is not an aggregate")
            outputs.append(F.count(F.lit(1)).alias(alias[0] if alias else "count"))
        else:
            name = alias[0] if alias else f"{fn}_{field.split('.')[-1]}"
            outputs.append(AGGREGATES[fn](resolve_field(table, field)).alias(name))
    keys = []
    for item in group_by:
        field, alias = item if isinstance(item, tuple) else (item, item.split(".")[-1])
        keys.append(resolve_field(table, field).alias(alias))
    grouped = scoped.groupBy(*keys).agg(*outputs)
    return bounded_order(grouped, order_by, descending, limit)


def bounded_order(df: DataFrame, order_by=None, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Order by one column, ties by the remaining columns, and keep the first ``limit`` rows, or all.

    With a limit and no column, all columns in turn decide which rows those are.
    """
    if order_by is None:
        if limit is None:
            return df
        order_by = next(f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant"))
    first = F.col(order_by).desc() if descending else F.col(order_by).asc()
    ties = [F.col(f.name) for f in df.schema.fields if f.name != order_by and f.dataType.typeName() not in ("map", "variant")]
    return limited(df.orderBy(first, *ties), limit)


def select_rows(
    df: DataFrame, table: str, tenant: str, items=("*",), where: Column | None = None,
    order_by=None, descending: bool = False, limit: int | None = None,
) -> DataFrame:
    """Plain listing of one table for one tenant; all rows unless ``limit`` is given."""
    scoped = tenant_scope(df, tenant)
    if where is not None:
        scoped = scoped.filter(where)
    if order_by is None and limit is not None:
        order_by = "id" if "id" in df.columns else "timestamp"
    if order_by is not None:
        first = resolve_field(table, order_by)
        ties = [F.col("id")] if "id" in df.columns else []
        scoped = scoped.orderBy(first.desc() if descending else first.asc(), *ties)
    return select_fields(limited(scoped, limit), table, items)
