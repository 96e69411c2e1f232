"""Fixed schemas of the five signal tables and their rollups.

Signal columns are never NULL: an absent value is the column's default. Nanosecond
sidecars (``ts_ns``) keep the digits a Spark timestamp cannot hold.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names, types and defaults of the stored signals.
_LOGS = """
    id string '' | timestamp timestamp - | ts_ns bigint 0 | received_at timestamp -
    tenant_id string '' | service string 'unknown' | environment string '' | level string 'info'
    message string '' | body string '{}' | resource string '{}' | trace_id string '' | span_id string ''
    git_sha string '' | deploy_id string '' | pr_number string ''
    k8s_namespace string '' | k8s_pod string '' | k8s_node string ''
    user_linkage_key string '' | pii_detected array<string> [] | ingested_by string 'http'
    _retention_days int 7
"""
_METRICS = """
    id string '' | timestamp timestamp - | ts_ns bigint 0 | start_timestamp timestamp 0 | received_at timestamp -
    tenant_id string '' | service string 'unknown' | environment string ''
    metric_name string '' | metric_type string 'gauge' | unit string '' | description string ''
    temporality string '' | is_monotonic int 0 | value double 0
    attributes map<string,string> {} | resource string '{}'
    count bigint 0 | sum double 0 | min double 0 | max double 0
    bucket_counts array<bigint> [] | explicit_bounds array<double> [] | scale int 0 | zero_count bigint 0
    positive_offset int 0 | positive_buckets array<bigint> []
    negative_offset int 0 | negative_buckets array<bigint> []
    _retention_days int 30
"""
_TRACES = """
    id string '' | timestamp timestamp - | ts_ns bigint 0 | received_at timestamp -
    tenant_id string '' | service string 'unknown' | environment string ''
    trace_id string '' | span_id string '' | parent_span_id string '' | name string ''
    kind string 'internal' | start_time timestamp - | end_time timestamp - | duration_ns bigint 0
    status_code string 'unset' | status_message string ''
    attributes string '{}' | resource string '{}' | scope_name string '' | scope_version string '' | trace_state string ''
    git_sha string '' | deploy_id string '' | pr_number string ''
    k8s_namespace string '' | k8s_pod string '' | k8s_node string ''
    _retention_days int 30
"""
_AUTH_EVENTS = """
    id string '' | timestamp timestamp - | ts_ns bigint 0 | received_at timestamp -
    tenant_id string '' | event_type string '' | auth_method string '' | user_id string '' | session_id string ''
    error_code string '' | attempt_number bigint 0 | mfa_required int 0 | mfa_passed int 0
    ip_country string '' | ip_asn string '' | device_new int 0 | risk_score float 0
    user_linkage_key string '' | _retention_days int 90
"""
_CHANGE_EVENTS = """
    id string '' | timestamp timestamp - | ts_ns bigint 0 | received_at timestamp -
    tenant_id string '' | service string '' | environment string '' | kind string 'deploy' | title string ''
    git_sha string '' | deploy_id string '' | pr_number string '' | flag_key string '' | config_diff string ''
    author string '' | metadata string '{}' | _retention_days int 90
"""

# What a bare listing shows per table.
DEFAULT_PROJECTION = {
    "logs": ["id", "timestamp", "service", "level", "message", "trace_id", "span_id", "body"],
    "metrics": ["timestamp", "service", "metric_name", "metric_type", "value", "count", "sum", "attributes"],
    "traces": ["timestamp", "service", "name", "kind", "status_code", "duration_ns", "trace_id", "span_id"],
    "auth_events": ["id", "timestamp", "event_type", "auth_method", "user_id", "ip_country", "risk_score"],
    "change_events": [
        "timestamp", "service", "kind", "title", "git_sha", "deploy_id", "pr_number", "flag_key", "author",
    ],
}

# Sort order inside a stored partition, used for row-group skipping.
SORT_KEYS = {
    "logs": ["tenant_id", "service", "timestamp"],
    "metrics": ["tenant_id", "metric_name", "service", "timestamp"],
    "traces": ["tenant_id", "service", "timestamp"],
    "auth_events": ["tenant_id", "event_type", "timestamp"],
    "change_events": ["tenant_id", "service", "timestamp"],
}

PARTITION_COLUMNS = ["tenant_id", "yyyymm"]

# Retention of the two rollup grains in days.
ROLLUP_RETENTION_DAYS = {"5 minutes": 90, "1 hour": 365}


@functools.cache
def _parse(table: str) -> tuple[T.StructType, dict[str, str]]:
    fields, defaults = [], {}
    for part in _TABLES[check_table(table)].replace("\n", "|").split("|"):
        if not part.strip():
            continue
        name, kind, default = part.split()
        fields.append(T.StructField(name, T.DataType.fromDDL(kind), True))
        defaults[name] = default
    return T.StructType(fields), defaults


_TABLES = {
    "logs": _LOGS,
    "metrics": _METRICS,
    "traces": _TRACES,
    "auth_events": _AUTH_EVENTS,
    "change_events": _CHANGE_EVENTS,
}
SIGNAL_TABLES = tuple(_TABLES)


def check_table(table: str) -> str:
    if table not in _TABLES:
        raise ValueError(f"unknown table {table!r}; expected one of {', '.join(SIGNAL_TABLES)}")
    return table


def signal_schema(table: str) -> T.StructType:
    return _parse(table)[0]


def default_for(table: str, column: str) -> Column | None:
    """The default of a column, or None where a value is required (timestamps)."""
    schema, defaults = _parse(table)
    text, kind = defaults[column], schema[column].dataType
    if text == "-":
        return None
    if text == "[]":
        return F.array().cast(kind)
    if text == "{}" and isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_seconds(F.lit(int(text)))
    return F.lit(text.strip("'")).cast(kind)


def conform(df: DataFrame, table: str, keep=()) -> DataFrame:
    """Project ``df`` onto the stored schema: missing columns and NULLs become defaults.

    ``keep`` names further columns to leave in place.
    """
    columns = []
    for field in signal_schema(table).fields:
        default = default_for(table, field.name)
        if field.name in df.columns:
            value = F.col(field.name).cast(field.dataType)
            value = value if default is None else F.coalesce(value, default)
        elif field.name == "ts_ns" and "timestamp" in df.columns:
            value = F.unix_micros(F.col("timestamp").cast("timestamp")) * 1000
        elif default is not None:
            value = default
        elif field.name in ("received_at", "start_time", "end_time") and "timestamp" in df.columns:
            value = F.col("timestamp").cast("timestamp")
        else:
            value = F.lit(None).cast(field.dataType)
        columns.append(value.alias(field.name))
    return df.select(*columns, *keep)
