"""Canonical log, metric, span and change rows out of lenient input."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import as_of_col, blank_to_null, let, text_or_empty
from ..functions.fields import build_json, json_entries, json_text, linkage_key, quote_json, unquote_json
from ..functions.levels import normalize_level
from ..functions.masking import gate_texts, is_json_key, json_strings, put_json_strings
from ..functions.times import normalize_timestamp_ns, ns_to_timestamp
from ..schemas import conform

# Fields promoted out of a payload, and other spellings of the enrichment fields.
KNOWN_FIELDS = [
    "timestamp", "service", "level", "message", "environment", "trace_id", "span_id", "user_id",
    "git_sha", "deploy_id", "pr_number", "k8s_namespace", "k8s_pod", "k8s_node", "resource",
]
ENRICHMENT_KEYS = {
    "git_sha": ["git.sha", "vcs.revision", "commit", "commit_sha"],
    "deploy_id": ["deploy.id", "deployment.id", "release"],
    "pr_number": ["pr.number", "pull_request", "pr"],
    "k8s_namespace": ["k8s.namespace.name", "namespace"],
    "k8s_pod": ["k8s.pod.name", "pod"],
    "k8s_node": ["k8s.node.name", "node"],
}


@dataclass(frozen=True)
class IngestConfig:
    """Per-tenant ingest settings; the tenant comes from the row's ``tenant_id`` when it has one."""

    tenant_id: str | None = None
    retention_days: int | None = None
    masking_actions: dict = field(default_factory=dict)
    as_of: object = "1970-01-01T00:00:00Z"


def _tenant(df: DataFrame, cfg: IngestConfig) -> Column:
    if cfg.tenant_id is not None:
        return F.lit(cfg.tenant_id)
    return F.col("tenant_id")


def harvest_enrichment(explicit: Column, extra: Column, keys: list[str]) -> Column:
    """An explicit value, else the first non-empty alternate found in the extras (JSON text values)."""
    found = [blank_to_null(json_text(F.try_element_at(extra, F.lit(k)))) for k in keys]
    return F.coalesce(blank_to_null(explicit), *found, F.lit(""))


def _without_key(entries: Column, key: str, when: Column) -> Column:
    return F.map_filter(entries, lambda k, _: ~((k == key) & when))


def _without_harvested(extra: Column, explicit: dict[str, Column]) -> Column:
    """Extras minus the alternates that were read. An explicit value leaves its alternates alone.

    Alternates are read in order until one is non-empty; those after it stay in the body.
    """
    out = extra
    for name, keys in ENRICHMENT_KEYS.items():
        pending = blank_to_null(explicit[name]).isNull()
        for key in keys:
            value = blank_to_null(json_text(F.try_element_at(extra, F.lit(key))))
            out = _without_key(out, key, pending)
            pending = pending & value.isNull()
    return out


def payload_fields(df: DataFrame, column: str = "payload") -> DataFrame:
    """Known fields of a JSON payload as columns and the rest as ``extra``, a map to JSON text."""

    def split(entries: Column) -> Column:
        known = [
            (entries[name] if name == "resource" else json_text_or_null(entries[name])).alias(name) for name in KNOWN_FIELDS
        ]
        return F.struct(*known, F.map_filter(entries, lambda k, _: ~k.isin(KNOWN_FIELDS)).alias("extra"))

    kept = [c for c in df.columns if c not in (column, *KNOWN_FIELDS, "extra")]
    return df.withColumn("_fields", let(json_entries(column), split)).select(*kept, "_fields.*")


def json_text_or_null(token: Column) -> Column:
    return F.when(token.isNotNull() & (token != "null"), json_text(token))


def _texts(message: Column) -> Column:
    """The message and the decoded string values of the body; keys hold the place of an empty text."""
    values = F.transform("_tokens", lambda t: F.when(is_json_key(t), F.lit("")).otherwise(F.coalesce(unquote_json(t), F.lit(""))))
    return F.concat(F.array(text_or_empty(message)), values)


def _masked_tokens() -> Column:
    """The body's string literals, re-encoded where the gate changed them."""
    changed = F.zip_with(
        F.slice("_plain", F.lit(2), F.size("_tokens")),
        F.slice("_texts", F.lit(2), F.size("_tokens")),
        lambda old, new: F.when(old != new, quote_json(new)),
    )
    return F.zip_with("_tokens", changed, lambda token, new: F.coalesce(new, token))


def _identity(df: DataFrame) -> Column:
    """The given id, or a hash of all that the input row holds: a repeated task makes the same id again, and
    rows that agree in everything are one record."""
    if "id" in df.columns:
        return F.col("id")
    plain = [F.to_json(F.struct(F.col(f"`{c}`"))) if df.schema[c].dataType.typeName() != "map" else F.to_json(F.array_sort(F.map_entries(f"`{c}`"))) for c in df.columns]
    return F.sha2(F.concat_ws("|", *plain), 256)


def build_log_records(df: DataFrame, cfg: IngestConfig, ingested_by: str = "http") -> DataFrame:
    """Rows of the ``logs`` schema plus ``drop_record``.

    Input columns are the known payload fields (text, any may be missing) and ``extra``. The personal
    data gate runs over the message, then over every string of the body.
    """

    def given(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    extra = F.col("extra") if "extra" in df.columns else F.create_map().cast("map<string,string>")
    extra = F.coalesce(extra, F.create_map().cast("map<string,string>"))
    explicit = {name: given(name) for name in ENRICHMENT_KEYS}

    def harvest(entries: Column) -> Column:
        found = [harvest_enrichment(explicit[n], entries, keys).alias(n) for n, keys in ENRICHMENT_KEYS.items()]
        return F.struct(*found, build_json(_without_harvested(entries, explicit)).alias("body"))

    harvested = df.withColumns({"_ns": normalize_timestamp_ns(given("timestamp"), cfg.as_of), "_harvest": let(extra, harvest)})
    # The message and the strings of the body pass the gate together, the message first.
    listed = harvested.withColumn("_tokens", json_strings("_harvest.body")).withColumn("_plain", _texts(given("message")))
    gated = gate_texts(listed.withColumn("_texts", F.col("_plain")), "_texts", cfg.masking_actions)
    # a body without a change is as it was
    same = F.slice("_texts", F.lit(2), F.size("_tokens")) == F.slice("_plain", F.lit(2), F.size("_tokens"))
    body = F.when(same, F.col("_harvest.body")).otherwise(put_json_strings("_harvest.body", _masked_tokens()))
    staged = gated.withColumn("_body", body)
    days = F.lit(cfg.retention_days) if cfg.retention_days is not None else F.lit(None).cast("int")
    identity = _identity(df)
    columns = {
        "id": identity,
        "timestamp": ns_to_timestamp("_ns"),
        "ts_ns": F.col("_ns"),
        "received_at": as_of_col(cfg.as_of),
        "tenant_id": _tenant(df, cfg),
        "service": F.coalesce(given("service"), F.lit("unknown")),
        "environment": text_or_empty(given("environment")),
        "level": normalize_level(given("level")),
        "message": F.col("_texts")[0],
        "body": F.col("_body"),
        "resource": F.coalesce(given("resource"), F.lit("{}")),
        "trace_id": text_or_empty(given("trace_id")),
        "span_id": text_or_empty(given("span_id")),
        **{n: F.col(f"_harvest.{n}") for n in ENRICHMENT_KEYS},
        "user_linkage_key": linkage_key(_tenant(df, cfg), given("user_id")),
        "pii_detected": F.col("pii_types"),
        "ingested_by": F.lit(ingested_by),
        "_retention_days": days,
    }
    staged = staged.select(*[c.alias(n) for n, c in columns.items()], "drop_record")
    return conform(staged, "logs", keep=["drop_record"])


def reject_reason(table: str, columns) -> Column:
    """Why a row of ``columns`` cannot become a row of the table; NULL when it can.

    ``_corrupt`` holds the payload when a field of it has another type than the table's.
    """
    reasons = [F.when(F.col("_corrupt").isNotNull(), "a field has the wrong type")] if "_corrupt" in columns else []
    if table == "metrics":
        reasons.append(F.when(text_or_empty("metric_name") == "", "metric without a name"))
    elif table == "traces":
        reasons.append(F.when(text_or_empty("trace_id") == "", "span without a trace id"))
        reasons.append(F.when(text_or_empty("span_id") == "", "span without an id"))
    return F.coalesce(*reasons, F.lit(None).cast("string"))


def build_metric_points(df: DataFrame, cfg: IngestConfig) -> DataFrame:
    """Rows of the ``metrics`` schema; points with a :func:`reject_reason` are left out and non-finite numbers read as 0."""

    def finite(column: Column) -> Column:
        return F.when(F.isnan(column) | (F.abs(column) == float("inf")), F.lit(0.0)).otherwise(column)

    columns = {"tenant_id": _tenant(df, cfg)}
    for name in ("value", "sum", "min", "max"):
        if name in df.columns:
            columns[name] = finite(F.col(name).cast("double"))
    if "explicit_bounds" in df.columns:
        columns["explicit_bounds"] = F.transform(F.col("explicit_bounds").cast("array<double>"), finite)
    for name, default in (("service", "unknown"), ("metric_type", "gauge"), ("resource", "{}")):
        columns[name] = F.coalesce(blank_to_null(name), F.lit(default)) if name in df.columns else F.lit(default)
    ns = normalize_timestamp_ns(F.col("timestamp"), cfg.as_of)
    columns |= {"ts_ns": ns, "timestamp": ns_to_timestamp(ns), "received_at": as_of_col(cfg.as_of)}
    if "start_timestamp" in df.columns:
        start = ns_to_timestamp(normalize_timestamp_ns(F.col("start_timestamp"), cfg.as_of))
        columns["start_timestamp"] = F.when(F.col("start_timestamp").isNotNull(), start)
    columns["id"] = _identity(df)
    if cfg.retention_days is not None:
        columns["_retention_days"] = F.lit(cfg.retention_days)
    return conform(df.filter(reject_reason("metrics", df.columns).isNull()).withColumns(columns), "metrics")


def build_spans(df: DataFrame, cfg: IngestConfig) -> DataFrame:
    """Rows of the ``traces`` schema; spans with a :func:`reject_reason` are left out, broken parents stay."""
    usable = df.filter(reject_reason("traces", df.columns).isNull())
    ns = normalize_timestamp_ns(F.col("start_time"), cfg.as_of)
    start = ns_to_timestamp(ns)
    end = ns_to_timestamp(normalize_timestamp_ns(F.col("end_time"), cfg.as_of))
    defaults = (("service", "unknown"), ("kind", "internal"), ("status_code", "unset"), ("attributes", "{}"), ("resource", "{}"))
    columns = {
        n: F.coalesce(blank_to_null(n), F.lit(d)) if n in df.columns else F.lit(d) for n, d in defaults
    }
    columns |= {
        "tenant_id": _tenant(df, cfg), "ts_ns": ns, "timestamp": start, "start_time": start,
        "end_time": F.when(F.col("end_time").isNotNull(), end).otherwise(start),
        "received_at": as_of_col(cfg.as_of),
        "id": _identity(df),
    }
    if cfg.retention_days is not None:
        columns["_retention_days"] = F.lit(cfg.retention_days)
    return conform(usable.withColumns(columns), "traces")


def build_change_events(df: DataFrame, as_of, cfg: IngestConfig | None = None) -> DataFrame:
    """Rows of the ``change_events`` schema: kind ``deploy``, time ``as_of`` and metadata ``{}`` by default."""
    columns = {}
    for name, default in (("kind", "deploy"), ("metadata", "{}")):
        columns[name] = F.coalesce(blank_to_null(name), F.lit(default)) if name in df.columns else F.lit(default)
    given = F.col("timestamp").cast("timestamp") if "timestamp" in df.columns else F.lit(None).cast("timestamp")
    columns["timestamp"] = F.coalesce(given, as_of_col(as_of))
    columns["received_at"] = as_of_col(as_of)
    columns["id"] = _identity(df)
    if cfg is not None and cfg.tenant_id is not None:
        columns["tenant_id"] = F.lit(cfg.tenant_id)
    return conform(df.withColumns(columns), "change_events")
