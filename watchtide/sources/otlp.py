"""OTLP/JSON exports and remote-write series as canonical input rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import let
from ..functions.fields import build_json, json_entries, quote_json

# Resource attributes behind service, environment and enrichment; enum names.
SERVICE_KEY = "service.name"
ENVIRONMENT_KEY = "deployment.environment"
RESOURCE_ENRICHMENT = {
    "git_sha": ["vcs.repository.ref.revision", "git.sha", "commit", "service.version"],
    "deploy_id": ["deployment.id", "deploy.id"],
    "pr_number": ["vcs.repository.change.id", "pr.number"],
    "k8s_namespace": ["k8s.namespace.name"],
    "k8s_pod": ["k8s.pod.name"],
    "k8s_node": ["k8s.node.name"],
}
TEMPORALITY = {1: "delta", 2: "cumulative"}
SPAN_KINDS = {2: "server", 3: "client", 4: "producer", 5: "consumer"}
STATUS_CODES = {1: "ok", 2: "error"}

_ANY = "struct<stringValue:string,intValue:string,doubleValue:string,boolValue:boolean>"
_ATTRS = f"array<struct<key:string,value:{_ANY}>>"
_RESOURCE = f"struct<attributes:{_ATTRS}>"
LOGS_SCHEMA = (
    f"resourceLogs array<struct<resource:{_RESOURCE},scopeLogs:array<struct<logRecords:array<struct<"
    f"timeUnixNano:string,severityText:string,body:{_ANY},traceId:string,spanId:string,attributes:{_ATTRS}>>>>>>"
)
_BUCKETS = "struct<offset:string,bucketCounts:array<string>>"
_POINT = (
    "array<struct<timeUnixNano:string,startTimeUnixNano:string,asDouble:string,asInt:string,count:string,sum:string,"
    "min:string,max:string,bucketCounts:array<string>,explicitBounds:array<string>,scale:string,zeroCount:string,"
    f"positive:{_BUCKETS},negative:{_BUCKETS},attributes:{_ATTRS}>>"
)
_KINDS = {
    "gauge": ("gauge", f"struct<dataPoints:{_POINT}>"),
    "sum": ("sum", f"struct<dataPoints:{_POINT},isMonotonic:boolean,aggregationTemporality:string>"),
    "histogram": ("histogram", f"struct<dataPoints:{_POINT},aggregationTemporality:string>"),
    "exponentialHistogram": ("exp_histogram", f"struct<dataPoints:{_POINT},aggregationTemporality:string>"),
    "summary": ("summary", f"struct<dataPoints:{_POINT}>"),
}
METRICS_SCHEMA = (
    f"resourceMetrics array<struct<resource:{_RESOURCE},scopeMetrics:array<struct<metrics:array<struct<"
    "name:string,unit:string,description:string," + ",".join(f"`{k}`:{t}" for k, (_, t) in _KINDS.items()) + ">>>>>>"
)
TRACES_SCHEMA = (
    f"resourceSpans array<struct<resource:{_RESOURCE},scopeSpans:array<struct<scope:struct<name:string,version:string>,"
    "spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,"
    f"startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRS},"
    "status:struct<code:string,message:string>,traceState:string>>>>>>"
)


def otlp_any_string(value: Column) -> Column:
    """An attribute value as plain text; no value is ``''``."""
    flag = F.when(value["boolValue"].isNotNull(), value["boolValue"].cast("string"))
    return F.coalesce(value["stringValue"], flag, value["intValue"], value["doubleValue"], F.lit(""))


def _any_json(value: Column) -> Column:
    """An attribute value as JSON text."""
    flag = F.when(value["boolValue"].isNotNull(), value["boolValue"].cast("string"))
    # integers arrive as numbers or, in the protocol's JSON form, as quoted text; both are kept verbatim
    return F.coalesce(
        F.when(value["stringValue"].isNotNull(), quote_json(value["stringValue"])),
        flag, value["intValue"], value["doubleValue"], F.lit("null"),
    )


def _map(attributes: Column, render) -> Column:
    """Attributes as a map; of repeated keys the last wins, attributes without a value are left out."""
    entry = lambda a: F.struct(a["key"].alias("key"), render(a["value"]).alias("value"))

    def to_map(kept: Column) -> Column:
        indexed = F.transform(kept, lambda a, i: F.struct(a["key"].alias("key"), a["value"].alias("value"), i.alias("i")))
        last = F.filter(indexed, lambda a: ~F.exists(kept_slice(kept, a["i"]), lambda b: b["key"] == a["key"]))
        keys = F.transform(kept, lambda a: a["key"])
        unique = F.size(F.array_distinct(keys)) == F.size(kept)
        return F.map_from_entries(F.when(unique, F.transform(kept, entry)).otherwise(F.transform(last, entry)))

    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(let(F.filter(attributes, lambda a: a["value"].isNotNull()), to_map), empty)


def kept_slice(items: Column, index: Column) -> Column:
    return F.slice(items, index + 2, F.greatest(F.size(items) - index - 1, F.lit(0)))


def _resource_columns(df: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` and, under names of their own, what the resource ``_r`` says, worked out once per resource."""
    attributes = F.col("_r.resource.attributes")
    listed = df.select(*kept, "_r", F.transform(attributes, lambda a: a["key"]).alias("_keys"), F.transform(attributes, lambda a: a["value"]["stringValue"]).alias("_strings"))

    def named(*keys: str) -> Column:
        """First string value among the keys, NULL when there is none."""
        values = [F.get("_strings", F.nullif(F.array_position("_keys", k), F.lit(0)).cast("int") - 1) for k in keys]
        return F.coalesce(*values) if len(values) > 1 else values[0]

    fields = {
        "service": named(SERVICE_KEY),
        "environment": named(ENVIRONMENT_KEY),
        "resource": build_json(F.coalesce(_map(attributes, _any_json), F.create_map().cast("map<string,string>"))),
        **{n: named(*keys) for n, keys in RESOURCE_ENRICHMENT.items()},
    }
    return listed.select(*kept, "_r", *[fields[n].alias(c) for n, c in _RESOURCE.items()])


_RESOURCE = {n: f"_res_{n}" for n in ("service", "environment", "resource", *RESOURCE_ENRICHMENT)}


def _resource() -> dict[str, Column]:
    return {n: F.col(c) for n, c in _RESOURCE.items()}


def _unnest(df: DataFrame, column: str, schema: str, path: list[tuple[str, str]]) -> DataFrame:
    """Parse the export and explode its nested lists; each level keeps what it needs of its parent."""
    out = df.withColumn("_doc", F.from_json(F.col(column), schema)).drop(column)
    kept = [c for c in df.columns if c != column]
    for expression, name in path:
        out = out.select(*kept, F.explode(F.col(expression)).alias(name))
        if name == "_r":
            out = _resource_columns(out, kept)
            kept += _RESOURCE.values()
        kept.append(name)
    return out


def flatten_otlp_logs(df: DataFrame, column: str = "value") -> DataFrame:
    """One row of log payload fields per log record."""
    path = [("_doc.resourceLogs", "_r"), ("_r.scopeLogs", "_s"), ("_s.logRecords", "_l")]
    rows = _unnest(df, column, LOGS_SCHEMA, path)
    record = F.col("_l")
    return rows.select(
        *[c for c in df.columns if c != column],
        record["timeUnixNano"].alias("timestamp"),
        record["severityText"].alias("level"),
        record["body"]["stringValue"].alias("message"),
        record["traceId"].alias("trace_id"),
        record["spanId"].alias("span_id"),
        *[c.alias(n) for n, c in _resource().items()],
        _map(record["attributes"], _any_json).alias("extra"),
    )


def _enum(number: Column, names: dict[int, str], other: str) -> Column:
    out = F.lit(other)
    for code, name in names.items():
        out = F.when(number.try_cast("int") == code, name).otherwise(out)
    return out


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def _count(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def _counts(texts: Column) -> Column:
    return F.coalesce(F.transform(texts, _count), F.array().cast("array<bigint>"))


def flatten_otlp_metrics(df: DataFrame, column: str = "value") -> DataFrame:
    """One row of metric fields per data point of any kind."""
    path = [("_doc.resourceMetrics", "_r"), ("_r.scopeMetrics", "_s"), ("_s.metrics", "_m")]
    rows = _unnest(df, column, METRICS_SCHEMA, path)
    kept = [c for c in df.columns if c != column]
    metric = F.col("_m")

    def points_of(key: str) -> Column:
        kind, layout = _KINDS[key]
        monotonic = F.coalesce(metric[key]["isMonotonic"], F.lit(False)) if key == "sum" else F.lit(False)
        has_temporality = "aggregationTemporality" in layout
        temporality = _enum(metric[key]["aggregationTemporality"], TEMPORALITY, "") if has_temporality else F.lit("")
        return F.transform(
            metric[key]["dataPoints"],
            lambda p: F.struct(
                F.lit(kind).alias("kind"), p.alias("p"), monotonic.alias("monotonic"), temporality.alias("temporality")
            ),
        )

    # a metric has one kind set, the other lists are NULL
    point_list = F.flatten(F.array_compact(F.array(*[points_of(key) for key in _KINDS])))
    points = rows.select(*kept, *_RESOURCE.values(), "_m", F.explode(point_list).alias("_k"))
    p, kind = F.col("_k.p"), F.col("_k.kind")
    scalar = kind.isin("gauge", "sum")
    spread = kind.isin("histogram", "exp_histogram")
    exponential = kind == "exp_histogram"
    zero = F.lit(0.0)
    resource = _resource()
    return points.select(
        *kept,
        p["timeUnixNano"].alias("timestamp"),
        p["startTimeUnixNano"].alias("start_timestamp"),
        *[resource[n].alias(n) for n in ("service", "environment", "resource")],
        F.coalesce(metric["name"], F.lit("")).alias("metric_name"),
        kind.alias("metric_type"),
        F.coalesce(metric["unit"], F.lit("")).alias("unit"),
        F.coalesce(metric["description"], F.lit("")).alias("description"),
        F.col("_k.temporality").alias("temporality"),
        F.col("_k.monotonic").cast("int").alias("is_monotonic"),
        F.when(scalar, _number(F.coalesce(p["asDouble"], p["asInt"]))).otherwise(zero).alias("value"),
        _map(p["attributes"], otlp_any_string).alias("attributes"),
        F.when(~scalar, _count(p["count"])).otherwise(0).alias("count"),
        F.when(~scalar, _number(p["sum"])).otherwise(zero).alias("sum"),
        F.when(spread, _number(p["min"])).otherwise(zero).alias("min"),
        F.when(spread, _number(p["max"])).otherwise(zero).alias("max"),
        F.when(kind == "histogram", _counts(p["bucketCounts"])).otherwise(F.array().cast("array<bigint>")).alias("bucket_counts"),
        F.when(kind == "histogram", F.coalesce(F.transform(p["explicitBounds"], _number), F.array().cast("array<double>")))
        .otherwise(F.array().cast("array<double>")).alias("explicit_bounds"),
        F.when(exponential, F.coalesce(p["scale"].try_cast("int"), F.lit(0))).otherwise(0).alias("scale"),
        F.when(exponential, _count(p["zeroCount"])).otherwise(0).alias("zero_count"),
        *[
            column
            for side in ("positive", "negative")
            for column in (
                F.when(exponential, F.coalesce(p[side]["offset"].try_cast("int"), F.lit(0))).otherwise(0).alias(f"{side}_offset"),
                F.when(exponential, _counts(p[side]["bucketCounts"])).otherwise(F.array().cast("array<bigint>")).alias(f"{side}_buckets"),
            )
        ],
    )


def flatten_otlp_traces(df: DataFrame, column: str = "value") -> DataFrame:
    """One row of span fields per span."""
    path = [("_doc.resourceSpans", "_r"), ("_r.scopeSpans", "_s"), ("_s.spans", "_p")]
    rows = _unnest(df, column, TRACES_SCHEMA, path)
    span, scope = F.col("_p"), F.col("_s.scope")
    blank = lambda c: F.coalesce(c, F.lit(""))
    resource = {
        n: c if n in ("service", "environment", "resource") else blank(c)
        for n, c in _resource().items()
    }
    return rows.select(
        *[c for c in df.columns if c != column],
        span["startTimeUnixNano"].alias("start_time"),
        span["endTimeUnixNano"].alias("end_time"),
        F.greatest(_count(span["endTimeUnixNano"]) - _count(span["startTimeUnixNano"]), F.lit(0)).alias("duration_ns"),
        blank(span["traceId"]).alias("trace_id"),
        blank(span["spanId"]).alias("span_id"),
        blank(span["parentSpanId"]).alias("parent_span_id"),
        blank(span["name"]).alias("name"),
        _enum(span["kind"], SPAN_KINDS, "internal").alias("kind"),
        _enum(span["status"]["code"], STATUS_CODES, "unset").alias("status_code"),
        blank(span["status"]["message"]).alias("status_message"),
        build_json(_map(span["attributes"], _any_json)).alias("attributes"),
        *[c.alias(n) for n, c in resource.items()],
        blank(scope["name"]).alias("scope_name"),
        blank(scope["version"]).alias("scope_version"),
        blank(span["traceState"]).alias("trace_state"),
    )


# Remote-write labels with a column of their own.
REMOTE_SERVICE = ["service", "service_name"]
REMOTE_ENVIRONMENT = ["environment", "env"]
REMOTE_JOB = "job"
REMOTE_NAME = "__name__"


def map_remote_write_series(df: DataFrame) -> DataFrame:
    """Decoded series (``labels`` and ``samples`` arrays of structs) as one metric row per sample.

    Series without a name are skipped; of repeated labels the last wins.
    """
    labels = F.col("labels")

    def last(names: list[str]) -> Column:
        hits = F.filter(labels, lambda x: x["name"].isin(names))
        return F.try_element_at(F.transform(hits, lambda x: x["value"]), F.lit(-1))

    own = [REMOTE_NAME, *REMOTE_SERVICE, REMOTE_JOB, *REMOTE_ENVIRONMENT]
    rest = F.filter(labels, lambda x: ~x["name"].isin(own))
    unique = F.filter(
        F.transform(rest, lambda x, i: F.struct(x["name"].alias("name"), x["value"].alias("value"), i.alias("i"))),
        lambda x: ~F.exists(kept_slice(rest, x["i"]), lambda y: y["name"] == x["name"]),
    )
    attributes = F.map_from_entries(F.transform(unique, lambda x: F.struct(x["name"].alias("key"), x["value"].alias("value"))))
    kept = [c for c in df.columns if c not in ("labels", "samples")]
    named = df.select(
        *kept,
        last([REMOTE_NAME]).alias("metric_name"),
        F.coalesce(last(REMOTE_SERVICE), last([REMOTE_JOB])).alias("service"),
        last(REMOTE_ENVIRONMENT).alias("environment"),
        attributes.alias("attributes"),
        "samples",
    ).filter(F.coalesce("metric_name", F.lit("")) != "")
    exploded = named.withColumn("_s", F.explode("samples"))
    return exploded.select(
        *kept, "metric_name", "service", "environment", "attributes",
        F.lit("gauge").alias("metric_type"),
        F.col("_s.timestamp").cast("string").alias("timestamp"),
        F.col("_s.value").alias("value"),
    )


def read_otlp(df: DataFrame, table: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``: the flattened rows of all readable exports of a signal, and the other documents with an ``error``.

    A readable document holds the signal's list of resources, which may be empty. A null document is no JSON object.
    """
    flatten, root = {
        "logs": (flatten_otlp_logs, "resourceLogs"), "metrics": (flatten_otlp_metrics, "resourceMetrics"), "traces": (flatten_otlp_traces, "resourceSpans"),
    }[table]
    entries = json_entries(column)
    listed = F.coalesce(F.ltrim(entries[root]).startswith("["), F.lit(False))
    error = F.when(entries.isNull(), "not a JSON object").when(~listed, f"no {root}")
    marked = df.withColumn("error", error)
    return flatten(marked.filter(F.col("error").isNull()).drop("error"), column), marked.filter(F.col("error").isNotNull())
