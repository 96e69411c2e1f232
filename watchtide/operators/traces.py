"""Span joins, sampling and the service graph derived from spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import keep_span
from ..functions.times import trailing
from ..plans.closure import reachable
from ..plans.quantiles import exact_quantile
from .scope import tenant_scope

EDGE = ["tenant_id", "caller", "callee"]


def _calls(traces: DataFrame, as_of, window: int) -> DataFrame:
    """Cross-service parent/child pairs; only the child has to lie in the window."""
    child = traces.filter(trailing("timestamp", as_of, window, inclusive=True) & (F.col("parent_span_id") != "")).select(
        "tenant_id", "trace_id", F.col("parent_span_id").alias("span_id"),
        F.col("service").alias("callee"), "status_code", "duration_ns",
    )
    parent = traces.select("tenant_id", "trace_id", "span_id", F.col("service").alias("caller"))
    return child.join(parent, ["tenant_id", "trace_id", "span_id"]).filter(F.col("caller") != F.col("callee"))


def service_edges(traces: DataFrame, as_of, window: int = 3600, approximate: bool = False) -> DataFrame:
    """Calls, errors and p95 milliseconds per caller -> callee edge.

    The quantile is exact by default. ``approximate`` answers it with a mergeable sketch in the same
    pass as the counts.
    """
    calls = _calls(traces, as_of, window)
    counted = [F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status_code") == "error").alias("errors")]
    if approximate:
        sketch = F.percentile_approx("duration_ns", 0.95, 10000) / F.lit(1e6)
        return calls.groupBy(*EDGE).agg(*counted, sketch.alias("p95_ms"))
    failed = {"errors": F.col("status_code") == "error"}
    stats = exact_quantile(calls, EDGE, "duration_ns", 0.95, "p95_ns", "calls", failed)
    return stats.select(*EDGE, "calls", "errors", (F.col("p95_ns") / F.lit(1e6)).alias("p95_ms"))


def service_nodes(traces: DataFrame, logs: DataFrame, edges: DataFrame, as_of, window: int = 3600) -> DataFrame:
    """Services seen in spans, logs or edges and how well each is covered."""
    recent = trailing("timestamp", as_of, window, inclusive=True)
    spans = traces.filter(recent & (F.col("service") != "")).groupBy("tenant_id", "service").agg(
        F.count(F.lit(1)).alias("spans"), F.count_if(F.col("status_code") == "error").alias("span_errors")
    )
    lines = logs.filter(recent & (F.col("service") != "")).groupBy("tenant_id", "service").agg(
        F.count(F.lit(1)).alias("logs"), F.count_if(F.col("level").isin("error", "fatal")).alias("log_errors")
    )
    ends = edges.select("tenant_id", F.explode(F.array("caller", "callee")).alias("service")).distinct()
    seen = (
        spans.withColumn("traced", F.lit(True))
        .unionByName(ends.filter(F.col("service") != ""), allowMissingColumns=True)
        .unionByName(lines.withColumn("logged", F.lit(True)), allowMissingColumns=True)
    )
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    merged = seen.groupBy("tenant_id", "service").agg(
        *[count(c) for c in ("spans", "span_errors", "logs", "log_errors")],
        F.bool_or("traced").alias("traced"), F.bool_or("logged").alias("logged"),
    )
    # a service known only from an edge counts as traced
    coverage = (
        F.when(F.col("traced") & F.col("logged"), "full")
        .when(F.col("logged"), "logs-only")
        .otherwise("traces-only")
    )
    return merged.withColumn("coverage", coverage).drop("traced", "logged")


def service_topology(traces: DataFrame, logs: DataFrame, as_of, window: int = 3600) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of every tenant's service graph."""
    edges = service_edges(traces, as_of, window)
    links = _calls(traces, as_of, window).select(*EDGE).distinct()
    return service_nodes(traces, logs, links, as_of, window), edges


def blast_radius(edges: DataFrame, focus) -> DataFrame:
    """Services that call a service in focus directly or through others.

    ``focus`` is a name or a list of names, looked at in every tenant, or a DataFrame of (tenant_id, service);
    only what can be reached from them is followed.
    """
    if isinstance(focus, DataFrame):
        starts = focus.select("tenant_id", F.col("service").alias("origin")).distinct()
    else:
        names = [focus] if isinstance(focus, str) else list(focus)
        starts = edges.select("tenant_id").distinct().withColumn("origin", F.explode(F.array(*map(F.lit, names))))
    pairs = reachable(edges, ["tenant_id"], "callee", "caller", starts)
    return pairs.select("tenant_id", F.col("origin").alias("service"), F.col("reached").alias("affected"))


def neighbors(edges: DataFrame) -> DataFrame:
    """Callers and callees of each service."""
    both = F.explode(
        F.array(
            F.struct(F.col("caller").alias("service"), F.col("callee").alias("neighbor")),
            F.struct(F.col("callee").alias("service"), F.col("caller").alias("neighbor")),
        )
    ).alias("_pair")
    return edges.select("tenant_id", both).select("tenant_id", "_pair.*").distinct()


def neighbourhood(edges: DataFrame, nodes: DataFrame, tenant: str, focus: str) -> tuple[DataFrame, DataFrame]:
    """The edges touching a service and the nodes at their ends; the focus itself always stays."""
    near = tenant_scope(edges, tenant).filter((F.col("caller") == focus) | (F.col("callee") == focus))
    ends = near.select(F.explode(F.array("caller", "callee")).alias("service")).distinct()
    around = tenant_scope(nodes, tenant)
    kept = around.join(ends, "service", "left_semi").unionByName(around.filter(F.col("service") == focus)).distinct()
    return kept, near


def log_span_join(logs: DataFrame, traces: DataFrame, tenant: str | None = None) -> DataFrame:
    """Log lines with the span they were written in, inside one tenant.

    Lines without trace context cannot match and are dropped ahead of the shuffle.
    """
    if tenant is not None:
        logs, traces = tenant_scope(logs, tenant), tenant_scope(traces, tenant)
    keys = ["tenant_id", "trace_id", "span_id"]
    lines = logs.filter((F.col("trace_id") != "") & (F.col("span_id") != "")).select(
        *keys, "id", F.col("timestamp").alias("log_time"), F.col("service").alias("log_service"), "level", "message"
    )
    spans = traces.select(
        *keys, F.col("timestamp").alias("span_time"), F.col("service").alias("span_service"), "status_code", "duration_ns"
    )
    return lines.join(spans, keys)


def sample_traces(spans: DataFrame, rate: float, slow_ns: int) -> DataFrame:
    """The spans a tail sampler keeps."""
    return spans.filter(keep_span(rate, slow_ns))


def sampled_out(spans: DataFrame, rate: float, slow_ns: int) -> DataFrame:
    """Kept and dropped span counts per tenant."""
    keep = keep_span(rate, slow_ns)
    return spans.groupBy("tenant_id").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("sampled_out"))
