"""Span and service-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import trailing
from ..operators import traces as T
from ..plans.ranking import top_n_per_group
from ..sources import adapters as A
from .base import ALL_TIME, NOW, TENANT, r6, register

AS_OF = A.AS_OF


def edges_of(spark, sf):
    return T.service_edges(A.traces(spark, sf), AS_OF, ALL_TIME)


def links_of(spark, sf):
    """The bare graph, without edge statistics."""
    return T._calls(A.traces(spark, sf), AS_OF, ALL_TIME).select(*T.EDGE).distinct()


@register(
    "service_edges",
    f"SELECT tenant_id, caller, callee, calls, errors, {r6('p95_ms')} AS p95_ms FROM {{edges}}",
)
def service_edges(spark, sf):
    return edges_of(spark, sf)


_RECENT = """"timestamp" >= TIMESTAMP '2024-01-31' - INTERVAL 40 YEAR AND "timestamp" <= TIMESTAMP '2024-01-31'"""


@register(
    "service_nodes",
    f"""WITH s AS (SELECT tenant_id, service, count(*) AS spans, count(*) FILTER (status_code = 'error') AS span_errors FROM {{traces}} WHERE {_RECENT} GROUP BY ALL),
        l AS (SELECT tenant_id, service, count(*) AS logs, count(*) FILTER (level IN ('error', 'fatal')) AS log_errors FROM {{logs}} GROUP BY ALL)
        SELECT coalesce(s.tenant_id, l.tenant_id) AS tenant_id, coalesce(s.service, l.service) AS service, coalesce(spans, 0) AS spans,
          coalesce(span_errors, 0) AS span_errors, coalesce(logs, 0) AS logs, coalesce(log_errors, 0) AS log_errors,
          CASE WHEN spans IS NOT NULL AND logs IS NOT NULL THEN 'full' WHEN logs IS NOT NULL THEN 'logs-only' ELSE 'traces-only' END AS coverage
        FROM s FULL JOIN l ON s.tenant_id = l.tenant_id AND s.service = l.service""",
)
def service_nodes(spark, sf):
    nodes, _ = T.service_topology(A.traces(spark, sf), A.logs(spark, sf), AS_OF, ALL_TIME)
    return nodes


@register(
    "neighbors",
    """WITH g AS (SELECT DISTINCT tenant_id, caller, callee FROM {calls})
       SELECT DISTINCT tenant_id, service, neighbor FROM (SELECT tenant_id, caller AS service, callee AS neighbor FROM g
         UNION ALL SELECT tenant_id, callee, caller FROM g)""",
)
def neighbors(spark, sf):
    return T.neighbors(links_of(spark, sf))


@register(
    "neighbourhood",
    f"""SELECT caller, callee, calls FROM {{edges}} WHERE tenant_id = '{TENANT}' AND (caller = 'svc_2' OR callee = 'svc_2')""",
)
def neighbourhood(spark, sf):
    edges = edges_of(spark, sf)
    nodes = edges.select("tenant_id", F.col("caller").alias("service")).distinct()
    _, near = T.neighbourhood(edges, nodes, TENANT, "svc_2")
    return near.select("caller", "callee", "calls")


# The services in focus are those that changed in the last five days.
_IN_FOCUS = f""" AND (tenant_id, service) IN (SELECT (tenant_id, service) FROM {{changes}} WHERE "timestamp" > {NOW} - INTERVAL 5 DAY)"""


def _focus(spark, sf):
    return A.change_events(spark, sf).filter(trailing("timestamp", A.AS_OF, 5 * 86400))


@register(
    "blast_radius",
    """WITH RECURSIVE g AS (SELECT DISTINCT tenant_id, caller, callee FROM {calls} WHERE abs(ord) <= 1),
       r AS (SELECT tenant_id, callee AS service, caller AS affected FROM g UNION
             SELECT r.tenant_id, r.service, g.caller FROM r JOIN g ON r.tenant_id = g.tenant_id AND r.affected = g.callee)
       SELECT tenant_id, service, affected FROM r WHERE service <> affected"""
    .replace(" WHERE abs(ord) <= 1", "") + _IN_FOCUS,
)
def blast_radius(spark, sf):
    """Recently changed services with everything that calls them, directly or not."""
    return T.blast_radius(links_of(spark, sf), _focus(spark, sf))


@register(
    "blast_radius_sparse",
    """WITH RECURSIVE n AS (SELECT tenant_id, caller, callee, row_number() OVER (PARTITION BY tenant_id, caller ORDER BY count(*) DESC, callee) AS nth
         FROM {calls} GROUP BY tenant_id, caller, callee),
       g AS (SELECT tenant_id, caller, callee FROM n WHERE nth = 1),
       r AS (SELECT tenant_id, callee AS service, caller AS affected FROM g UNION
             SELECT r.tenant_id, r.service, g.caller FROM r JOIN g ON r.tenant_id = g.tenant_id AND r.affected = g.callee)
       SELECT tenant_id, service, affected FROM r WHERE service <> affected""" + _IN_FOCUS,
)
def main_dependencies(spark, sf):
    """The same over main dependencies: of all calls of a service those to the service that it calls most."""
    calls = T._calls(A.traces(spark, sf), AS_OF, ALL_TIME).groupBy(*T.EDGE).agg(F.count("*").alias("calls"))
    main = top_n_per_group(calls, ["tenant_id", "caller"], [F.col("calls").desc(), F.col("callee")], 1)
    return T.blast_radius(main.select(*T.EDGE), _focus(spark, sf))


@register(
    "log_span_join",
    """SELECT l.tenant_id, l.trace_id, l.span_id, l.id, epoch_us(l."timestamp") AS log_time, l.service AS log_service, l.level, l.message,
       epoch_us(t."timestamp") AS span_time, t.service AS span_service, t.status_code, t.duration_ns
       FROM {logs} l JOIN {traces} t ON l.tenant_id = t.tenant_id AND l.trace_id = t.trace_id AND l.span_id = t.span_id""",
)
def log_span_join(spark, sf):
    return T.log_span_join(A.logs(spark, sf), A.traces(spark, sf))


_KEEP = """(status_code = 'error' OR duration_ns >= 40000000000 OR
    cast(concat('0x', substr(sha256(trace_id), 1, 8)) AS BIGINT) / 4294967295.0::DOUBLE < 0.25)"""


@register(
    "sample_traces",
    f"""SELECT tenant_id, count(*) FILTER ({_KEEP}) AS kept, count(*) FILTER (NOT {_KEEP}) AS sampled_out FROM {{traces}} GROUP BY tenant_id""",
)
def sample_traces(spark, sf):
    return T.sampled_out(A.traces(spark, sf), 0.25, 40_000_000_000)


@register(
    "keep_span",
    f"SELECT tenant_id, trace_id, span_id FROM {{traces}} WHERE {_KEEP}",
)
def kept_spans(spark, sf):
    return T.sample_traces(A.traces(spark, sf), 0.25, 40_000_000_000).select("tenant_id", "trace_id", "span_id")
