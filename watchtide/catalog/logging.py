"""Log queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.fields import json_field
from ..functions.levels import level_cmp
from ..functions.masking import has_all_tokens
from ..functions.times import rel
from ..operators import logs as L
from ..operators.scope import all_of, any_of, pred, select_aggregate, select_fields, select_rows, tenant_scope
from ..plans.ranking import top_n_per_group
from ..sources import adapters as A
from .base import NOW, TENANT, register

AS_OF = A.AS_OF
DAY_NS = 86400 * 10**9
END_NS = 1706659200 * 10**9


@register(
    "errors_by_service",
    f"""SELECT service, count(*) AS errors FROM {{logs}}
        WHERE tenant_id = '{TENANT}' AND level = 'error' AND "timestamp" > {NOW} - INTERVAL 1 DAY GROUP BY service""",
)
def errors_by_service(spark, sf):
    """Errors per service in the last day."""
    where = all_of(pred("logs", "level", "=", "error"), pred("logs", "time", ">", rel(AS_OF, "-1d")))
    return select_aggregate(A.logs(spark, sf), "logs", TENANT, [("count", "*", "errors")], ["service"], where, "errors", True)


@register(
    "select_aggregate",
    f"""SELECT service, level, count(*) AS count, epoch_us(min("timestamp")) AS min_timestamp,
        epoch_us(max("timestamp")) AS max_timestamp FROM {{logs}} WHERE tenant_id = '{TENANT}' GROUP BY service, level""",
)
def aggregate(spark, sf):
    aggs = [("count", "*"), ("min", "timestamp"), ("max", "timestamp")]
    return select_aggregate(A.logs(spark, sf), "logs", TENANT, aggs, ["service", "level"])


@register(
    "tenant_scope",
    f"""SELECT service, count(*) AS n FROM {{logs}} WHERE tenant_id = '{TENANT}' GROUP BY service""",
)
def scoped(spark, sf):
    """A predicate on another tenant, even under OR, never leaves the caller's rows."""
    escape = any_of(pred("logs", "tenant_id", "=", "ten_2"), pred("logs", "level", "=", "error"))
    return tenant_scope(A.logs(spark, sf), TENANT).filter(escape).groupBy("service").agg(F.count("*").alias("n"))


@register(
    "level_at_least",
    "SELECT tenant_id, service, count(*) AS n FROM {logs} WHERE level IN ('warn', 'error', 'fatal') GROUP BY ALL",
)
def at_least(spark, sf):
    return A.logs(spark, sf).filter(level_cmp(">=", "warn")).groupBy("tenant_id", "service").agg(F.count("*").alias("n"))


@register(
    "bool_expr",
    f"""SELECT id, level, service AS svc FROM {{logs}} WHERE tenant_id = '{TENANT}'
        AND ((level = 'error' AND service = 'svc_1') OR (level = 'warn' AND environment <> 'prod'))
       """,
)
def boolean(spark, sf):
    """AND, OR, comparisons, aliases and a descending listing."""
    where = any_of(
        all_of(pred("logs", "level", "=", "error"), pred("logs", "service", "=", "svc_1")),
        all_of(pred("logs", "level", "=", "warn"), pred("logs", "environment", "!=", "prod")),
    )
    items = ["id", "level", ("service", "svc")]
    return select_rows(A.logs(spark, sf), "logs", TENANT, items, where, "time", True)


@register(
    "time_relative",
    f"""SELECT tenant_id, count(*) AS n FROM {{logs}} WHERE "timestamp" >= {NOW} - INTERVAL 36 HOUR
        AND "timestamp" < {NOW} - INTERVAL 30 MINUTE GROUP BY tenant_id""",
)
def relative(spark, sf):
    where = all_of(pred("logs", "time", ">=", rel(AS_OF, "-36h")), pred("logs", "time", "<", rel(AS_OF, "-30m")))
    return A.logs(spark, sf).filter(where).groupBy("tenant_id").agg(F.count("*").alias("n"))


@register(
    "json_field",
    """SELECT coalesce(json_extract_string(body, '$.k'), '') AS k, '' AS k_text, '' AS missing, count(*) AS n
       FROM {logs} GROUP BY ALL""",
)
def json_values(spark, sf):
    """A number inside JSON reads as text only where asked for."""
    read = A.logs(spark, sf).select(
        json_field("body", "k", stringify=True).alias("k"), json_field("body", "k").alias("k_text"),
        json_field("body", "no.such").alias("missing"),
    )
    return read.groupBy("k", "k_text", "missing").agg(F.count("*").alias("n"))


PHRASE = "The, on"
_TOKENS = r"regexp_split_to_array(lower(message), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_HIT = f"list_contains({_TOKENS}, 'the') AND list_contains({_TOKENS}, 'on')"


@register(
    "search_logs",
    f"SELECT tenant_id, service, count(*) AS n FROM {{docs}} WHERE {_HIT} GROUP BY ALL",
)
def search_counts(spark, sf):
    """Documents holding every token of a phrase, over whole texts."""
    hits = A.documents(spark, sf).filter(has_all_tokens("message", PHRASE))
    return hits.groupBy("tenant_id", "service").agg(F.count("*").alias("n"))


@register(
    "search_logs_newest",
    f"""SELECT epoch_us("timestamp") AS timestamp, id, service, message FROM {{docs}}
        WHERE tenant_id = (SELECT min(source) FROM documents) AND {_HIT} ORDER BY "timestamp" DESC, id DESC LIMIT 100""",
)
def search_newest(spark, sf):
    docs = A.documents(spark, sf)
    first = docs.agg(F.min("tenant_id")).first()[0]
    return L.search_logs(docs, first, PHRASE, limit=100).select("timestamp", "id", "service", "message")


@register(
    "stream_selector",
    f"""SELECT id, epoch_us("timestamp") AS timestamp, epoch_us("timestamp") * 1000 AS ts_ns, service, level, environment,
        trace_id, span_id, message FROM {{logs}} WHERE tenant_id = '{TENANT}' AND service = 'svc_1' AND level <> 'debug'
        AND "timestamp" >= {NOW} - INTERVAL 604800 SECOND AND "timestamp" <= {NOW}""",
)
def selector(spark, sf):
    matchers = [("service", "=", "svc_1"), ("level", "!=", "debug")]
    return L.stream_selector(A.logs(spark, sf), TENANT, matchers, AS_OF, END_NS - 7 * DAY_NS, END_NS)


@register(
    "log_streams",
    f"""WITH picked AS (SELECT * FROM {{logs}} WHERE tenant_id = '{TENANT}' AND service = 'svc_1'
          AND "timestamp" >= {NOW} - INTERVAL 604800 SECOND AND "timestamp" <= {NOW}),
        named AS (SELECT concat(CASE WHEN environment <> '' THEN concat('environment=', environment, ';') ELSE '' END, 'level=', level, ';service=',
          service, ';span_id=', span_id, ';trace_id=', trace_id, ';') AS stream, "timestamp", message FROM picked),
        paged AS (SELECT *, (row_number() OVER (PARTITION BY stream ORDER BY "timestamp", message) - 1) // 3 AS page FROM named)
        SELECT stream, page, string_agg(concat(epoch_us("timestamp") * 1000, ' ', message), ',' ORDER BY "timestamp", message) AS lines
        FROM paged GROUP BY stream, page""",
)
def streams(spark, sf):
    picked = L.stream_selector(A.logs(spark, sf), TENANT, [("service", "=", "svc_1")], AS_OF, END_NS - 7 * DAY_NS, END_NS)
    grouped = L.to_streams(picked, page_size=3)
    name = F.array_join(F.transform("labels", lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))), "")
    lines = F.array_join(F.transform("values", lambda v: F.concat(v["ns"].cast("string"), F.lit(" "), v["line"])), ",")
    return grouped.select(name.alias("stream"), "page", lines.alias("lines"))


@register(
    "label_values",
    f"""SELECT DISTINCT environment AS value FROM {{logs}} WHERE tenant_id = '{TENANT}' AND environment <> ''
        UNION ALL SELECT DISTINCT service FROM {{logs}} WHERE tenant_id = '{TENANT}' AND "timestamp" >= {NOW} - INTERVAL 2 DAY""",
)
def values(spark, sf):
    logs = A.logs(spark, sf)
    bounded = L.label_values(logs, TENANT, "service", END_NS - 2 * DAY_NS, END_NS)
    return L.label_values(logs, TENANT, "environment").unionByName(bounded)


@register(
    "label_sets",
    f"""SELECT DISTINCT service, level, environment FROM {{logs}} WHERE tenant_id = '{TENANT}' AND environment = 'prod'
        AND "timestamp" >= {NOW} - INTERVAL 3 DAY""",
)
def sets(spark, sf):
    return L.label_sets(A.logs(spark, sf), TENANT, [("environment", "=", "prod")], END_NS - 3 * DAY_NS)


@register(
    "live_tail_predicate",
    f"""SELECT tenant_id, count(*) AS n FROM {{logs}} WHERE (level IN ('warn', 'error') OR service = 'svc_3')
        AND cast(json_extract_string(body, '$.k') AS DOUBLE) >= 50 AND "timestamp" > {NOW} - INTERVAL 10 DAY GROUP BY tenant_id""",
)
def tail_batch(spark, sf):
    """The live-tail predicate over history."""
    level = L.tail_predicate("level", ">=", "WARN")
    service = L.tail_predicate("service", "=", "svc_3")
    number = L.tail_predicate("body.k", ">=", 50)
    recent = L.tail_predicate("time", ">", dt.timedelta(days=-10), AS_OF)
    both = all_of(any_of(level, service), number, recent, L.tail_predicate("tenant", "=", "any"))
    return A.logs(spark, sf).filter(both).groupBy("tenant_id").agg(F.count("*").alias("n"))


@register(
    "timeline",
    f"""WITH l AS (SELECT 'log' AS type, "timestamp" AS ts, service, level AS severity, message AS title, trace_id, span_id, 0 AS o, id AS k
          FROM {{logs}} WHERE tenant_id = '{TENANT}' AND "timestamp" >= {NOW} - INTERVAL 3 DAY AND level IN ('warn', 'error', 'fatal')
         ),
        s AS (SELECT 'span' AS type, "timestamp" AS ts, service, status_code AS severity, '' AS title, trace_id, span_id, 1 AS o, span_id AS k
          FROM {{traces}} WHERE tenant_id = '{TENANT}' AND "timestamp" >= {NOW} - INTERVAL 3 DAY AND "timestamp" <= {NOW}),
        c AS (SELECT 'deploy' AS type, "timestamp" AS ts, service, kind AS severity, title, '' AS trace_id, '' AS span_id, 2 AS o, id AS k
          FROM {{changes}} WHERE tenant_id = '{TENANT}' AND "timestamp" >= {NOW} - INTERVAL 3 DAY)
        SELECT type, epoch_us(ts) AS timestamp, service, severity, title, trace_id, span_id FROM
          (SELECT * FROM l UNION ALL SELECT * FROM s UNION ALL SELECT * FROM c)""",
)
def feed(spark, sf):
    merged = L.timeline(A.logs(spark, sf), A.traces(spark, sf), A.change_events(spark, sf), TENANT, AS_OF, since=3 * 86400)
    return merged.drop("fields")


@register(
    "timeline_trace",
    f"""WITH l AS (SELECT 'log' AS type, "timestamp" AS ts, service, level AS severity, message AS title, trace_id, span_id, 0 AS o, id AS k
          FROM {{logs}} WHERE tenant_id = '{TENANT}' AND trace_id = 't4'),
        s AS (SELECT 'span' AS type, "timestamp" AS ts, service, status_code AS severity, '' AS title, trace_id, span_id, 1 AS o, span_id AS k
          FROM {{traces}} WHERE tenant_id = '{TENANT}' AND trace_id = 't4')
        SELECT type, epoch_us(ts) AS timestamp, service, severity, title, trace_id, span_id FROM
          (SELECT * FROM l UNION ALL SELECT * FROM s)""",
)
def trace_story(spark, sf):
    merged = L.timeline(A.logs(spark, sf), A.traces(spark, sf), A.change_events(spark, sf), TENANT, AS_OF, trace_id="t4")
    return merged.drop("fields")


@register(
    "list_changes",
    f"""SELECT epoch_us("timestamp") AS timestamp, service, kind, title, git_sha, deploy_id FROM {{changes}}
        WHERE tenant_id = '{TENANT}'""",
)
def changes(spark, sf):
    return L.list_changes(A.change_events(spark, sf), TENANT)


@register(
    "list_auth_events",
    f"""SELECT cast(event_id AS string) AS id, epoch_us(ts) AS timestamp, event_type, cast(user_id AS string) AS user_id FROM events
        WHERE concat('ten_', cast(user_id % 3 AS string)) = '{TENANT}'""",
)
def auth_events(spark, sf):
    events = A.load(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), F.concat(F.lit("ten_"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type"), F.lit("password").alias("auth_method"),
        F.col("user_id").cast("string").alias("user_id"), F.lit("").alias("ip_country"), F.lit(0.0).cast("float").alias("risk_score"),
    )
    shown = L.list_auth_events(events, TENANT)
    return shown.select("id", "timestamp", "event_type", "user_id") if "id" in shown.columns else shown


@register(
    "auth_field",
    f"""SELECT event_type, count(*) AS n FROM events WHERE concat('ten_', cast(user_id % 3 AS string)) = '{TENANT}'
        GROUP BY event_type""",
)
def auth_values(spark, sf):
    events = A.load(spark, sf, "events").withColumn("tenant_id", F.concat(F.lit("ten_"), (F.col("user_id") % 3).cast("string")))
    return select_aggregate(events, "auth_events", TENANT, [("count", "*", "n")], ["auth.event_type"])


@register(
    "select_fields",
    f"""SELECT id, epoch_us("timestamp") AS timestamp, service, level, message, trace_id, span_id, body FROM {{logs}}
        WHERE tenant_id = 'ten_2'""",
)
def default_fields(spark, sf):
    """The default projection, oldest first, all rows."""
    return select_rows(A.logs(spark, sf), "logs", "ten_2", order_by="timestamp")


@register(
    "audit_search",
    f"""WITH hit AS (SELECT * FROM {{audit_trail}} WHERE tenant_id = '{TENANT}' AND lower(actor) LIKE '%user_1%' AND lower(action) LIKE '%click%')
        SELECT tenant_id, epoch_us(created_at) AS created_at, actor, action, id, (SELECT count(*) FROM hit) AS total
        FROM hit""",
)
def audit(spark, sf):
    return L.audit_search(A.audit_trail(spark, sf), TENANT, "USER_1", "click")


@register(
    "top_n_per_group",
    """SELECT tenant_id, service, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, service
       ORDER BY "timestamp" DESC, id DESC) AS rank FROM {changes}) WHERE rank <= 10""",
)
def newest_changes(spark, sf):
    order = [F.col("timestamp").desc(), F.col("id").desc()]
    ranked = top_n_per_group(A.change_events(spark, sf), ["tenant_id", "service"], order, 10, "rank")
    return ranked.select("tenant_id", "service", "id", "rank")
