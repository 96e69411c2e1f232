"""Parsing, building, storing and exporting; the input lines are derived from the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.basics import settled
from ..functions.levels import otlp_level
from ..sources import adapters as A
from ..sources import lines as LN
from ..sources import otlp as O
from ..sources import records as R
from ..sources import signals as S
from ..sources.remap import Call, Path, apply_remap
from ..sources.webhooks import normalize_change_webhooks
from ..schemas import conform
from .base import NOW, TENANT, r6, register
from .streaming import event_lines, scratch

AS_OF = A.AS_OF
CONFIG = R.IngestConfig(as_of=AS_OF, retention_days=9)


def key():
    return F.col("event_id")


def events(spark, sf):
    return A.load(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp")).withColumn(
        "tenant_id", F.concat(F.lit("ten_"), (F.col("user_id") % 3).cast("string"))
    )


_TEN = "concat('ten_', cast(user_id % 3 AS string))"
_SVC = "concat('svc_', cast(user_id % 7 AS string))"


@register(
    "read_ndjson_logs",
    f"""SELECT event_id, true AS good, event_type AS level, concat('rel', event_id % 10) AS release FROM events WHERE event_id % 13 <> 0
        UNION ALL SELECT event_id, false, '', '' FROM events WHERE event_id % 13 = 0""",
)
def ndjson(spark, sf):
    good, bad = LN.read_ndjson_logs(event_lines(spark, sf))
    shown = good.select("event_id", F.lit(True).alias("good"), "level", F.get_json_object(F.concat(F.lit("["), F.col("extra")["release"], F.lit("]")), "$[0]").alias("release"))
    return shown.unionByName(bad.select("event_id", F.lit(False).alias("good"), F.lit("").alias("level"), F.lit("").alias("release")))


@register(
    "build_log_records",
    f"""SELECT cast(event_id AS string) AS id, epoch_us(ts) AS timestamp, epoch_us(ts) * 1000 AS ts_ns, {_TEN} AS tenant_id, {_SVC} AS service, '' AS environment,
        CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS level, 'mail [redacted:email] now' AS message, concat('rel', event_id % 10) AS deploy_id,
        sha256(concat({_TEN}, ':', user_id)) AS user_linkage_key, 'email' AS pii_detected, concat('{{"details":{{"kind":"', event_type, '"}},"event_id":', event_id, '}}') AS body,
        9 AS _retention_days, false AS drop_record FROM events WHERE event_id % 13 <> 0""",
)
def log_records(spark, sf):
    """Payloads to canonical rows: defaults, levels, times, masking, harvested release, linkage key."""
    good, _ = LN.read_ndjson_logs(event_lines(spark, sf))
    simpler = F.map_concat(
        F.map_filter("extra", lambda k, _: k != "details"),
        F.create_map(F.lit("details"), F.to_json(F.struct(F.get_json_object(F.col("extra")["details"], "$.kind").alias("kind")))),
    )
    rows = good.withColumn("id", key().cast("string")).withColumn("extra", simpler)
    built = R.build_log_records(rows, CONFIG)
    return built.select(
        "id", "timestamp", "ts_ns", "tenant_id", "service", "environment", "level", "message", "deploy_id", "user_linkage_key", "pii_detected",
        "body", "_retention_days", "drop_record",
    )


@register(
    "harvest_enrichment",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'explicit' WHEN event_id % 3 = 0 THEN concat('vcs', event_id) ELSE concat('c', event_id) END AS git_sha,
       CASE WHEN event_id % 2 = 0 THEN 'commit,vcs.revision' WHEN event_id % 3 = 0 THEN 'commit' ELSE '' END AS left_over FROM events""",
)
def harvested(spark, sf):
    """Explicit value, else the first non-empty alternate; what was read leaves the extras."""
    explicit = F.when(key() % 2 == 0, "explicit").otherwise("")
    revision = F.when(key() % 3 == 0, F.concat(F.lit("vcs"), key().cast("string"))).otherwise("")
    extra = F.create_map(F.lit("vcs.revision"), F.to_json(F.array(revision)).substr(F.lit(2), F.length(F.to_json(F.array(revision))) - 2),
                         F.lit("commit"), F.concat(F.lit('"c'), key().cast("string"), F.lit('"')))
    shaped = events(spark, sf).select("event_id", explicit.alias("given_sha"), extra.alias("extra"))
    given = {n: F.lit(None).cast("string") for n in R.ENRICHMENT_KEYS} | {"git_sha": F.col("given_sha")}
    return shaped.select(
        "event_id",
        R.harvest_enrichment(F.col("given_sha"), F.col("extra"), R.ENRICHMENT_KEYS["git_sha"]).alias("git_sha"),
        F.array_join(F.array_sort(F.map_keys(R._without_harvested(F.col("extra"), given))), ",").alias("left_over"),
    )


@register(
    "parse_gelf",
    f"""SELECT event_id, event_type AS service, ['fatal', 'fatal', 'fatal', 'error', 'warn', 'info', 'info', 'debug'][cast(event_id % 8 AS int) + 1] AS level,
        concat(CASE WHEN event_id % 2 = 0 THEN 'short ' ELSE 'full ' END, event_id) AS message, cast(epoch_us(ts) // 1000000 AS string) AS timestamp,
        cast(user_id AS string) AS route FROM events WHERE event_id % 17 <> 0""",
)
def gelf(spark, sf):
    short = F.when(key() % 2 == 0, F.concat(F.lit("short "), key().cast("string")))
    record = F.struct(
        F.col("event_type").alias("host"), short.alias("short_message"), F.concat(F.lit("full "), key().cast("string")).alias("full_message"),
        F.unix_seconds("at").alias("timestamp"), (key() % 8).alias("level"), F.col("user_id").cast("string").alias("_route"), F.lit("x").alias("_id"),
    )
    line = F.when(key() % 17 == 0, "not json").otherwise(F.to_json(record))
    parsed = LN.parse_gelf(A.spread(events(spark, sf).select("event_id", line.alias("value"))))
    route = F.get_json_object(F.concat(F.lit("["), F.col("extra")["route"], F.lit("]")), "$[0]")
    return parsed.filter(F.col("extra")["id"].isNull()).select("event_id", "service", "level", "message", "timestamp", route.alias("route"))


@register(
    "ingest_rejects",
    """WITH g AS (SELECT 'gelf' AS source, CASE WHEN event_id % 17 = 0 THEN 'not a JSON object' ELSE '' END AS reason FROM events
          UNION ALL SELECT 'metrics', CASE WHEN event_id % 5 = 0 THEN 'metric without a name' ELSE '' END FROM events
          UNION ALL SELECT 'traces', CASE WHEN event_id % 7 = 0 THEN 'span without a trace id' WHEN event_id % 3 = 0 THEN 'span without an id' ELSE '' END FROM events
          UNION ALL SELECT 'otlp', CASE WHEN event_id % 11 = 0 THEN 'not a JSON object' WHEN event_id % 11 = 1 THEN 'no resourceMetrics' ELSE '' END FROM events)
       SELECT source, reason, count(*) AS n FROM g GROUP BY ALL""",
)
def rejects(spark, sf):
    """What each source takes and refuses, and why; together they are all that came."""
    rows = events(spark, sf)
    gelf_line = F.when(key() % 17 == 0, "[]").otherwise(F.to_json(F.struct(F.col("event_type").alias("host"))))
    taken, broken = LN.read_gelf(rows.select("event_id", gelf_line.alias("value")))
    points = rows.select("tenant_id", "event_id", F.when(key() % 5 != 0, F.col("event_type")).alias("metric_name"), "value")
    good_points, bad_points = S.split_rejects(points, "metrics")
    text = F.concat(F.lit("x"), key().cast("string"))
    spans = rows.select("tenant_id", F.when(key() % 7 != 0, text).otherwise("").alias("trace_id"), F.when(key() % 3 != 0, text).alias("span_id"))
    good_spans, bad_spans = S.split_rejects(spans, "traces")
    gauge = F.concat(F.lit('{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"m","gauge":{"dataPoints":[{"asInt":"'), key().cast("string"), F.lit('"}]}}]}]}]}'))
    document = F.when(key() % 11 == 0, "{").when(key() % 11 == 1, '{"resourceSpans":[]}').otherwise(gauge)
    good_documents, bad_documents = O.read_otlp(rows.select("event_id", document.alias("value")), "metrics")
    parts = [
        ("gelf", taken, F.lit("")), ("gelf", broken, F.lit("not a JSON object")), ("metrics", good_points, F.lit("")), ("metrics", bad_points, F.col("error")),
        ("traces", good_spans, F.lit("")), ("traces", bad_spans, F.col("error")), ("otlp", good_documents, F.lit("")), ("otlp", bad_documents, F.col("error")),
    ]
    counted = [df.select(F.lit(source).alias("source"), reason.alias("reason")) for source, df, reason in parts]
    return reduce(lambda a, b: a.unionByName(b), counted).groupBy("source", "reason").agg(F.count("*").alias("n"))


@register(
    "parse_syslog",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '∅' WHEN event_id % 3 <> 0 THEN event_type WHEN event_id % 5 <> 0 THEN concat('host', user_id % 10) ELSE '∅' END AS service,
       CASE WHEN event_id % 11 = 0 THEN 'info' ELSE ['fatal', 'fatal', 'fatal', 'error', 'warn', 'info', 'info', 'debug'][cast(event_id % 192 % 8 AS int) + 1] END AS level,
       CASE WHEN event_id % 11 = 0 THEN concat('<x> plain ', event_id) ELSE concat('''value'' of [', event_id, '] is -1') END AS message,
       CASE WHEN event_id % 11 <> 0 AND event_id % 5 <> 0 THEN concat('"host', user_id % 10, '"') ELSE '∅' END AS host FROM events""",
)
def syslog(spark, sf):
    host = F.when(key() % 5 == 0, "-").otherwise(F.concat(F.lit("host"), (F.col("user_id") % 10).cast("string")))
    app = F.when(key() % 3 == 0, "-").otherwise(F.col("event_type"))
    data = F.when(key() % 4 == 0, "-").when(key() % 4 == 1, '[x@1 a="b"]').otherwise('[x a="b"][y@2 z="1"]')
    line = F.concat(
        F.lit("<"), (key() % 192).cast("string"), F.lit(">1 "), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" "), host, F.lit(" "), app,
        F.lit(" - ID47 "), data, F.lit(" 'value' of ["), key().cast("string"), F.lit("] is -1"),
    )
    text = F.when(key() % 11 == 0, F.concat(F.lit("<x> plain "), key().cast("string"))).otherwise(line)
    parsed = LN.parse_syslog(A.spread(events(spark, sf).select("event_id", text.alias("value"))))
    missing = lambda c: F.coalesce(c, F.lit("∅"))
    return parsed.select("event_id", missing(F.col("service")).alias("service"), "level", "message", missing(F.col("extra")["host"]).alias("host"))


def _attr(key, **value):
    fields = [F.lit(None).cast("string").alias(n) if n not in value else value[n].alias(n) for n in ("stringValue", "intValue", "doubleValue")]
    flag = value.get("boolValue", F.lit(None).cast("boolean")).alias("boolValue")
    return F.struct(F.lit(key).alias("key"), F.struct(*fields, flag).alias("value"))


def _resource():
    service = F.concat(F.lit("svc_"), (F.col("user_id") % 7).cast("string"))
    return F.struct(F.array(
        _attr("service.name", stringValue=service), _attr("deployment.environment", stringValue=F.lit("prod")),
        _attr("service.version", stringValue=F.concat(F.lit("v"), key().cast("string"))), _attr("weight", intValue=F.lit("5")),
    ).alias("attributes"))


def _export(df, root, scopes, inner):
    """One export document per event with two inner records."""
    body = F.to_json(F.struct(F.array(F.struct(_resource().alias("resource"), F.array(F.struct(*inner)).alias(scopes))).alias(root)))
    return A.spread(df.select("event_id", body.alias("value")))


@register(
    "flatten_otlp_logs",
    f"""SELECT event_id, n, {_SVC} AS service, 'prod' AS environment, concat('v', event_id) AS git_sha, upper(event_type) AS level, concat('m', n) AS message,
        cast(epoch_us(ts) * 1000 + n AS string) AS timestamp, 't1' AS trace_id,
        concat('{{"deployment.environment":"prod","service.name":"', {_SVC}, '","service.version":"v', event_id, '","weight":5}}') AS resource, '"x"' AS a, '7' AS b, 'true' AS c
        FROM events, (SELECT unnest([1, 2]) AS n)""",
)
def otlp_logs(spark, sf):
    def record(n):
        return F.struct(
            (F.unix_micros("at") * 1000 + n).cast("string").alias("timeUnixNano"), F.upper("event_type").alias("severityText"),
            F.struct(F.lit(f"m{n}").alias("stringValue")).alias("body"), F.lit("t1").alias("traceId"),
            F.array(_attr("a", stringValue=F.lit("x")), _attr("b", intValue=F.lit("7")), _attr("c", boolValue=F.lit(True))).alias("attributes"),
        )

    docs = _export(events(spark, sf), "resourceLogs", "scopeLogs", [F.array(record(1), record(2)).alias("logRecords")])
    flat = O.flatten_otlp_logs(docs)
    return flat.select(
        "event_id", F.substring("message", 2, 9).cast("int").alias("n"), "service", "environment", "git_sha", "level", "message", "timestamp", "trace_id", "resource",
        *[F.col("extra")[k].alias(k) for k in "abc"],
    )


@register(
    "flatten_otlp_metrics",
    f"""SELECT event_id, {_SVC} AS service, k AS metric_type, CASE k WHEN 'gauge' THEN {r6("value")} WHEN 'sum' THEN event_id::DOUBLE ELSE 0 END AS value,
        CASE WHEN k IN ('sum', 'histogram') THEN CASE event_id % 3 WHEN 1 THEN 'delta' WHEN 2 THEN 'cumulative' ELSE '' END ELSE '' END AS temporality,
        CASE k WHEN 'sum' THEN 1 ELSE 0 END AS is_monotonic, CASE WHEN k IN ('histogram', 'exp_histogram', 'summary') THEN event_id ELSE 0 END AS count,
        CASE k WHEN 'histogram' THEN '1,2' ELSE '' END AS buckets, CASE k WHEN 'exp_histogram' THEN 3 ELSE 0 END AS scale, CASE k WHEN 'exp_histogram' THEN '4' ELSE '' END AS positive,
        'k=v;n=7;' AS series_key FROM events, (SELECT unnest(['gauge', 'sum', 'histogram', 'exp_histogram', 'summary']) AS k)""",
)
def otlp_metrics(spark, sf):
    """All five kinds of data points."""
    labels = F.array(_attr("k", stringValue=F.lit("v")), _attr("n", intValue=F.lit("7")), _attr("e", stringValue=F.lit(""))).alias("attributes")
    when = F.lit("1700000000000000000").alias("timeUnixNano")
    temporality = (key() % 3).cast("string").alias("aggregationTemporality")
    count = key().cast("string").alias("count")
    ones = F.array(F.lit("1"), F.lit("2")).alias("bucketCounts")
    points = lambda *fields: F.array(F.struct(when, labels, *fields)).alias("dataPoints")
    positive = F.struct(F.lit("1").alias("offset"), F.array(F.lit("4")).alias("bucketCounts")).alias("positive")
    kinds = {
        "gauge": [points(F.col("value").cast("string").alias("asDouble"), F.lit("1").alias("asInt"))],
        "sum": [points(key().cast("string").alias("asInt")), F.lit(True).alias("isMonotonic"), temporality],
        "histogram": [points(count, ones), temporality],
        "exponentialHistogram": [points(count, F.lit("3").alias("scale"), positive)],
        "summary": [points(count)],
    }
    docs = None
    for name, fields in kinds.items():
        metric = F.struct(F.lit("m").alias("name"), F.struct(*fields).alias(name))
        part = _export(events(spark, sf), "resourceMetrics", "scopeMetrics", [F.array(metric).alias("metrics")])
        docs = part if docs is None else docs.unionByName(part)
    flat = O.flatten_otlp_metrics(docs)
    from ..functions.fields import series_key

    return flat.select(
        "event_id", "service", "metric_type", "value", "temporality", "is_monotonic", "count", F.array_join(F.col("bucket_counts").cast("array<string>"), ",").alias("buckets"),
        "scale", F.array_join(F.col("positive_buckets").cast("array<string>"), ",").alias("positive"), series_key(F.col("attributes")).alias("series_key"),
    )


_KINDS_SQL = "['internal', 'internal', 'server', 'client', 'producer', 'consumer', 'internal'][cast(event_id % 7 AS int) + 1]"


@register(
    "flatten_otlp_traces",
    f"""SELECT event_id, {_SVC} AS service, {_KINDS_SQL} AS kind, CASE event_id % 3 WHEN 1 THEN 'ok' WHEN 2 THEN 'error' ELSE 'unset' END AS status_code,
        CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1500 END AS duration_ns, concat('v', event_id) AS git_sha, 'lib' AS scope_name, '{{"b":7,"k":"v"}}' AS attributes FROM events""",
)
def otlp_traces(spark, sf):
    start = F.unix_micros("at") * 1000
    end = F.when(key() % 5 == 0, start - 10).otherwise(start + 1500)
    span = F.struct(
        F.lit("t").alias("traceId"), F.lit("s").alias("spanId"), (key() % 7).cast("string").alias("kind"), start.cast("string").alias("startTimeUnixNano"),
        end.cast("string").alias("endTimeUnixNano"), F.struct((key() % 3).cast("string").alias("code")).alias("status"),
        F.array(_attr("k", stringValue=F.lit("v")), _attr("b", intValue=F.lit("7"))).alias("attributes"),
    )
    inner = [F.struct(F.lit("lib").alias("name")).alias("scope"), F.array(span).alias("spans")]
    flat = O.flatten_otlp_traces(_export(events(spark, sf), "resourceSpans", "scopeSpans", inner))
    return flat.select("event_id", "service", "kind", "status_code", "duration_ns", "git_sha", "scope_name", "attributes")


@register(
    "otlp_level",
    "SELECT event_id % 30 AS n, CASE WHEN event_id % 30 BETWEEN 1 AND 24 THEN ['trace', 'debug', 'info', 'warn', 'error', 'fatal'][cast((event_id % 30 - 1) // 4 AS int) + 1] ELSE 'info' END AS level, count(*) AS rows FROM events GROUP BY ALL",
)
def severity_numbers(spark, sf):
    number = key() % 30
    return events(spark, sf).select(number.alias("n"), otlp_level(number).alias("level")).groupBy("n", "level").agg(F.count("*").alias("rows"))


@register(
    "map_remote_write_series",
    f"""SELECT event_id, n, 'up' AS metric_name, CASE WHEN event_id % 2 = 0 THEN {_SVC} ELSE 'job1' END AS service, 'prod' AS environment, 'code=200;le=' || event_id % 4 || ';' AS series_key,
        cast(epoch_us(ts) // 1000 + n AS string) AS timestamp, {r6("value * n")} AS value FROM events, (SELECT unnest([1, 2]) AS n) WHERE event_id % 9 <> 0""",
)
def remote_write(spark, sf):
    from ..functions.fields import series_key

    label = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    name = F.when(key() % 9 == 0, "other").otherwise("__name__")
    service = F.when(key() % 2 == 0, "service_name").otherwise("ignored_empty")
    value = F.when(key() % 2 == 0, F.concat(F.lit("svc_"), (F.col("user_id") % 7).cast("string"))).otherwise("")
    labels = F.array(
        F.struct(name.alias("name"), F.lit("up").alias("value")), label("job", F.lit("job1")), F.struct(service.alias("name"), value.alias("value")),
        label("env", F.lit("prod")), label("code", F.lit("200")), label("le", (key() % 4).cast("string")),
    )
    sample = lambda n: F.struct((F.floor(F.unix_micros("at") / 1000).cast("bigint") + n).alias("timestamp"), (F.col("value") * n).alias("value"), F.lit(n).alias("n"))
    series = events(spark, sf).select("event_id", "at", labels.alias("labels"), F.array(sample(1), sample(2)).alias("samples"))
    mapped = O.map_remote_write_series(series)
    n = F.col("timestamp").cast("bigint") - F.floor(F.unix_micros("at") / 1000).cast("bigint")
    return mapped.select("event_id", n.alias("n"), "metric_name", "service", "environment", series_key(F.col("attributes")).alias("series_key"), "timestamp", "value")


@register(
    "build_metric_points",
    f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {_SVC} ELSE 'unknown' END AS service, 'gauge' AS metric_type, CASE WHEN event_id % 5 IN (1, 2, 3) THEN 0 ELSE {r6("value")} END AS value,
        epoch_us(ts) AS timestamp, epoch_us(ts) * 1000 + 5 AS ts_ns, 0 AS start_timestamp, 9 AS _retention_days FROM events WHERE event_id % 7 <> 0""",
)
def metric_points(spark, sf):
    """Nameless points dropped, non-finite values zero, defaults filled."""
    odd = F.when(key() % 5 == 1, float("nan")).when(key() % 5 == 2, float("inf")).when(key() % 5 == 3, float("-inf")).otherwise(F.col("value"))
    points = events(spark, sf).select(
        key().cast("string").alias("id"), "tenant_id", F.when(key() % 7 == 0, "").otherwise("m").alias("metric_name"), odd.alias("value"),
        F.when(key() % 2 == 0, F.concat(F.lit("svc_"), (F.col("user_id") % 7).cast("string"))).otherwise("").alias("service"),
        (F.unix_micros("at") * 1000 + 5).cast("string").alias("timestamp"),
    )
    built = R.build_metric_points(points, CONFIG)
    return built.select(F.col("id").cast("bigint").alias("event_id"), "service", "metric_type", "value", "timestamp", "ts_ns", "start_timestamp", "_retention_days")


@register(
    "build_spans",
    f"""SELECT event_id, 'internal' AS kind, 'unset' AS status_code, 'unknown' AS service, epoch_us(ts) AS start_time, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) + 3 ELSE epoch_us(ts) END AS end_time,
        'nowhere' AS parent_span_id FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0""",
)
def spans(spark, sf):
    """Spans without ids dropped, broken parents kept, end defaults to start."""
    start = F.unix_micros("at")
    rows = events(spark, sf).select(
        key().cast("string").alias("id"), "tenant_id", F.when(key() % 7 == 0, "").otherwise("t").alias("trace_id"), F.when(key() % 5 != 0, "s").alias("span_id"),
        F.lit("nowhere").alias("parent_span_id"), start.cast("string").alias("start_time"), F.when(key() % 2 == 0, (start + 3).cast("string")).alias("end_time"),
    )
    built = R.build_spans(rows, CONFIG)
    return built.select(F.col("id").cast("bigint").alias("event_id"), "kind", "status_code", "service", "start_time", "end_time", "parent_span_id")


@register(
    "build_change_events",
    f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'flag' ELSE 'deploy' END AS kind, CASE WHEN event_id % 3 = 0 THEN epoch_us({NOW}) ELSE epoch_us(ts) END AS timestamp,
        '{{}}' AS metadata, 90 AS _retention_days FROM events""",
)
def change_rows(spark, sf):
    rows = events(spark, sf).select(
        key().cast("string").alias("id"), "tenant_id", F.when(key() % 2 == 0, "flag").otherwise("").alias("kind"), F.when(key() % 3 != 0, F.col("at")).alias("timestamp")
    )
    return R.build_change_events(rows, AS_OF).select(F.col("id").cast("bigint").alias("event_id"), "kind", "timestamp", "metadata", "_retention_days")


@register(
    "normalize_change_webhooks",
    """WITH e AS (SELECT event_id, event_id % 10 AS k, event_type AS t, concat('sha', event_id) AS sha, concat('u', user_id) AS u FROM events)
       SELECT event_id, CASE WHEN k IN (0, 1, 2, 4, 5) THEN t ELSE '' END AS service, CASE WHEN k IN (0, 5) THEN 'prod' ELSE '' END AS environment,
         CASE WHEN k IN (8, 9) THEN '' WHEN k = 7 THEN 'flag' ELSE 'deploy' END AS kind, CASE WHEN k IN (7, 8, 9) THEN '' ELSE sha END AS git_sha,
         CASE WHEN k IN (0, 1, 5) THEN cast(event_id AS string) ELSE '' END AS deploy_id, CASE WHEN k = 7 THEN t ELSE '' END AS flag_key, CASE WHEN k IN (8, 9) THEN '' ELSE u END AS author,
         CASE k WHEN 0 THEN 'Deployment of main to prod' WHEN 1 THEN concat('Workflow "ci" succeeded on ', t) WHEN 2 THEN 'Push to v1' WHEN 4 THEN 'Pipeline succeeded on (unknown)'
           WHEN 5 THEN 'Deployment to prod' WHEN 7 THEN concat('Flag ', t, ' turned on') ELSE '' END AS title,
         CASE k WHEN 8 THEN 'unknown provider svn' WHEN 9 THEN 'github payload is not a JSON object' ELSE '' END AS error
       FROM e WHERE k NOT IN (3, 6)""",
)
def webhooks(spark, sf):
    """Deployments, workflow runs, pushes, pipelines, flags, ignored events and bad bodies."""
    k = key() % 10
    sha, user, t = F.concat(F.lit("sha"), key().cast("string")), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_type")
    named = lambda value: F.struct(value.alias("name"))
    login = F.struct(user.alias("login"))
    deployment = F.to_json(F.struct(named(t).alias("repository"), F.struct(
        key().alias("id"), sha.alias("sha"), F.lit("refs/heads/main").alias("ref"), F.lit("prod").alias("environment"), login.alias("creator")).alias("deployment")))
    run = lambda conclusion: F.to_json(F.struct(named(t).alias("repository"), F.struct(
        key().alias("id"), F.lit("ci").alias("name"), sha.alias("head_sha"), t.alias("head_branch"), F.lit(conclusion).alias("conclusion"), login.alias("actor")).alias("workflow_run")))
    push = F.to_json(F.struct(named(t).alias("repository"), named(user).alias("pusher"), F.lit("refs/tags/v1").alias("ref"), F.lit("").alias("after"), F.struct(sha.alias("id")).alias("head_commit")))
    pipeline = lambda status: F.to_json(F.struct(F.lit("pipeline").alias("object_kind"), named(t).alias("project"), named(user).alias("user"),
                                                 F.struct(sha.alias("sha"), F.lit("").alias("ref"), F.lit(status).alias("status")).alias("object_attributes")))
    release = F.to_json(F.struct(F.lit("deployment").alias("object_kind"), F.lit("success").alias("status"), sha.alias("sha"), F.lit("prod").alias("environment"),
                                 key().alias("deployable_id"), named(t).alias("project"), named(user).alias("user")))
    flag = F.to_json(F.struct(F.lit("flag").alias("kind"), t.alias("name"), F.lit("turned on").alias("titleVerb"), F.struct(user.alias("email")).alias("member")))
    bodies = [deployment, run("success"), push, run("failure"), pipeline("success"), release, pipeline("failed"), flag, deployment, F.lit("[1]")]
    providers = F.array(*map(F.lit, ["GitHub", "github", "github", "github", "gitlab", "gitlab", "gitlab", "ld", "svn", "github"]))
    kinds = F.array(*map(F.lit, ["deployment", "workflow_run", "push", "workflow_run", "", "", "", "", "deployment", "push"]))
    at = (k + 1).cast("int")
    body = reduce(lambda chosen, n: chosen.when(k == n, bodies[n]), range(1, len(bodies)), F.when(k == 0, bodies[0]))  # only the row's own is built
    dealt = A.spread(events(spark, sf).select("event_id", "user_id", "event_type"))
    rows = dealt.select("event_id", F.element_at(providers, at).alias("provider"), F.element_at(kinds, at).alias("event_type"), settled(body).alias("payload"))
    out = normalize_change_webhooks(rows)
    return out.select("event_id", "service", "environment", "kind", "git_sha", "deploy_id", "flag_key", "author", "title", F.coalesce("error", F.lit("")).alias("error"))


STEPS = [
    {"set": "a.b", "to": Call("upcase", Path("kind"))},
    {"set": "n", "to": Call("to_int", Path("value"))},
    {"set": "bad", "to": Call("to_float", Path("kind"))},
    {"del": "drop.me"},
    {"redact": "secret"},
    {"redact": "absent"},
    {"rename": "old", "to": "fresh.name"},
    {"set": "who", "to": Call("coalesce", Path("nobody"), Path("blank"), Call("concat", "u", Path("uid")))},
    {"if": (">", "value", 50), "then": {"route": "metrics"}},
    {"if": ("absent", "nobody"), "then": {"set": "checked", "to": True}},
    {"if": ("==", "kind", "click"), "then": {"route": "nowhere"}},
]


@register(
    "apply_remap",
    f"""SELECT event_id, upper(event_type) AS a_b, cast(trunc(value) AS bigint) AS n, '[REDACTED]' AS secret, 'x' AS fresh, concat('u', user_id) AS who, 'true' AS checked, '{{}}' AS dropped,
        CASE WHEN value > 50 THEN 'metrics' ELSE 'logs' END AS route_to, CASE WHEN event_type = 'click' THEN 9 ELSE 10 END AS remap_applied,
        CASE WHEN event_type = 'click' THEN 'to_float: not a number,route: unknown table `nowhere`' ELSE 'to_float: not a number' END AS remap_errors FROM events""",
)
def remapped(spark, sf):
    payload = F.to_json(F.struct(
        F.col("event_type").alias("kind"), F.col("value").cast("string").alias("value"), F.struct(F.lit(1).alias("me")).alias("drop"), F.lit("s3cret").alias("secret"),
        F.lit("x").alias("old"), F.lit("").alias("blank"), F.col("user_id").alias("uid"),
    ))
    dealt = A.spread(events(spark, sf).select("event_id", "event_type", "value", "user_id"))
    out = apply_remap(dealt.select("event_id", payload.alias("payload")), STEPS, default_route="logs")
    read = lambda path: F.get_json_object("payload", path)
    return out.filter(read("$.old").isNull() & read("$.bad").isNull()).select(
        "event_id", read("$.a.b").alias("a_b"), read("$.n").cast("bigint").alias("n"), read("$.secret").alias("secret"), read("$.fresh.name").alias("fresh"),
        read("$.who").alias("who"), read("$.checked").alias("checked"), read("$.drop").alias("dropped"), "route_to", "remap_applied", "remap_errors",
    )


@register(
    "write_signal",
    """SELECT tenant_id, strftime("timestamp", '%Y%m') AS month, count(*) AS n, count(DISTINCT id) AS ids FROM {logs} GROUP BY ALL""",
)
def stored(spark, sf):
    """Two overlapping appends, each with repeated rows, stored once."""
    base = scratch(spark)
    logs = conform(A.logs(spark, sf), "logs")
    S.write_signal(logs.filter(F.col("id").cast("bigint") % 3 != 0).unionByName(logs.filter(F.col("level") == "error")), base, "logs")
    S.write_signal(logs, base, "logs")
    return S.read_signal(spark, base, "logs").groupBy("tenant_id", F.date_format("timestamp", "yyyyMM").alias("month")).agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("ids")
    )


@register(
    "read_signal",
    f"""SELECT service, count(*) AS n FROM {{logs}} WHERE tenant_id = '{TENANT}' AND "timestamp" >= TIMESTAMP '2024-01-10' AND "timestamp" <= TIMESTAMP '2024-01-20' GROUP BY service""",
)
def read_back(spark, sf):
    base = scratch(spark)
    S.write_signal(conform(A.logs(spark, sf), "logs"), base, "logs")
    rows = S.read_signal(spark, base, "logs", TENANT, "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    return rows.groupBy("service").agg(F.count("*").alias("n"))


@register(
    "export_result",
    f"""SELECT fmt, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT id, unnest(['csv', 'ndjson', 'json']) AS fmt FROM {{metrics}} WHERE tenant_id = '{TENANT}') GROUP BY fmt""",
)
def exported(spark, sf):
    """The same result in all three formats, read back."""
    base = scratch(spark)
    rows = A.metrics(spark, sf).filter(F.col("tenant_id") == TENANT)
    for fmt in ("csv", "ndjson", "json"):
        S.export_result(rows, f"{base}/{fmt}", fmt)
    back = {
        "csv": spark.read.option("header", True).csv(f"{base}/csv"), "ndjson": spark.read.schema("id string").json(f"{base}/ndjson"),
        "json": spark.read.schema("id string").option("multiLine", True).json(f"{base}/json"),
    }
    out = None
    for fmt, df in back.items():
        part = df.select(F.lit(fmt).alias("fmt"), "id")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("fmt").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def _dead(spark, sf):
    """Every seventh event as a dead letter."""
    failed = events(spark, sf).select(
        "tenant_id", F.col("props").alias("payload"), F.col("at").alias("created_at"), key().cast("string").alias("event"), F.when(key() % 7 == 0, F.concat(F.lit("error "), key().cast("string"))).alias("error")
    )
    return S.split_dead_letters(failed)


@register(
    "split_dead_letters",
    f"""SELECT {_TEN} AS tenant_id, event_id % 7 = 0 AS dead, count(*) AS n FROM events GROUP BY ALL""",
)
def dead_letters(spark, sf):
    good, dead = _dead(spark, sf)
    both = good.select("tenant_id", F.lit(False).alias("dead")).unionByName(dead.filter("status = 'pending' AND attempt = 1").select("tenant_id", F.lit(True).alias("dead")))
    return both.groupBy("tenant_id", "dead").agg(F.count("*").alias("n"))


_DLQ = f"""d AS (SELECT {_TEN} AS tenant_id, props AS payload, concat('error ', event_id) AS error, ts, sha256(concat({_TEN}, '|', props, '|error ', event_id)) AS id FROM events WHERE event_id % 7 = 0)"""


@register(
    "dlq_list",
    f"""WITH {_DLQ} SELECT id, payload, error, epoch_us(ts) AS created_at, (SELECT count(*) FROM d WHERE tenant_id = '{TENANT}') AS total FROM d WHERE tenant_id = '{TENANT}'""",
)
def dlq(spark, sf):
    return S.dlq_list(_dead(spark, sf)[1], TENANT, "pending").select("id", "payload", "error", "created_at", "total")


@register(
    "dlq_replay",
    f"""SELECT CASE WHEN {_TEN} = '{TENANT}' AND event_id % 21 = 0 THEN 'dropped' WHEN {_TEN} = '{TENANT}' THEN 'replayed' ELSE 'pending' END AS status,
        CASE WHEN {_TEN} = '{TENANT}' AND event_id % 21 <> 0 THEN 2 ELSE 1 END AS attempt, count(*) AS n FROM events WHERE event_id % 7 = 0 GROUP BY ALL""",
)
def replayed(spark, sf):
    """Some letters dropped, then all of the tenant replayed: dropped ones stay dropped."""
    _, dead = _dead(spark, sf)
    dead = dead.withColumn("number", F.substring("error", 7, 20).cast("bigint"))
    mine = dead.filter(F.col("tenant_id") == TENANT)
    third = mine.filter(F.col("number") % 21 == 0)
    letters, _ = S.dlq_replay(S.dlq_drop(dead, TENANT, third), TENANT, mine)
    return letters.groupBy("status", "attempt").agg(F.count("*").alias("n"))
