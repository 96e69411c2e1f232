"""Metric and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fields import series_key
from ..functions.times import time_bucket
from ..operators import forecast as FC
from ..operators import metrics as M
from ..sources import adapters as A
from .base import DAY, NOW, TENANT, r6, register, rn

AS_OF = A.AS_OF
START = "2024-01-01 00:00:00"
METRIC = "app.click"
RANGE = f""" tenant_id = '{TENANT}' AND metric_name = '{METRIC}' AND "timestamp" >= TIMESTAMP '{START}' AND "timestamp" <= {NOW}"""
BUCKET = f"""(epoch_us("timestamp") // 1000000 // {DAY} * {DAY})"""


def keyed(df):
    return df.withColumn("series_key", series_key(F.col("attributes"))).drop("attributes")


@register(
    "time_bucket",
    """SELECT tenant_id, epoch_us("timestamp") // 900000000 * 900000000 AS bucket, count(*) AS n FROM {metrics} GROUP BY ALL""",
)
def buckets(spark, sf):
    return A.metrics(spark, sf).groupBy("tenant_id", time_bucket("timestamp", 900).alias("bucket")).agg(F.count("*").alias("n"))


@register(
    "label_matchers",
    f"""SELECT service, label_k AS k, count(*) AS n FROM {{metrics}} WHERE tenant_id = '{TENANT}' AND metric_name = '{METRIC}'
        AND regexp_full_match(service, 'svc_[0-3]') AND label_k <> '4' AND NOT regexp_full_match(environment, 'pr.*') GROUP BY ALL""",
)
def matched(spark, sf):
    """All four matcher kinds; a missing label satisfies a negative one."""
    matchers = [("__name__", "=", METRIC), ("service", "=~", "svc_[0-3]"), ("k", "!=", "4"), ("env", "!~", "pr.*"), ("none", "!=", "x")]
    rows = M.label_matchers(A.metrics(spark, sf).filter(F.col("tenant_id") == TENANT), matchers)
    return rows.groupBy("service", M.metric_label("k").alias("k")).agg(F.count("*").alias("n"))


@register(
    "instant_vector",
    f"""SELECT service, environment, concat('k=', label_k, ';') AS series_key, {BUCKET} AS bucket, '{METRIC}' AS metric_name,
        {r6("arg_max(value, (epoch_us(\"timestamp\"), id))")} AS value FROM {{metrics}}
        WHERE tenant_id = '{TENANT}' AND metric_name = '{METRIC}' AND "timestamp" >= {NOW} - INTERVAL 2 DAY AND "timestamp" <= {NOW}
        AND service <> 'svc_0' GROUP BY service, environment, label_k, epoch_us("timestamp") // 1000000 // 172800, bucket"""
    .replace(f"{BUCKET} AS bucket", """(epoch_us("timestamp") // 1000000 // 172800 * 172800) AS bucket"""),
)
def instant(spark, sf):
    return keyed(M.instant_vector(A.metrics(spark, sf), TENANT, METRIC, [("service", "!=", "svc_0")], AS_OF, 2 * DAY))


@register(
    "range_vector",
    f"""SELECT service, environment, concat('k=', label_k, ';') AS series_key, {BUCKET} AS bucket, '{METRIC}' AS metric_name,
        {r6("arg_max(value, (epoch_us(\"timestamp\"), id))")} AS value FROM {{metrics}} WHERE {RANGE} GROUP BY service, environment, label_k, bucket""",
)
def ranged(spark, sf):
    return keyed(M.range_vector(A.metrics(spark, sf), TENANT, METRIC, start=START, end=AS_OF, step=DAY))


@register(
    "counter_rate",
    f"""SELECT service, environment, concat('k=', label_k, ';') AS series_key, {BUCKET} AS bucket, '{METRIC}' AS metric_name,
        {r6("(max(value) - min(value)) / 300.0::DOUBLE")} AS value FROM {{metrics}} WHERE {RANGE} GROUP BY service, environment, label_k, bucket""",
)
def rate(spark, sf):
    return keyed(M.counter_rate(A.metrics(spark, sf), TENANT, METRIC, start=START, end=AS_OF, step=DAY, range_sec=300))


@register(
    "aggregate_by",
    f"""WITH v AS (SELECT service, environment, label_k, {BUCKET} AS bucket, arg_max(value, (epoch_us("timestamp"), id)) AS v
          FROM {{metrics}} WHERE {RANGE} GROUP BY service, environment, label_k, bucket)
        SELECT service, k, bucket, fn, value FROM (
          SELECT service, label_k AS k, bucket, 'sum' AS fn, {r6("sum(v)")} AS value FROM v GROUP BY service, label_k, bucket
          UNION ALL SELECT service, '' AS k, bucket, 'avg', {r6("avg(v)")} FROM v GROUP BY service, bucket
          UNION ALL SELECT '' AS service, '' AS k, bucket, 'count', count(*)::DOUBLE FROM v GROUP BY bucket
          UNION ALL SELECT '{METRIC}' AS service, '' AS k, bucket, 'max', {r6("max(v)")} FROM v GROUP BY bucket)""",
)
def across(spark, sf):
    vector = M.range_vector(A.metrics(spark, sf), TENANT, METRIC, start=START, end=AS_OF, step=DAY)
    blank = F.lit("")
    parts = [
        M.aggregate_by(vector, "sum", ["service", "k"]).withColumn("fn", F.lit("sum")),
        M.aggregate_by(vector, "avg", ["service"]).withColumns({"k": blank, "fn": F.lit("avg")}),
        M.aggregate_by(vector, "count").withColumns({"service": blank, "k": blank, "fn": F.lit("count")}),
        M.aggregate_by(vector, "max", ["__name__"]).withColumnRenamed("__name__", "service").withColumns({"k": blank, "fn": F.lit("max")}),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@register(
    "label_cardinality",
    f"""SELECT tenant_id, metric_name, count(DISTINCT label_k) AS cardinality FROM {{metrics}}
        WHERE "timestamp" > {NOW} - INTERVAL 10 DAY AND "timestamp" <= {NOW} GROUP BY ALL""",
)
def cardinality(spark, sf):
    return M.label_cardinality(A.metrics(spark, sf), AS_OF, 10 * DAY)


_ROLLUP = f"""SELECT tenant_id, service, environment, metric_name, metric_type, concat('k=', label_k, ';') AS series_key,
    epoch_us("timestamp") // GRAIN * GRAIN AS bucket, {r6("sum(value)")} AS value_sum, {r6("min(value)")} AS value_min,
    {r6("max(value)")} AS value_max, count(*) AS sample_count, 0 AS histo_count, 0.0::DOUBLE AS histo_sum EXTRA
    FROM {{metrics}} GROUP BY tenant_id, service, environment, metric_name, metric_type, label_k, bucket"""


@register("rollup_metrics", _ROLLUP.replace("GRAIN", "300000000").replace("EXTRA", ""))
def rollup(spark, sf):
    return keyed(M.rollup_metrics(A.metrics(spark, sf), "5 minutes"))


@register("merge_rollup", _ROLLUP.replace("GRAIN", "3600000000").replace("EXTRA", f", {r6('avg(value)')} AS value_avg"))
def rerolled(spark, sf):
    """One-hour finals out of five-minute states."""
    return keyed(M.read_rollup(M.merge_rollup(M.rollup_metrics(A.metrics(spark, sf), "5 minutes"), "1 hour")))


@register(
    "series_matrix",
    f"""WITH v AS (SELECT service, environment, label_k, {BUCKET} AS bucket, arg_max(value, (epoch_us("timestamp"), id)) AS v
          FROM {{metrics}} WHERE {RANGE} GROUP BY service, environment, label_k, bucket),
        named AS (SELECT bucket, v, concat('__name__={METRIC};', CASE WHEN environment <> '' THEN concat('environment=', environment, ';') ELSE '' END,
          'k=', label_k, ';service=', service, ';') AS series_key FROM v),
        paged AS (SELECT *, (row_number() OVER (PARTITION BY series_key ORDER BY bucket) - 1) // 4 AS page FROM named)
        SELECT series_key, page, string_agg(concat(bucket, ':', cast(round(v * 100) AS BIGINT)), ' ' ORDER BY bucket) AS points
        FROM paged GROUP BY series_key, page""",
)
def matrix(spark, sf):
    vector = M.range_vector(A.metrics(spark, sf), TENANT, METRIC, start=START, end=AS_OF, step=DAY)
    point = lambda p: F.concat(p["ts"].cast("string"), F.lit(":"), F.round(p["value"] * 100).cast("bigint").cast("string"))
    return M.to_matrix(vector, page_size=4).select("series_key", "page", F.array_join(F.transform("values", point), " ").alias("points"))


@register(
    "series_vector",
    f"""SELECT concat('__name__={METRIC};', CASE WHEN environment <> '' THEN concat('environment=', environment, ';') ELSE '' END,
          'k=', label_k, ';service=', service, ';') AS series_key, (epoch_us("timestamp") // 1000000 // 172800 * 172800) AS ts,
          {r6("arg_max(value, (epoch_us(\"timestamp\"), id))")} AS value FROM {{metrics}}
        WHERE tenant_id = '{TENANT}' AND metric_name = '{METRIC}' AND "timestamp" >= {NOW} - INTERVAL 2 DAY AND "timestamp" <= {NOW}
        GROUP BY series_key, ts""",
)
def vector(spark, sf):
    points = M.to_vector(M.instant_vector(A.metrics(spark, sf), TENANT, METRIC, (), AS_OF, 2 * DAY))
    return points.select("series_key", F.col("value.ts").alias("ts"), F.col("value.value").alias("value"))


_SERIES = f"""b AS (SELECT tenant_id, service, metric_name, {BUCKET} AS bucket, avg(value) AS v FROM {{metrics}}
      WHERE "timestamp" > {NOW} - INTERVAL {288 * DAY} SECOND AND "timestamp" <= {NOW} GROUP BY tenant_id, service, metric_name, bucket),
    s AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, service, metric_name ORDER BY bucket) - 1 AS idx,
      count(*) OVER (PARTITION BY tenant_id, service, metric_name) AS n FROM b)"""
_KEYS = "tenant_id, service, metric_name"


@register(
    "linear_trend",
    f"""WITH {_SERIES} SELECT {_KEYS}, count(*) AS points, {r6("CASE WHEN count(*) >= 2 THEN regr_slope(v, idx) ELSE 0 END")} AS slope,
        {r6("CASE WHEN count(*) >= 2 THEN regr_intercept(v, idx) ELSE max(v) END")} AS intercept FROM s GROUP BY {_KEYS}""",
)
def trend(spark, sf):
    return FC.linear_trend(FC.bucketed_series(A.metrics(spark, sf), AS_OF, DAY))


@register(
    "ewma",
    f"""WITH RECURSIVE {_SERIES}, e AS (SELECT {_KEYS}, idx, n, v AS level FROM s WHERE idx = 0 UNION ALL
          SELECT s.tenant_id, s.service, s.metric_name, s.idx, s.n, 0.3 * s.v + 0.7 * e.level FROM e JOIN s
          ON s.tenant_id = e.tenant_id AND s.service = e.service AND s.metric_name = e.metric_name AND s.idx = e.idx + 1)
        SELECT {_KEYS}, {r6("level")} AS ewma FROM e WHERE idx = n - 1""",
)
def smoothed(spark, sf):
    return FC.ewma(FC.bucketed_series(A.metrics(spark, sf), AS_OF, DAY))


@register(
    "seasonal_baseline",
    f"""WITH {_SERIES} SELECT {_KEYS}, {r6("avg(v)")} AS seasonal_baseline FROM s WHERE (n - idx) % 7 = 0 GROUP BY {_KEYS}""",
)
def seasonal(spark, sf):
    return FC.seasonal_baseline(FC.bucketed_series(A.metrics(spark, sf), AS_OF, DAY), 7)


_RESET = f"""d AS (SELECT tenant_id, service, epoch_us(max("timestamp")) // 1000000 AS deployed FROM {{changes}}
      WHERE kind = 'deploy' AND "timestamp" > {NOW} - INTERVAL {{LOOKBACK}} SECOND AND "timestamp" <= {NOW} GROUP BY ALL),
    r AS (SELECT s.*, CASE WHEN f > 0 THEN f ELSE -1 END AS reset FROM (SELECT s.*, min(CASE WHEN bucket >= deployed THEN idx END)
      OVER (PARTITION BY s.tenant_id, s.service, s.metric_name) AS f FROM s LEFT JOIN d USING (tenant_id, service)) s)"""


@register(
    "deploy_reset",
    f"""WITH {_SERIES}, {_RESET.replace('{LOOKBACK}', str(288 * DAY))}
        SELECT {_KEYS}, max(reset) AS reset FROM r GROUP BY {_KEYS}""",
)
def resets(spark, sf):
    series = FC.bucketed_series(A.metrics(spark, sf), AS_OF, DAY)
    marked = FC.deploy_reset(series, A.change_events(spark, sf), AS_OF, 288 * DAY)
    return marked.groupBy(*FC.SERIES).agg(F.max("reset").alias("reset"))


_TTT = "CASE WHEN thr = cur THEN 0.0 WHEN slope = 0 OR (thr - cur > 0) <> (slope > 0) THEN NULL ELSE (thr - cur) / slope END"


@register(
    "time_to_threshold",
    f"""WITH {_SERIES}, t AS (SELECT {_KEYS}, arg_max(v, idx) AS cur, CASE WHEN count(*) >= 2 THEN regr_slope(v, idx) ELSE 0 END AS slope,
          90.0::DOUBLE AS thr FROM s GROUP BY {_KEYS})
        SELECT {_KEYS}, {r6(_TTT, 4)} AS steps FROM t""",
)
def breach(spark, sf):
    series = FC.bucketed_series(A.metrics(spark, sf), AS_OF, DAY)
    slope, _ = FC.trend_columns(F.col("v"), F.col("idx"))
    stats = series.groupBy(*FC.SERIES).agg(slope.alias("slope"), F.max_by("v", "idx").alias("current"))
    steps = FC.round_n(FC.time_to_threshold(F.col("current"), F.col("slope"), F.lit(90.0)), 4)
    return stats.select(*FC.SERIES, steps.alias("steps"))


HOURS6 = 21600
_CAPACITY_SERIES = (
    _SERIES.replace(BUCKET, f"""(epoch_us("timestamp") // 1000000 // {HOURS6} * {HOURS6})""").replace(str(288 * DAY), str(288 * HOURS6))
)


@register(
    "forecast_capacity",
    f"""WITH RECURSIVE {_CAPACITY_SERIES}, {_RESET.replace('{LOOKBACK}', str(288 * HOURS6))},
        u AS (SELECT *, idx - greatest(reset, 0) AS i, n - greatest(reset, 0) AS m FROM r),
        e AS (SELECT {_KEYS}, i, m, v AS level FROM u WHERE i = 0 UNION ALL
          SELECT u.tenant_id, u.service, u.metric_name, u.i, u.m, 0.3 * u.v + 0.7 * e.level FROM e JOIN u
          ON u.tenant_id = e.tenant_id AND u.service = e.service AND u.metric_name = e.metric_name AND u.i = e.i + 1),
        t AS (SELECT {_KEYS}, max(n) AS points, max(reset) AS reset, max(m) AS m, arg_max(v, idx) AS cur,
          CASE WHEN max(m) >= 2 THEN regr_slope(v, i) FILTER (i >= 0) ELSE 0 END AS slope,
          CASE WHEN max(m) >= 2 THEN regr_intercept(v, i) FILTER (i >= 0) ELSE max(v) FILTER (i >= 0) END AS icept,
          avg(v) FILTER ((n - idx) % 4 = 0 AND idx >= greatest(reset, 0)) AS season, 60.0::DOUBLE AS thr FROM u GROUP BY {_KEYS})
        SELECT t.tenant_id, t.service, t.metric_name, points, CASE WHEN points >= 2 THEN reset ELSE -1 END AS deploy_reset_index,
          {r6("cur")} AS current,
          CASE WHEN points >= 2 THEN {r6("slope")} ELSE 0 END AS slope, CASE WHEN points >= 2 THEN {r6("icept")} ELSE {r6("cur")} END AS intercept,
          CASE WHEN points >= 2 THEN {r6("slope * (m - 1 + 12) + icept")} ELSE {r6("cur")} END AS projected_value,
          CASE WHEN points >= 2 THEN {r6("level")} ELSE 0 END AS ewma,
          CASE WHEN points >= 2 THEN {r6("season")} END AS seasonal_baseline,
          CASE WHEN points >= 2 THEN {rn("(cur - season) / greatest(abs(season), 1)", 4)} END AS deviation, thr AS threshold,
          CASE WHEN points >= 2 THEN ({_TTT}) IS NOT NULL ELSE false END AS will_breach,
          CASE WHEN points >= 2 THEN {rn(_TTT, 4)} END AS time_to_threshold,
          CASE WHEN points >= 2 THEN {rn(f"({_TTT}) * {HOURS6}", 2)} END AS time_to_threshold_seconds,
          CASE WHEN points >= 2 THEN '' ELSE 'insufficient history for a trend (need >= 2 windows)' END AS note
        FROM t JOIN (SELECT {_KEYS}, level FROM e WHERE i = m - 1) l USING ({_KEYS})""",
)
def capacity(spark, sf):
    return FC.forecast_capacity(A.metrics(spark, sf), A.change_events(spark, sf), AS_OF, HOURS6, 12, 60.0, buckets=288)
