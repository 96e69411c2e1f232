"""Streams over files written from the test tables, drained with ``availableNow``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import series_key
from ..operators import logs as L
from ..operators.alerts import AlertRule
from ..operators.scope import all_of
from ..session import checkpoint_root
from ..sources import adapters as A
from ..sources.records import IngestConfig
from ..sources.remap import Call, Path
from ..sources.signals import read_signal
from ..streaming import alerts as SA
from ..streaming import incidents as SC
from ..streaming import ingest as SI
from ..streaming import rollups as SR
from ..streaming.files import read_files, write_batches
from ..streaming.states import live_states
from .alerting import _ISLANDS
from .base import DAY, NOW, TENANT, r6, register

AS_OF = A.AS_OF
FILES = 4


def scratch(spark: SparkSession) -> str:
    """A new folder next to the checkpoints."""
    return f"{checkpoint_root(spark)}/watchtide-{uuid.uuid4().hex}"


def as_stream(df: DataFrame, folder: str, order: str = "timestamp", files: int = FILES, per_trigger: int = 2, shuffled: bool = False) -> DataFrame:
    """``df`` written as files and read back as a stream: one after the other in time order, or ``shuffled`` by a hash of the row.

    A shuffled batch holds the rows of ``per_trigger`` of twice ``files`` parts, each cut finer where there are more cores, so
    that all of them read the batch.
    """
    if shuffled:
        at = [F.col(c) for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")]
        finer = -(-df.sparkSession.sparkContext.defaultParallelism // per_trigger)
        df.repartition(2 * files * finer, F.xxhash64(*at)).write.parquet(folder)
        return read_files(df.sparkSession, folder, df.schema, per_trigger * finer)
    cuts = df.select(F.unix_micros(order).alias("_at") if order != "event_id" else F.col(order).alias("_at"))
    edges = cuts.agg(F.percentile_approx("_at", [i / files for i in range(1, files)])).first()[0]
    at = F.unix_micros(order) if order != "event_id" else F.col(order)
    for low, high in zip([None, *edges], [*edges, None]):
        part = df if low is None else df.filter(at > low)
        part = part if high is None else part.filter(at <= high)
        part.coalesce(1).write.mode("append").parquet(folder)
    return read_files(df.sparkSession, folder, df.schema, per_trigger)


def drained(df: DataFrame, folder: str, mode: str) -> DataFrame:
    query = write_batches(df, f"{folder}/out", f"{folder}/checkpoint", mode, available_now=True)
    query.awaitTermination()
    return df.sparkSession.read.parquet(f"{folder}/out")


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The newest state of each key of an update-mode stream."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_now"))
    return newest.select(*keys, "_now.*").drop("batch_id")


@register(
    "stream_live_tail",
    f"""SELECT id, service, level FROM {{logs}} WHERE tenant_id = '{TENANT}' AND level IN ('warn', 'error')
        AND cast(json_extract_string(body, '$.k') AS DOUBLE) < 10""",
)
def tail(spark, sf):
    folder = scratch(spark)
    stream = as_stream(A.logs(spark, sf), f"{folder}/in", shuffled=True)
    predicate = all_of(L.tail_predicate("level", ">=", "warn"), L.tail_predicate("body.k", "<", 10))
    return drained(SI.live_tail(stream, TENANT, predicate), folder, "append").select("id", "service", "level")


@register("stream_dedup", "SELECT tenant_id, count(*) AS n FROM {logs} GROUP BY tenant_id")
def dedup(spark, sf):
    """Every record delivered twice, in no order, kept once."""
    folder = scratch(spark)
    logs = A.logs(spark, sf)
    stream = as_stream(logs.unionByName(logs), f"{folder}/in", shuffled=True)
    return drained(SI.dedup_stream(stream), folder, "append").groupBy("tenant_id").agg(F.count("*").alias("n"))


@register(
    "stream_rollups",
    f"""SELECT tenant_id, service, environment, metric_name, metric_type, concat('k=', label_k, ';') AS series_key,
        epoch_us("timestamp") // 3600000000 * 3600000000 AS bucket, {r6("sum(value)")} AS value_sum, {r6("min(value)")} AS value_min,
        {r6("max(value)")} AS value_max, count(*) AS sample_count, 0 AS histo_count, 0.0::DOUBLE AS histo_sum
        FROM {{metrics}} GROUP BY tenant_id, service, environment, metric_name, metric_type, label_k, bucket""",
)
def rollups(spark, sf):
    """Rows come in no order at all, so most are days late."""
    folder = scratch(spark)
    stream = as_stream(A.metrics(spark, sf), f"{folder}/in", shuffled=True)
    SR.stream_rollups(stream, f"{folder}/out", f"{folder}/checkpoint", "1 hour", available_now=True).awaitTermination()
    out = SR.read_rollups(live_states(spark, f"{folder}/out"), "1 hour")
    return out.withColumn("series_key", series_key(F.col("attributes"))).drop("attributes")


@register(
    "stream_rate_windows",
    """SELECT tenant_id, w AS window_start, n AS requests, n > 2 AS exceeded, greatest(2 - n, 0) AS remaining, w + 60 AS reset_at FROM
       (SELECT tenant_id, epoch_us("timestamp") // 60000000 * 60 AS w, count(*) AS n FROM {logs} GROUP BY ALL)""",
)
def rates(spark, sf):
    """Rows come in no order at all, so most are days late."""
    folder = scratch(spark)
    stream = as_stream(A.logs(spark, sf).select("tenant_id", "timestamp"), f"{folder}/in", shuffled=True)
    SR.stream_rate_windows(stream, f"{folder}/out", f"{folder}/checkpoint", available_now=True).awaitTermination()
    return SR.read_rate_windows(live_states(spark, f"{folder}/out"), 2)


CYCLE = 21600
STREAM_RULES = [
    AlertRule("a1", "ten_1", "errors", "threshold", "", (("level", "=", "error"),), 20.0, DAY),
    AlertRule("a2", "ten_2", "svc_3 warnings", "threshold", "svc_3", (("level", "=", "warn"),), 1.0, CYCLE),
    AlertRule("a3", "ten_0", "no svc_0 errors", "absence", "svc_0", (("level", "=", "error"),), None, DAY),
    AlertRule("a4", "ten_9", "silence", "absence", "", (), None, CYCLE),
]
_STREAM_RULES = "rules(rule_id, tenant_id, kind, service, lvl, threshold, cycles) AS (VALUES " + ", ".join(
    f"('{r.id}', '{r.tenant_id}', '{r.kind}', '{r.service or '*'}', '{r.condition[0][2] if r.condition else '*'}', {'NULL' if r.threshold is None else r.threshold}::DOUBLE, {r.window_seconds // CYCLE})"
    for r in STREAM_RULES
) + ")"


@register(
    "stream_alerts",
    f"""WITH {_STREAM_RULES}, b AS (SELECT min(epoch_us("timestamp")) // {CYCLE}000000 AS lo, max(epoch_us("timestamp")) // {CYCLE}000000 AS hi FROM {{logs}}),
        c AS (SELECT unnest(range(lo, hi + 1)) AS c FROM b),
        n AS (SELECT r.rule_id, epoch_us(l."timestamp") // {CYCLE}000000 AS c, count(*) AS n FROM rules r JOIN {{logs}} l ON l.tenant_id = r.tenant_id
          AND (r.service = '*' OR l.service = r.service) AND (r.lvl = '*' OR l.level = r.lvl) GROUP BY ALL),
        g AS (SELECT r.*, c.c, coalesce(n.n, 0) AS n FROM rules r CROSS JOIN c LEFT JOIN n ON n.rule_id = r.rule_id AND n.c = c.c),
        s AS (SELECT *, CASE WHEN cycles = 1 THEN n ELSE sum(n) OVER (PARTITION BY rule_id ORDER BY c ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS total FROM g),
        f AS (SELECT *, CASE WHEN kind = 'absence' THEN total = 0 ELSE total > threshold END AS firing FROM s),
        w AS (SELECT *, coalesce(lag(firing) OVER (PARTITION BY rule_id ORDER BY c), false) AS was FROM f),
        t AS (SELECT *, (c + 1) * {CYCLE}000000 AS moved FROM w WHERE firing <> was)
        SELECT tenant_id, rule_id, moved AS cycle, firing, CASE WHEN firing THEN moved ELSE lag(moved) OVER (PARTITION BY rule_id ORDER BY c) END AS fired_at,
          CASE WHEN NOT firing THEN moved END AS resolved_at FROM t""",
)
def alerts(spark, sf):
    """Cycle counts in one query, firing changes in a second one that reads them. Lines come in no order at all, so most
    are days late and most changes are corrected several times."""
    folder = scratch(spark)
    logs = A.logs(spark, sf).select("tenant_id", "service", "level", "timestamp")
    stream = as_stream(logs, f"{folder}/in", shuffled=True)
    SA.stream_cycle_counts(stream, STREAM_RULES, f"{folder}/counts", f"{folder}/counted", CYCLE, available_now=True).awaitTermination()
    counts = read_files(spark, f"{folder}/counts/*", SA.CYCLES_SCHEMA, 2)
    SA.stream_alerts(counts, STREAM_RULES, f"{folder}/changes", f"{folder}/checkpoint", CYCLE, 60 * DAY, available_now=True).awaitTermination()
    return SA.read_changes(spark.read.parquet(f"{folder}/changes"))


_INCIDENTS = f"""WITH {_ISLANDS}, f AS (SELECT tenant_id, service, island, count(*) AS signal_count, max(confidence) AS confidence, min("timestamp") AS first_seen,
          max("timestamp") AS last_seen, min("timestamp") FILTER (confidence >= 0.6) AS paged_at FROM c GROUP BY ALL),
        e AS (SELECT f.*, (SELECT min(r."timestamp") FROM {{resolves}} r WHERE r.tenant_id = f.tenant_id AND r.service = f.service AND r."timestamp" >= f.last_seen) AS resolved FROM f)
        SELECT tenant_id, service, {r6('confidence')} AS confidence, signal_count, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen,
          epoch_us(paged_at) AS paged_at, CASE WHEN resolved IS NULL THEN 'open' ELSE 'resolved' END AS status, epoch_us(resolved) AS resolved_at FROM e"""


@register("stream_incidents", _INCIDENTS)
def incidents(spark, sf):
    folder = scratch(spark)
    resolves = A.resolves(spark, sf)
    both = A.signals(spark, sf).withColumn("what", F.lit("signal")).unionByName(resolves.withColumn("what", F.lit("resolve")), allowMissingColumns=True)
    stream = as_stream(both, f"{folder}/in", per_trigger=1)
    signals, closes = stream.filter("what = 'signal'"), stream.filter("what = 'resolve'")
    out = drained(SA.stream_incidents(signals, closes), folder, "update")
    now = latest(out, ["tenant_id", "service", "first_seen"])
    return now.select("tenant_id", "service", "confidence", "signal_count", "first_seen", "last_seen", "paged_at", "status", "resolved_at")


@register("stream_correlation", _INCIDENTS)
def correlation(spark, sf):
    """Signals and resolves come in no order at all, so incidents told by one batch are split and closed by later ones."""
    folder = scratch(spark)
    both = A.signals(spark, sf).withColumn("what", F.lit("signal")).unionByName(A.resolves(spark, sf).withColumn("what", F.lit("resolve")), allowMissingColumns=True)
    stream = as_stream(both, f"{folder}/in", per_trigger=4, shuffled=True)
    SC.stream_correlation(
        stream.filter("what = 'signal'"), stream.filter("what = 'resolve'"), f"{folder}/out", f"{folder}/checkpoint", available_now=True
    ).awaitTermination()
    found = SC.read_incidents(spark, f"{folder}/out")
    return found.select("tenant_id", "service", "confidence", "signal_count", "first_seen", "last_seen", "paged_at", "status", "resolved_at")


@register(
    "stream_anomalies",
    f"""WITH newest AS (SELECT date_trunc('second', max("timestamp")) AS at_ FROM {{logs}}),
        e AS (SELECT tenant_id, service, "timestamp" > at_ - INTERVAL 1 DAY AS now, epoch_us("timestamp") // 1000000 // {DAY} AS b, count(*) AS n
          FROM {{logs}}, newest WHERE level IN ('error', 'fatal') AND "timestamp" > at_ - INTERVAL 13 DAY AND "timestamp" <= at_ GROUP BY ALL),
        s AS (SELECT tenant_id, service, sum(n) FILTER (now) AS cur, avg(n) FILTER (NOT now) AS mean, stddev_pop(n) FILTER (NOT now) AS std,
          count(*) FILTER (NOT now) AS windows FROM e GROUP BY ALL),
        z AS (SELECT *, least(greatest((cur - mean) / greatest(std, sqrt(greatest(mean, 1))) / 6.0, 0), 1) AS score FROM s WHERE cur IS NOT NULL AND windows >= 4)
        SELECT tenant_id, service, {r6('cur')} AS current, {r6('mean')} AS mean, {r6('std')} AS std, {r6('score')} AS score FROM z WHERE score >= 0.1""",
)
def anomalies(spark, sf):
    """The sweep after the last batch; lines come in no order at all."""
    folder = scratch(spark)
    stream = as_stream(A.logs(spark, sf), f"{folder}/in", shuffled=True)
    query = SA.stream_anomalies(stream, f"{folder}/store", f"{folder}/out", f"{folder}/checkpoint", DAY, 12, 0.1, available_now=True)
    query.awaitTermination()
    swept = spark.read.parquet(f"{folder}/out")
    last = swept.agg(F.max("batch_id").alias("batch_id"))
    return swept.join(F.broadcast(last), "batch_id").drop("batch_id", "as_of")  # one row


def event_lines(spark, sf):
    """Events as NDJSON lines; every thirteenth is broken."""
    key = F.col("event_id")
    payload = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.col("event_type").alias("level"),
            F.concat(F.lit("mail user"), F.col("user_id").cast("string"), F.lit("@example.com now")).alias("message"),
            F.concat(F.lit("svc_"), (F.col("user_id") % 7).cast("string")).alias("service"), F.col("user_id").cast("string").alias("user_id"),
            key.alias("event_id"), F.concat(F.lit("rel"), (key % 10).cast("string")).alias("release"),
            F.struct(F.col("value").alias("value"), F.col("event_type").alias("kind")).alias("details"),
        )
    )
    line = F.when(key % 13 == 0, F.concat(F.lit("broken "), key.cast("string"))).otherwise(payload)
    tenant = F.concat(F.lit("ten_"), (F.col("user_id") % 3).cast("string")).alias("tenant_id")
    return A.spread(A.load(spark, sf, "events").select("event_id", tenant, line.alias("value")))


INGEST_STEPS = [
    {"set": "region", "to": Call("upcase", Path("details.kind"))},
    {"del": "details.value"},
    {"if": ("==", "details.kind", "signup"), "then": {"set": "kind", "to": "deploy"}},
    {"if": ("==", "details.kind", "signup"), "then": {"route": "change_events"}},
]


@register(
    "stream_ingest",
    f"""SELECT 'logs' AS "table", concat('ten_', cast(user_id % 3 AS string)) AS tenant_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS kind,
          strftime(ts, '%Y%m') AS month, count(*) AS n FROM events WHERE event_id % 13 <> 0 AND event_type <> 'signup' GROUP BY ALL
        UNION ALL SELECT 'change_events', concat('ten_', cast(user_id % 3 AS string)), 'deploy', strftime(ts, '%Y%m'), count(*) FROM events WHERE event_id % 13 <> 0 AND event_type = 'signup' GROUP BY ALL
        UNION ALL SELECT 'dead_letters', concat('ten_', cast(user_id % 3 AS string)), 'pending', '', count(*) FROM events WHERE event_id % 13 = 0 GROUP BY ALL""",
)
def ingest(spark, sf):
    """Lines to stored records: transforms, routes, masking, dead letters."""
    folder = scratch(spark)
    stream = as_stream(event_lines(spark, sf), f"{folder}/in", shuffled=True).drop("event_id")
    query = SI.stream_ingest(stream, f"{folder}/base", IngestConfig(as_of=AS_OF), f"{folder}/checkpoint", INGEST_STEPS, available_now=True)
    query.awaitTermination()
    month = F.date_format("timestamp", "yyyyMM").alias("month")
    logs = read_signal(spark, f"{folder}/base", "logs").filter(F.col("message").contains("[redacted:email]"))
    changes = read_signal(spark, f"{folder}/base", "change_events")
    dead = spark.read.parquet(f"{folder}/base/dead_letters")
    parts = [
        logs.select(F.lit("logs").alias("table"), "tenant_id", F.col("level").alias("kind"), month),
        changes.select(F.lit("change_events").alias("table"), "tenant_id", "kind", month),
        dead.select(F.lit("dead_letters").alias("table"), "tenant_id", F.col("status").alias("kind"), F.lit("").alias("month")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("table", "tenant_id", "kind", "month").agg(F.count("*").alias("n"))
