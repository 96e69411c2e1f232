"""Streams of raw events into signal tables, and reading along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.basics import as_of_col, settled
from ..functions.fields import is_json_object
from ..operators.scope import tenant_scope
from ..schemas import conform, signal_schema
from ..sources.records import IngestConfig, build_change_events, build_log_records, build_metric_points, build_spans, payload_fields
from ..sources.remap import apply_remap
from ..sources.signals import split_dead_letters, split_rejects, write_signal
from .files import TRIGGER, for_each_batch

DEDUP_DELAY = "10 minutes"


def dedup_stream(df: DataFrame, delay: str = DEDUP_DELAY) -> DataFrame:
    """Drop redelivered records: a (tenant, id) that arrives again within ``delay`` passes once.

    The delay runs by arrival, not by the record's own time, so a record that is days late passes like any
    other. What is redelivered after the delay is left to the idempotent writer.
    """
    arrived = df.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay)
    return arrived.dropDuplicatesWithinWatermark(["tenant_id", "id"]).drop("_arrived")


def live_tail(stream: DataFrame, tenant: str, predicate: Column) -> DataFrame:
    """A tenant's records that satisfy a tail predicate, as they arrive."""
    return tenant_scope(stream, tenant).filter(predicate)


def _parsed(rows: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Payload rows of a typed route: its fields, and what cannot become a row of the table as dead letters."""
    # timestamps stay text here: the builders read every accepted spelling
    fields = ", ".join(
        f"`{f.name}` {'string' if f.dataType.typeName() == 'timestamp' else f.dataType.simpleString()}"
        for f in signal_schema(table).fields
        if f.name not in ("tenant_id", "id")
    )
    read = F.from_json("payload", f"{fields}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    parsed = rows.withColumn("_r", read).select(*rows.columns, "_r.*")
    good, dead = split_rejects(parsed, table, "payload")
    return good.drop("payload", "created_at"), dead


def _records(parsed: DataFrame, table: str, cfg: IngestConfig) -> DataFrame:
    """Parsed rows of one route as rows of its table."""
    if table == "logs":
        built = build_log_records(parsed, cfg, "http")
        return built.filter(~F.col("drop_record")).drop("drop_record")
    if table == "metrics":
        return build_metric_points(parsed, cfg)
    if table == "traces":
        return build_spans(parsed, cfg)
    if table == "change_events":
        return build_change_events(parsed, cfg.as_of)
    return conform(parsed, table)


def ingest_batch(lines: DataFrame, base: str, cfg: IngestConfig, steps: list[dict], number: int, tables) -> None:
    """Parse, transform, route and store one micro-batch of ``tenant_id``, ``value`` lines.

    A record's id is a hash of the batch number, its tenant, its text and which of the batch's equal lines it
    is. However a replayed batch is packed into partitions, it gives the same ids, which the idempotent
    writer drops. Equal lines are counted before they move, so a line that fills a batch does no harm.
    The batch is read and parsed once, behind that shuffle: readable and unreadable lines come from one stored result.
    """
    payload = F.trim("value").alias("payload")
    equal = lines.filter(F.trim("value") != "").groupBy("tenant_id", payload).agg(F.count("*").alias("_n"))
    placed = equal.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    line = F.concat_ws("|", F.lit(str(number)), F.coalesce("tenant_id", F.lit("")), F.col("_nth").cast("string"), F.col("payload"))
    placed = placed.withColumn("id", F.sha2(line, 256)).drop("_n", "_nth")
    # settled, or Spark would parse ahead of the shuffle, in the few tasks that read the batch
    marked = placed.withColumn("error", settled(F.when(~is_json_object("payload"), "not a JSON object")))
    marked = marked.withColumn("_unread", F.when(F.col("error").isNotNull(), F.col("payload")))
    remapped = apply_remap(marked, steps, default_route="logs")
    routed = remapped.select("tenant_id", "id", "payload", "route_to", "error", "_unread").persist()
    try:
        unread = routed.select("tenant_id", "error", F.col("_unread").alias("payload"), as_of_col(cfg.as_of).alias("created_at"))
        _, dead = split_dead_letters(unread)
        parsed = {}
        for table in tables:
            rows = routed.filter(F.col("error").isNull() & (F.col("route_to") == table)).select("tenant_id", "id", "payload")
            if table == "logs":
                parsed[table] = payload_fields(rows)
                continue
            parsed[table], rejected = _parsed(rows.withColumn("created_at", as_of_col(cfg.as_of)), table)
            dead = dead.unionByName(rejected)
        dead.write.mode("overwrite").parquet(f"{base}/dead_letters/batch_id={number}")
        for table in tables:
            write_signal(_records(parsed[table], table, cfg), base, table)
    finally:
        routed.unpersist()


def stream_ingest(
    lines: DataFrame, base: str, cfg: IngestConfig, checkpoint: str, steps: list[dict] = (), available_now: bool = False, trigger: str = TRIGGER,
) -> StreamingQuery:
    """Raw NDJSON lines (``tenant_id``, ``value``) into the signal tables under ``base``.

    Steps may route an event to another table than ``logs``. Unreadable lines, and payloads that cannot become rows of
    their table, become dead letters with the reason.
    """
    steps = list(steps)
    tables = ["logs", *dict.fromkeys(t for t in map(_route_of, steps) if t and t != "logs")]

    def write(batch: DataFrame, number: int) -> None:
        ingest_batch(batch, base, cfg, steps, number, tables)

    return for_each_batch(lines, write, checkpoint, "append", available_now, trigger)


def _route_of(step: dict) -> str | None:
    return _route_of(step["then"]) if "then" in step else step.get("route")
