"""Alert rules, anomalies and incidents over streams."""

from __future__ import annotations

import functools
import json

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.fields import fingerprint
from ..functions.folding import RuleCycles, fold_incidents
from ..functions.times import bucket_seconds
from ..operators.alerts import BASELINE_WINDOWS, add_counts, error_counts, swept_counts
from ..operators.incidents import PAGE_MIN_CONFIDENCE
from ..operators.rules import as_rule_table, matching
from ..schemas import conform
from ..sources.signals import write_signal
from . import states
from .files import for_each_batch, write_batches

CYCLE_SECONDS = 60
# How far back late counts still change what was told.
HISTORY_SECONDS = 7 * 86400
CYCLES_SCHEMA = "rule_id string, tenant_id string, cycle timestamp, n bigint"
CHANGES_SCHEMA = "tenant_id string, rule_id string, cycle timestamp, firing boolean, fired_at timestamp, resolved_at timestamp, withdrawn boolean"
# Fixed value: timers need this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def cycle_counts(logs: DataFrame, rules, cycle: int = CYCLE_SECONDS) -> DataFrame:
    """Matching log lines per rule and evaluation cycle of some lines, and for every rule a zero for the oldest and the
    newest cycle of any line, so that silence is visible. Counts of several batches add up."""
    table = as_rule_table(logs.sparkSession, rules)
    ends = (bucket_seconds("timestamp", cycle) + cycle).alias("end")
    hits = matching(logs, table, lambda _: F.lit(True), ("timestamp",))
    counts = hits.groupBy("rule_id", "tenant_id", ends).agg(F.count(F.lit(1)).alias("n"))
    edge = logs.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).filter("a is not null")
    seen = edge.select(F.explode(F.array_distinct(F.array(*[bucket_seconds(c, cycle) + cycle for c in ("a", "b")]))).alias("end"), F.lit(1).alias("_one"))
    zeros = table.withColumn("_one", F.lit(1)).join(F.broadcast(seen), "_one").select("rule_id", "tenant_id", "end", F.lit(0).cast("bigint").alias("n"))  # two rows
    return counts.unionByName(zeros).select("rule_id", "tenant_id", F.timestamp_seconds("end").alias("cycle"), "n")


def stream_cycle_counts(logs: DataFrame, rules, out: str, checkpoint: str, cycle: int = CYCLE_SECONDS, available_now: bool = False, trigger: str = "10 seconds") -> StreamingQuery:
    """Write the counts of each micro-batch to a folder of its own. A line counts however late it comes, and a repeated
    batch overwrites its folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            cycle_counts(batch, rules, cycle).write.mode("overwrite").parquet(f"{out}/batch_id={number}")
        finally:
            batch.unpersist()

    return for_each_batch(logs, write, checkpoint, "append", available_now, trigger)


class _Rule(StatefulProcessor):
    """One rule: its settings and cycles in state, and a timer that evaluates it while no line arrives."""

    def __init__(self, cycle: int, history: int, grace: int | None):
        self.cycle, self.history = cycle * 1_000_000, history * 1_000_000
        self.grace = None if grace is None else grace * 1000

    def init(self, handle) -> None:
        self.settings = handle.getValueState("settings", "kind string, threshold double, window_seconds int")
        self.cycles = handle.getValueState("cycles", "data string")
        self.handle = handle

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        threshold = None if pd.isna(row["threshold"]) else float(row["threshold"])
        self.settings.update((row["kind"], threshold, int(row["window_seconds"])))
        self._wait(timerValues)

    def _wait(self, timerValues) -> None:
        if self.grace is None:
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        step = self.cycle // 1000
        self.handle.registerTimer((now // step + 1) * step + self.grace)

    def _evaluate(self, key, counts: dict, until: int | None):
        if not self.settings.exists():
            return  # the rule is gone
        kind, threshold, window = self.settings.get()
        known = json.loads(self.cycles.get()[0]) if self.cycles.exists() else None
        rule = RuleCycles(kind, threshold, window * 1_000_000, self.cycle, known)
        changes = rule.add(counts, until)
        rule.forget(self.history)
        self.cycles.update((json.dumps(rule.known()),))
        if changes:
            stamp = lambda us: pd.NaT if us is None else pd.Timestamp(us * 1000)
            rows = [(*key, stamp(at), fires, stamp(fired), pd.NaT if fires else stamp(at), gone) for at, fires, fired, gone in changes]
            yield pd.DataFrame(rows, columns=["tenant_id", "rule_id", "cycle", "firing", "fired_at", "resolved_at", "withdrawn"])

    def handleInputRows(self, key, rows, timerValues):
        counts: dict[int, int] = {}
        for frame in rows:
            for at, n in zip(frame["cycle"], frame["n"], strict=True):
                us = pd.Timestamp(at).value // 1000
                counts[us] = counts.get(us, 0) + int(n)
        yield from self._evaluate(key, counts, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._wait(timerValues)
        now = (timerValues.getCurrentProcessingTimeInMs() - self.grace) * 1000
        yield from self._evaluate(key, {}, now // self.cycle * self.cycle)

    def close(self) -> None:
        pass


def alert_changes(counts: DataFrame, rules, cycle: int = CYCLE_SECONDS, history: int = HISTORY_SECONDS, grace: int | None = 0) -> DataFrame:
    """State changes of rules over a stream of :func:`cycle_counts`, for append mode.

    A rule is evaluated at the end of each cycle over its trailing window. Late counts re-evaluate the cycles they touch,
    back to ``history`` seconds: a change that no longer holds comes once more as ``withdrawn``, one whose firing
    time has moved is told anew. ``grace`` seconds after a cycle has ended by the clock, a timer evaluates it although no
    line has arrived; so a source that falls silent raises its absence alerts, once the stream has seen a first line. Without ``grace`` there
    are no timers and cycles are evaluated up to the newest line.
    """
    table = as_rule_table(counts.sparkSession, rules).select("tenant_id", "rule_id", "kind", "threshold", "window_seconds")
    by = ["tenant_id", "rule_id"]
    return counts.groupBy(*by).transformWithStateInPandas(
        _Rule(cycle, history, grace), CHANGES_SCHEMA, "append", "None" if grace is None else "ProcessingTime", initialState=table.groupBy(*by)
    )


def stream_alerts(
    counts: DataFrame, rules, out: str, checkpoint: str, cycle: int = CYCLE_SECONDS, history: int = HISTORY_SECONDS, grace: int = 0,
    available_now: bool = False, trigger: str = "10 seconds",
) -> StreamingQuery:
    """Write :func:`alert_changes` by batch; :func:`read_changes` merges them. The rules are read when the query first starts.
    Draining what is there (``available_now``) goes without timers, for which Spark would run batches without end."""
    conf = counts.sparkSession.conf
    usual = conf.get(STATE_STORE[0], None)
    conf.set(*STATE_STORE)  # a query keeps the settings it was started with
    try:
        return write_batches(alert_changes(counts, rules, cycle, history, None if available_now else grace), out, checkpoint, "append", available_now, trigger)
    finally:
        conf.set(STATE_STORE[0], usual) if usual else conf.unset(STATE_STORE[0])


def read_changes(changes: DataFrame) -> DataFrame:
    """The changes that hold, out of those of all batches: the newest word on each rule and cycle."""
    by = ["tenant_id", "rule_id", "cycle"]
    rest = ["withdrawn", "firing", "fired_at", "resolved_at"]
    newest = changes.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("batch_id", ~F.col("withdrawn"))).alias("_now"))
    return newest.select(*by, "_now.*").filter(~F.col("withdrawn")).drop("withdrawn")


def stream_incidents(signals: DataFrame, resolves: DataFrame, page_at: float = PAGE_MIN_CONFIDENCE) -> DataFrame:
    """Incidents as they change, for update mode; one row per incident touched by a batch.

    Signals are what rules emit per cycle, not log lines, and the state of a service is one small record.
    """
    opened = signals.select(
        "tenant_id", "service", "timestamp", F.lit("signal").alias("what"), "rule_id", "rule_name", "confidence", "deploy_id"
    )
    closed = resolves.select(
        "tenant_id", "service", "timestamp", F.lit("resolve").alias("what"), F.lit("").alias("rule_id"), F.lit("").alias("rule_name"),
        F.lit(0.0).alias("confidence"), F.lit("").alias("deploy_id"),
    )
    fold = functools.partial(fold_incidents, page_at=page_at)
    changed = opened.unionByName(closed).groupBy("tenant_id", "service").applyInPandasWithState(
        fold,
        "tenant_id string, service string, rule_name string, confidence double, signal_count bigint, first_seen timestamp, last_seen timestamp,"
        " deploy_id string, correlated_rules array<string>, paged_at timestamp, status string, resolved_at timestamp",
        "data string",
        "update",
        GroupStateTimeout.NoTimeout,
    )
    return changed.withColumn("fingerprint", fingerprint("tenant_id", "service"))


def stream_anomalies(
    logs: DataFrame, base: str, out: str, checkpoint: str, window: int = 300, windows: int = BASELINE_WINDOWS,
    min_score: float = 0.5, available_now: bool = False, trigger: str = "60 seconds",
) -> StreamingQuery:
    """Store each batch of logs and its error counts, then sweep the counts for anomalies as of the newest line so far.

    Counts lie under ``base/error_counts`` as folded states, so a sweep reads no logs, and lines may come in any order:
    of several sweeps as of the same instant the one of the last batch holds.
    """
    spark, kept = logs.sparkSession, f"{base}/error_counts"
    states.begin(spark, kept)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            write_signal(conform(batch, "logs"), base, "logs")
            states.add(error_counts(batch, window), kept, number, add_counts)
        finally:
            batch.unpersist()
        counts = states.live_states(spark, kept)
        newest = counts.agg(F.date_trunc("second", F.max("newest")).alias("at")).first()["at"]
        if newest is None:
            return
        as_of = newest.strftime("%Y-%m-%d %H:%M:%S")
        swept = swept_counts(counts, as_of, window, windows, min_score)
        swept.withColumn("as_of", F.lit(as_of).cast("timestamp")).write.mode("overwrite").parquet(f"{out}/batch_id={number}")

    return for_each_batch(logs, write, checkpoint, "append", available_now, trigger)
