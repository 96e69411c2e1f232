"""Windowed counts and metric states over streams.

A stream keeps no state here: every micro-batch is reduced to mergeable states of its own, which :mod:`states` stores
and folds, and readers merge what is live. A row counts however late it comes, a repeated batch counts once, and
nothing grows inside the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import bucket_seconds
from ..operators.governance import REQUESTS_PER_MINUTE, WINDOW_SECONDS, rate_windows
from ..operators.metrics import merge_rollup, rollup_metrics
from . import states
from .files import TRIGGER, for_each_batch


def stream_rollups(
    metrics: DataFrame, out: str, checkpoint: str, grain: str | int = "5 minutes", available_now: bool = False, trigger: str = TRIGGER,
) -> StreamingQuery:
    """Store the rollup states of each micro-batch under ``out``; :func:`read_rollups` merges the live ones."""
    states.begin(metrics.sparkSession, out)

    def write(batch: DataFrame, number: int) -> None:
        states.add(rollup_metrics(batch, grain), out, number, lambda known: merge_rollup(known, grain))

    return for_each_batch(metrics, write, checkpoint, "append", available_now, trigger)


def read_rollups(live: DataFrame, grain: str | int = "5 minutes") -> DataFrame:
    """One state per series and bucket out of :func:`states.live_states`."""
    return merge_rollup(live, grain)


def stream_rate_windows(requests: DataFrame, out: str, checkpoint: str, available_now: bool = False, trigger: str = TRIGGER) -> StreamingQuery:
    """Store the requests per tenant and minute of each micro-batch under ``out``; :func:`read_rate_windows` adds the live ones up."""
    states.begin(requests.sparkSession, out)

    def write(batch: DataFrame, number: int) -> None:
        start = bucket_seconds("timestamp", WINDOW_SECONDS).alias("window_start")
        states.add(batch.groupBy("tenant_id", start).agg(F.count(F.lit(1)).alias("requests")), out, number, _summed)

    return for_each_batch(requests, write, checkpoint, "append", available_now, trigger)


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("tenant_id", "window_start").agg(F.sum("requests").alias("requests"))


def read_rate_windows(live: DataFrame, limit: int = REQUESTS_PER_MINUTE) -> DataFrame:
    """Requests per tenant and minute against the quota, out of :func:`states.live_states`."""
    return rate_windows(_summed(live), limit)
