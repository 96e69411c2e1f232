"""Incidents over a stream of signals and resolves that may come in any order.

Signals are what rules emit per cycle, few beside the lines they come from. Each batch stores its own, and the incidents of
what it touched are correlated anew over all that is known of it, by the same operator that works on stored
tables. So a late signal or resolve splits, joins and closes incidents as if it had come in time, and neighbours merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incidents import correlate_incidents
from . import states
from .files import for_each_batch

SIGNAL = ["tenant_id", "service", "timestamp", "rule_id", "rule_name", "confidence", "deploy_id"]


def scope_of(edges: DataFrame | None) -> list[str]:
    """What is correlated as a whole: a service, or with neighbours to merge with, a tenant."""
    return ["tenant_id", "service"] if edges is None else ["tenant_id"]


def _newest(by: list[str]):
    def merge(incidents: DataFrame) -> DataFrame:
        last = incidents.groupBy(*by).agg(F.max("batch").alias("batch"))
        return incidents.join(last, [*by, "batch"], "left_semi")

    return merge


def stream_correlation(
    signals: DataFrame, resolves: DataFrame, out: str, checkpoint: str, edges: DataFrame | None = None,
    available_now: bool = False, trigger: str = "10 seconds",
) -> StreamingQuery:
    """Keep the incidents of a stream under ``out``; :func:`read_incidents` reads them.

    ``signals`` and ``resolves`` have the columns of :func:`correlate_incidents`; ``edges`` is a stored table. Rows without a tenant
    or service open no incident. Facts and incidents are folded states, so both survive a batch that breaks off.
    """
    spark, by = signals.sparkSession, scope_of(edges)
    facts, incidents = f"{out}/facts", f"{out}/incidents"
    states.begin(spark, facts)
    states.begin(spark, incidents)
    opened = signals.select(*SIGNAL, F.lit(True).alias("signal"))
    closed = resolves.select("tenant_id", "service", "timestamp", F.lit(False).alias("signal"))

    def write(batch: DataFrame, number: int) -> None:
        states.add(batch.filter("tenant_id is not null and service is not null"), facts, number, lambda known: known)
        live = states.live_states(spark, facts)
        touched = batch.select(*by).distinct()
        known = live.join(touched, by, "left_semi")
        found = correlate_incidents(known.filter("signal").select(*SIGNAL), known.filter("not signal").select("tenant_id", "service", "timestamp"), edges)
        states.add(found.withColumn("batch", F.lit(number).cast("bigint")), incidents, number, _newest(by))

    both = opened.unionByName(closed, allowMissingColumns=True)
    return for_each_batch(both, write, checkpoint, "append", available_now, trigger)


def read_incidents(spark: SparkSession, out: str, edges: DataFrame | None = None) -> DataFrame:
    """The incidents that hold: of every service (tenant, if neighbours merge) those told by the last batch that touched it."""
    return _newest(scope_of(edges))(states.live_states(spark, f"{out}/incidents")).drop("batch")
