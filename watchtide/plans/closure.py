"""Transitive closure over a deduplicated edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from ..session import reliable_checkpoint


def reachable(edges: DataFrame, by: list[str], source: str, target: str, starts: DataFrame | None = None) -> DataFrame:
    """Distinct (by, origin, reached) pairs along source -> target edges; an origin never reaches itself.

    Only pairs found in the last round are joined again, and a pair seen before is dropped, so cycles
    end. Each round is written to the shared checkpoint folder, which keeps the plan flat and lets a
    lost executor restart from the last round. ``starts`` limits the origins.
    """
    steps = reliable_checkpoint(edges.select(*by, F.col(source).alias("_from"), F.col(target).alias("_to")).distinct())
    frontier = steps.select(*by, F.col("_from").alias("origin"), F.col("_to").alias("reached"))
    if starts is not None:
        frontier = frontier.join(starts.select(*by, "origin").distinct(), [*by, "origin"], "left_semi")
    frontier = reliable_checkpoint(frontier.filter(F.col("origin") != F.col("reached")))
    found = frontier
    while not frontier.isEmpty():
        onward = (
            frontier.withColumnRenamed("reached", "_from")
            .join(steps, [*by, "_from"])
            .select(*by, "origin", F.col("_to").alias("reached"))
            .filter(F.col("origin") != F.col("reached"))
            .distinct()
        )
        frontier = reliable_checkpoint(onward.join(found, [*by, "origin", "reached"], "left_anti"))
        found = found.unionByName(frontier)
    return found


def components(edges: DataFrame, by: list[str], source: str, target: str) -> DataFrame:
    """``by``, node name and the smallest node name of its connected part; edges count both ways.

    Every node repeatedly takes the smallest label around it, which needs as many rounds as the widest
    part is across.
    """
    one_way = edges.select(*by, F.col(source).alias("_a"), F.col(target).alias("_b"))
    links = reliable_checkpoint(one_way.unionByName(one_way.select(*by, F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct())
    labels = reliable_checkpoint(links.select(*by, F.col("_a").alias("_node"), F.col("_a").alias("_label")).distinct())
    while True:
        around = links.join(labels.withColumnRenamed("_node", "_b"), [*by, "_b"]).groupBy(*by, F.col("_a").alias("_node")).agg(
            F.min("_label").alias("_near")
        )
        lowered = F.least("_label", "_near")
        step = labels.join(around, [*by, "_node"]).select(*by, "_node", lowered.alias("_label"), (lowered != F.col("_label")).alias("_moved"))
        step = reliable_checkpoint(step)
        labels = step.drop("_moved")
        if step.filter("_moved").isEmpty():
            return labels.select(*by, F.col("_node").alias(source), F.col("_label").alias("component"))
