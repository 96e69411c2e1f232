"""Connected parts of a large sparse graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node of its part) for every node that an edge touches.

    Each round a node takes the smallest label among its neighbours and then the label of its label, so
    chains shorten by doubling. Every round is a table in the shared folder; edges whose ends agree are
    done and dropped.
    """
    one_way = stash(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y"), "edges")
    links = stash(one_way.unionByName(one_way.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = _raised(links.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")))
    while True:
        # neighbours of labels, so that whole parts hook on to each other
        at_x = labels.select(F.col("node").alias("x"), F.col("root").alias("rx"))
        at_y = labels.select(F.col("node").alias("y"), F.col("root").alias("ry"))
        links = stash(links.join(at_x, "x").join(at_y, "y").filter("rx <> ry").select(F.col("rx").alias("x"), F.col("ry").alias("y")).distinct(), "links")
        if links.isEmpty():
            return labels
        hooks = links.groupBy(F.col("x").alias("root")).agg(F.least(F.min("y"), F.first("x")).alias("to"))
        labels = _raised(labels.join(hooks, "root", "left").select("node", F.coalesce("to", "root").alias("root")))


def _raised(labels: DataFrame) -> DataFrame:
    """The label of the label, until nothing moves: every label is then a root, its own label."""
    labels = stash(labels.select("node", "root"), "labels")
    while True:
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = labels.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved"))
        step = stash(step, "labels")
        labels = step.select("node", "root")
        if step.filter("moved").isEmpty():
            return labels
