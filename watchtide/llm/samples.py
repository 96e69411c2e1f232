"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def labelled(docs: DataFrame, labels: DataFrame, column: str, modulus: int, rest: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of at most ``per_class`` labelled ids per class, and how many each class has.

    Ids are taken in the order of a hash, so the sample is the same on every run; held-out ids and rows
    without an id or a label take no part.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("int").alias("y"))
    known = known.filter("doc_id is not null and y in (0, 1)").filter(~held_out(modulus, rest))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(column))
    parts = [known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).dropDuplicates(["doc_id"])
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(chosen, "doc_id")
    return texts.dropDuplicates(["doc_id"]), counts
