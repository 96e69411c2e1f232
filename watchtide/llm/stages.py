"""The operators as pipeline stages: (spark, docs, sf_dir) to the documents that stay, with their columns.

Decisions on whole documents go by id: rows without an id cannot be named and stay. Other columns of
``docs`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import decontamination, near_copies, piece_sampling, quality, suffixes
from .common import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold stay, scored where the text lies."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles with a similarity of 0.8 or more) stays: the
    one with the smallest id. A document is a row, named by its id and the hash of its text, so unrelated texts that share an
    id all stay; of rows that repeat id and text one stays. Rows without an id stay.
    """
    found = near_copies.near_copies(docs).filter("doc_id is not null")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("kept")).select("kept.*")
    free = "_" * (1 + max(map(len, docs.columns), default=0))  # no column starts with this
    named = docs.filter("doc_id is not null").withColumn(f"{free}d", F.xxhash64("text")).withColumn(f"{free}i", F.col("doc_id").cast("bigint"))
    kept = first.select(F.col("doc_id").alias(f"{free}i"), F.col("digest").alias(f"{free}d"))
    own = named.join(kept, [f"{free}i", f"{free}d"], "left_semi")
    nth = F.row_number().over(Window.partitionBy(f"{free}i", f"{free}d").orderBy(F.lit(0)))
    single = own.withColumn(f"{free}n", nth).filter(F.col(f"{free}n") == 1).select(*docs.columns)
    return single.unionByName(docs.filter("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte within a string of 200 bytes that occurs again is cut; ``n_chars`` is counted anew."""
    cut = suffixes.cut_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(cut.schema["n_chars"].dataType)) if "n_chars" in cut.columns else cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or most words of a window of one, go."""
    found = decontamination.overlaps(docs, table(spark, sf_dir, "benchmark"))
    gone = found.filter("doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` and the sampled ``pieces`` of every text that is left."""
    return piece_sampling.encode(docs)
