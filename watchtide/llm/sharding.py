"""Shards that all follow the mixture of the sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows one sorting task should hold; the number of hash slices follows from it.
SLICE_ROWS = 5_000


def interleave(docs: DataFrame, shards: int = 24, seed: str = "mix", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Assign every row of ``docs`` a shard in ``0 .. shards - 1`` and a slot within it.

    Rows are shuffled by a seeded hash of ``doc_id`` within their source and ranked; a row's place is its
    rank as a fraction of its source, so every stretch of the order holds the sources in proportion, and
    equal cuts make shards that match the mixture. Row counts of shards differ by one at most
    (``law`` is ``rows``).

    No source is sorted in one task: ranks are taken within slices of (source, hash) and of the fraction,
    and the slices' counts, a small table, give the offsets.

    Defined cases: a null text has no bytes and checksum 0; null sources are one source; null ids sort
    first; repeated rows get slots of their own; an empty table gives no row. Only ``doc_id``,
    ``text`` and ``source`` are read, so other columns cannot clash.
    """
    total = docs.count()
    slices = max(1, -(-total // slice_rows))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("stratum"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("draw"),
    )
    # the first eight hex digits as a share of 2^32
    rows = rows.withColumn("slice", F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("bigint") * slices / F.lit(2**32)).cast("int"))

    per_slice = rows.groupBy("stratum", "slice").agg(F.count("*").alias("n"))
    by_stratum = Window.partitionBy("stratum")
    before = per_slice.select(
        "stratum", "slice",
        F.sum("n").over(by_stratum.orderBy("slice")).alias("upto"), "n",
        F.sum("n").over(by_stratum).alias("members"),
    ).select("stratum", "slice", (F.col("upto") - F.col("n")).alias("earlier"), "members")
    within = Window.partitionBy("stratum", "slice").orderBy("draw", "doc_id", "text_crc32", "size")
    ranked = (
        rows.withColumn("nth", F.row_number().over(within))
        .join(before, ["stratum", "slice"])
        .withColumn("place", (2 * (F.col("earlier") + F.col("nth")) - 1) / (2 * F.col("members")))
        .withColumn("cut", F.floor(F.col("place") * slices).cast("int"))
        .select("doc_id", "size", "text_crc32", "stratum", "draw", "place", "cut")
    )

    per_cut = ranked.groupBy("cut").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("cut"))
    starts = per_cut.select("cut", (upto - F.col("n")).alias("start"))
    order = Window.partitionBy("cut").orderBy("place", "stratum", "draw", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("step", F.row_number().over(order)).join(starts, "cut").withColumn("at", F.col("start") + F.col("step") - 1)
    n = max(total, 1)
    shard = F.expr(f"(at * {shards}) div {n}")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        (F.col("at") - F.expr(f"(((at * {shards}) div {n}) * {n} + {shards - 1}) div {shards}")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
