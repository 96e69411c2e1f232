"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact reranking."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, mixed, stash

NEAREST, TABLES = 10, 6
# Chance, by the model of the probe order, that a neighbour at the usual distance is met in some table.
SUCCESS = 0.97
# Width of a slot in usual neighbour distances; slots to either side that are looked at; orders kept while combining.
WIDTH, REACH, BEAM = 1.9, 2, 8192
# Queries that the usual distance is measured on, and vectors that one comparing task holds.
PROBED, BLOCK = 64, 8192


def _phi(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = np.exp(-z * z / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z > 0, 1 - tail, tail)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


class Hashes:
    """Per table, ``functions`` random Gaussian directions and offsets; a slot is ``width`` wide."""

    def __init__(self, dimensions: int, functions: int, width: float, distance: float, tables: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, dimensions, functions))
        self.b = rng.random((tables, functions)) * width
        self.width, self.distance = width, distance
        self.each = 1 - (1 - SUCCESS) ** (1 / tables)

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.a[table] + self.b[table]) / self.width

    @staticmethod
    def names(slots: np.ndarray, table: int) -> np.ndarray:
        out = np.full(slots.shape[:-1], table + 1, np.uint64)
        for j in range(slots.shape[-1]):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + slots[..., j].astype(np.int64).view(np.uint64))
        return out.view(np.int64)

    def visits(self, x: np.ndarray, table: int) -> np.ndarray:
        """Buckets for one query, in the order of the chance that a neighbour lies there, until the chances
        add up to the table's share of the aim."""
        f = self.places(x[None, :], table)[0]
        home = np.floor(f)
        steps = np.arange(-REACH, REACH + 1)
        low = (home[:, None] + steps - f[:, None]) * self.width / self.distance
        chance = _phi(low + self.width / self.distance) - _phi(low)
        odds, slots = np.ones(1), np.zeros((1, 0))
        for j in range(len(f)):
            odds = (odds[:, None] * chance[j]).ravel()
            slots = np.concatenate((np.repeat(slots, len(steps), axis=0), np.tile(home[j] + steps, len(slots))[:, None]), axis=1)
            best = np.argsort(-odds, kind="stable")[:BEAM]
            odds, slots = odds[best], slots[best]
        enough = int(np.searchsorted(np.cumsum(odds), self.each)) + 1
        return self.names(slots[:enough], table)


def _usual(batches, queries, nearest: int):
    """Per task, the ``nearest`` + 1 smallest distances to each of the broadcast queries."""
    q = queries.value
    best = np.full((len(q), nearest + 1), np.inf)
    for batch in batches:
        x = _matrix(batch.column(0))
        for k in range(len(q)):
            d = np.sqrt(((x - q[k]) ** 2).sum(axis=1))
            best[k] = np.sort(np.concatenate((best[k], d)))[: nearest + 1]
    row, _ = np.nonzero(np.isfinite(best))
    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(best[np.isfinite(best)])], ["q", "d"])


def _bucketed(batches, hashes, tables: int):
    for batch in batches:
        x = _matrix(batch.column(1))
        for t in range(tables):
            names = hashes.value.names(np.floor(hashes.value.places(x, t)), t)
            yield pa.RecordBatch.from_arrays([pa.array(names), batch.column(0), batch.column(1)], ["bucket", "vid", "embedding"])


def _visited(batches, hashes, tables: int):
    for batch in batches:
        x = _matrix(batch.column(1))
        for k in range(len(x)):
            names = np.unique(np.concatenate([hashes.value.visits(x[k], t) for t in range(tables)]))
            take = pa.array(np.full(len(names), k))
            for s in range(0, len(names), 2048):
                yield pa.RecordBatch.from_arrays([pa.array(names[s : s + 2048]), batch.column(0).take(take[s : s + 2048]), batch.column(1).take(take[s : s + 2048])], ["bucket", "qid", "embedding"])


def _closest(queries: pa.Table, vectors: pa.Table, keep: int) -> pa.Table:
    """The ``keep`` nearest of the group's vectors for each of its queries, by exact distance."""
    q, x = _matrix(queries.column("embedding")), _matrix(vectors.column("embedding"))
    qid, vid = queries.column("qid").to_numpy(), vectors.column("vid").to_numpy()
    out_q, out_v, out_d = [], [], []
    for k in range(len(q)):
        if not len(x):
            break
        d = np.sqrt(((x - q[k]) ** 2).sum(axis=1))
        best = np.lexsort((vid, d))[:keep]
        out_q.append(np.full(len(best), qid[k]))
        out_v.append(vid[best])
        out_d.append(d[best])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.table({"qid": pa.array(join(out_q, np.int64)), "vid": pa.array(join(out_v, np.int64)), "score": pa.array(join(out_d, np.float64))})


def _compared(visits: DataFrame, members: DataFrame, keep: int) -> DataFrame:
    """Local bests of every visited bucket; a bucket of more than BLOCK vectors is several tasks."""
    sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    wanted = stash(visits.select("bucket").distinct().join(sizes, "bucket"), "buckets")
    mine = members.join(wanted, "bucket").withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int"))
    theirs = visits.join(wanted, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def compare(q, v):
        return _closest(q, v, keep)

    groups = theirs.groupBy("bucket", "part").cogroup(mine.select("bucket", "part", "vid", "embedding").groupBy("bucket", "part"))
    return groups.applyInArrow(compare, "qid bigint, vid bigint, score double")


def nearest(vectors: DataFrame, queries: DataFrame, n: int = NEAREST, tables: int = TABLES, seed: int = 5) -> DataFrame:
    """For each row of ``queries`` its ``n`` nearest rows of ``vectors`` other than itself (the same
    ``vec_id``): (query_id, rank, vec_id, score), by Euclidean distance in double precision, ties to the
    smaller id.

    Equal vectors are searched once and stand for the ``n`` + 1 smallest of their ids, which is all that a
    result can hold. Slots are scaled to the usual distance of the ``n``-th neighbour, measured over all
    vectors on a few queries, and the number of functions grows with the logarithm of the table. A
    query that meets too few vectors is compared with all of them.

    Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
    components take no part; with fewer candidates than ``n`` all are returned; repeated rows of one id
    and vector count once; of several vectors with one id, on either side, the least distance counts; empty tables give no row. Only ``vec_id`` and ``embedding`` are read.
    """
    spark = vectors.sparkSession
    keep = n + 1
    sound = lambda df: df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(
        "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"
    )
    rows = sound(vectors)
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimensions = common.d if common else 1
    rows = rows.filter(F.size("embedding") == dimensions)
    # an id with several vectors may stand in a ranking as often
    keep *= rows.distinct().groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    # the smallest ids of each distinct vector; Spark drops the others before the shuffle
    order = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.distinct().withColumn("nth", order).filter(F.col("nth") <= keep)
    distinct = stash(few.groupBy("embedding").agg(F.min("vec_id").alias("vid"), F.collect_list("vec_id").alias("ids")), "vectors")
    count = distinct.count()
    asked = sound(queries).filter(F.size("embedding") == dimensions).distinct()
    asked = stash(asked.withColumnRenamed("vec_id", "query_id").join(distinct.select("embedding", F.col("vid").alias("qid")), "embedding", "left"), "queries")
    # queries need not be rows of the table
    asked = asked.withColumn("qid", F.coalesce("qid", -1 - F.col("query_id")))
    single = stash(asked.groupBy("embedding").agg(F.min("qid").alias("qid")), "asked")

    some = single.orderBy(F.xxhash64("qid"), "qid").limit(PROBED).collect()
    if not some or not count:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    probes = spark.sparkContext.broadcast(np.array([r.embedding for r in some], np.float64))
    local = arrow(distinct.select("embedding"), partial(_usual, queries=probes, nearest=n), "q bigint, d double")
    ranked = local.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("d"))).filter(F.col("nth") <= keep)
    usual = ranked.groupBy("q").agg(F.max("d").alias("d")).agg(F.percentile("d", 0.75)).first()[0] or 1.0
    functions = int(np.clip(round(np.log2(count + 1) / 2.6), 2, 12))
    hashes = spark.sparkContext.broadcast(Hashes(dimensions, functions, WIDTH * usual, usual, tables, seed))

    members = arrow(distinct.select("vid", "embedding"), partial(_bucketed, hashes=hashes, tables=tables), "bucket bigint, vid bigint, embedding array<double>")
    visits = stash(arrow(single.select("qid", "embedding"), partial(_visited, hashes=hashes, tables=tables), "bucket bigint, qid bigint, embedding array<double>"), "visits")
    found = stash(_compared(visits, members, keep).distinct(), "found")
    met = found.groupBy("qid").agg(F.count("*").alias("met"))
    short = single.join(met, "qid", "left").filter(F.coalesce("met", F.lit(0)) < min(keep, count)).select(F.lit(0).cast("bigint").alias("bucket"), "qid", "embedding")
    short = stash(short, "short")
    if not short.isEmpty():
        everyone = distinct.select(F.lit(0).cast("bigint").alias("bucket"), "vid", "embedding")
        found = found.unionByName(_compared(short, everyone, keep)).distinct()
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("score", "vid"))).filter(F.col("nth") <= keep)
    spread = best.join(distinct.select("vid", "ids"), "vid").select("qid", "score", F.explode("ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id"))
    spread = stash(spread.withColumn("nth", rank).filter(F.col("nth") <= keep).drop("nth"), "nearest")
    answers = asked.select("query_id", "qid").join(spread, "qid").filter("query_id <> vec_id")
    answers = answers.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return answers.withColumn("rank", place).filter(F.col("rank") <= n).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
