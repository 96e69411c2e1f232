"""Near copies by the similarity of five-word shingles: wide SimHash comparison, then an exact check.

Texts with a similarity of 0.8 differ in ten of 64 fingerprint bits on average, and unrelated long texts in hardly more
than ``RADIUS``, so a second fingerprint, a bit of each of 64 minima, and the numbers of shingles thin out the
candidates before their shingles are fetched and compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, mixed, stash, words_of
from .graph import components
from .simhash import SEED, _join, bits_in_half, shingle_hashes

SIZE = 5
# Least similarity, as a fraction, so that it is compared in whole numbers.
LEAST = (4, 5)
# Bits in which candidates may differ. Pairs that are similar enough were seen at up to 17 bits of the fingerprint; in the
# minima they differ in 6.4 bits on average, with a deviation of 2.4, and unrelated texts in 32 with one of 4.
RADIUS, MINIMA = 20, 16
# Texts of one tile; shingles of one block; comparisons made at a time.
TILE, BLOCK, _AT_ONCE = 1 << 14, 1 << 20, 1 << 18
_ODD = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def minima(hashes: np.ndarray) -> int:
    """A bit of the least hash under each of 64 orders."""
    least = np.full(64, np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[first : first + (1 << 12), None] * _ODD).min(axis=0))
    return int(np.packbits((mixed(least) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8")[0])


def _described(batches):
    for batch in batches:
        names, prints, least, sizes = [], [], [], []
        for t in batch.column(2).cast(pa.binary()):
            words = words_of(t.as_py() or b"")
            hashes = shingle_hashes(words, SIZE)
            names.append(xxhash.xxh3_64_intdigest(b" ".join(words), SEED))
            prints.append(bits_in_half(hashes))
            hashes = np.unique(hashes)
            least.append(minima(hashes))
            sizes.append(len(hashes))
        signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (names, prints, least)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *signed, pa.array(sizes, pa.int64())], ["doc_id", "digest", "name", "print", "least", "n"])


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return LEAST[1] * np.minimum(a, b) >= LEAST[0] * np.maximum(a, b)


def _forest(names: np.ndarray, parent: np.ndarray) -> pa.Table:
    moved = np.nonzero(parent != np.arange(len(parent)))[0]
    return pa.table({"a": pa.array(names[moved]), "b": pa.array(names[parent[moved]])})


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    side = table.column("side").to_numpy()
    left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
    return left, right if len(right) else left  # a part against itself


def _candidates(table: pa.Table) -> pa.Table:
    names, n = table.column("name").to_numpy(), table.column("n").to_numpy()
    prints, least = (table.column(c).to_numpy().view(np.uint64) for c in ("print", "least"))
    left, right = _sides(table)
    parent = np.arange(len(names))
    rows = max(1, _AT_ONCE // max(1, len(right)))
    for first in range(0, len(left), rows):
        part = left[first : first + rows]
        i, j = np.nonzero(np.bitwise_count(prints[part][:, None] ^ prints[right][None, :]) <= RADIUS)
        i, j = part[i], right[j]
        own = (i != j) & (np.bitwise_count(least[i] ^ least[j]) <= MINIMA) & _alike(n[i], n[j])
        if own.any():
            parent = _join(parent, i[own], j[own])
    return _forest(names, parent)


def _shingles(batches):
    for batch in batches:
        sets = [np.unique(shingle_hashes(words_of(t.as_py() or b""), SIZE)).view(np.int64) for t in batch.column(3).cast(pa.binary())]
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], ["name", "root", "blocks", "shingles"])


def _verified(table: pa.Table) -> pa.Table:
    """Links of pairs that are similar enough, as a forest; pairs that are linked already are not compared."""
    names, lists = table.column("name").to_numpy(), table.column("shingles").combine_chunks()
    left, right = _sides(table)
    n = np.array(lists.value_lengths())
    stops = np.cumsum(n)
    starts = stops - n
    found, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    own = np.zeros(len(found), np.int64)
    inside = np.concatenate([codes[starts[j] : stops[j]] for j in right])
    at = np.cumsum(n[right]) - n[right]
    parent = np.arange(len(names))
    for i in left:
        might = (parent[right] != parent[i]) & _alike(n[right], n[i])
        if not might.any():
            continue
        mine = codes[starts[i] : stops[i]]
        own[mine] = 1
        shared = np.add.reduceat(own[inside], at)
        own[mine] = 0
        near = right[might & (LEAST[1] * shared >= LEAST[0] * (n[right] + n[i] - shared))]
        if len(near):
            parent = _join(parent, np.full(len(near), i), near)
    return _forest(names, parent)


def _paired(df: DataFrame, part: str, parts: str, *columns: str) -> DataFrame:
    """Every row once for each part that its own is compared with: ``p``, ``q`` and the row's ``side``."""
    met = df.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1)))
    return met.select(*columns, F.least(part, "_other").alias("p"), F.greatest(part, "_other").alias("q"), (F.col(part) > F.col("_other")).cast("int").alias("side"))


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``component_id``, the smallest id reachable over texts whose five-word shingles have a
    similarity (shared ones among all of both) of 0.8 or more, for every row, as well as the ``digest`` of its text and
    the ``root`` of its component: rows that share an id may lie in several.

    Words are those of :func:`simhash.fingerprints`. Defined cases: texts equal in words are one text, wordless
    ones, too; fewer words than five are one shingle; a null id has no say in the smallest id.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    described = stash(arrow(rows, _described, "doc_id bigint, digest bigint, name bigint, print bigint, least bigint, n bigint"), "prints")
    texts = described.groupBy("name").agg(F.min("doc_id").alias("first"), F.min("digest").alias("digest"), F.min("print").alias("print"), F.min("least").alias("least"), F.min("n").alias("n"))
    texts = stash(texts, "distinct")
    tiles = max(1, -(-texts.count() // TILE))
    tiled = texts.withColumn("tile", F.pmod(F.xxhash64("name"), F.lit(tiles))).withColumn("tiles", F.lit(tiles).cast("long"))
    pairs = _paired(tiled, "tile", "tiles", "name", "print", "least", "n")
    parts = components(pairs.groupBy("p", "q").applyInArrow(_candidates, "a bigint, b bigint"))

    members = texts.join(parts.withColumnRenamed("node", "name"), "name").select("name", "root", "digest", "n")
    sizes = members.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("long").alias("blocks"))
    wanted = members.join(sizes, "root").select("name", "root", "blocks", "digest")
    fetched = rows.select("digest", "text").join(wanted, "digest").dropDuplicates(["name"]).select("name", "root", "blocks", "text")
    sets = arrow(fetched, _shingles, "name bigint, root bigint, blocks bigint, shingles array<bigint>")
    blocks = _paired(sets.withColumn("block", F.pmod(F.xxhash64("name"), "blocks")), "block", "blocks", "name", "root", "shingles")
    same = components(blocks.groupBy("root", "p", "q").applyInArrow(_verified, "a bigint, b bigint"))

    rooted = texts.join(same.withColumnRenamed("node", "name"), "name", "left").select("name", "first", F.coalesce("root", "name").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("name", "component_id", "root")
    return described.select("doc_id", "digest", "name").join(named, "name").select("doc_id", "component_id", "digest", "root")
