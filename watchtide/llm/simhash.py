"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, stash, words_of
from .graph import components

SEED = 42
# Fingerprints of one tile; fuller cells are cut into several tiles.
TILE = 1 << 16
# Bits of the blocks whose set bits are compared while tiles are cut further.
_BLOCKS = [[(0, 32), (32, 32)], [(i, 16) for i in range(0, 64, 16)], [(i, 8) for i in range(0, 64, 8)]]
# Pairs that are compared outright.
_DIRECT = 1 << 18


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A hash of every ``size`` words in a row, repeats included; fewer words are one shingle."""
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)] if words else [], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], dtype="<u8")


def bits_in_half(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[first : first + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    chosen = np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")
    return int(chosen[0])


def fingerprint(text: bytes, size: int) -> int:
    """Bits set in over half the hashes of the text's ``size``-word shingles, repeats included."""
    return bits_in_half(shingle_hashes(words_of(text), size))


def _fingerprints(batches, size: int):
    for batch in batches:
        prints = np.array([fingerprint(t.as_py() or b"", size) for t in batch.column(1).cast(pa.binary())], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """``doc_id`` and ``print``, the fingerprint's 64 bits as a signed number, for every row.

    Texts are taken whole: A-Z lower-cased, words between ASCII white space. Fewer words than ``size``
    are one shingle; a null or wordless text has fingerprint 0.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return arrow(rows, partial(_fingerprints, size=size), "doc_id bigint, print bigint")


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            return parent
        parent = above


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] to b[i]; labels are indexes and always point downwards."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        parent = parent.copy()
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = _roots(parent)


def _counts(prints: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    return np.stack([np.bitwise_count((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)) for at, width in blocks], axis=1).astype(np.int16)


def _near(left: np.ndarray, right: np.ndarray, prints: np.ndarray, radius: int, depth: int, link) -> None:
    """Report every pair of ``left`` x ``right`` within ``radius`` bits; both hold indexes.

    The pair of tiles is cut by the set bits of ever smaller blocks. Two fingerprints differ in at least as
    many bits as their blocks' counts do, so sub-tiles further apart than the radius are skipped.
    """
    if len(left) * len(right) <= _DIRECT or depth == len(_BLOCKS):
        rows = max(1, _DIRECT // max(1, len(right)))
        for first in range(0, len(left), rows):
            part = left[first : first + rows]
            i, j = np.nonzero(np.bitwise_count(prints[part][:, None] ^ prints[right][None, :]) <= radius)
            if len(i):
                link(part[i], right[j])
        return
    blocks = _BLOCKS[depth]
    cells = []
    for side in (left, right):
        found, where = np.unique(_counts(prints[side], blocks), axis=0, return_inverse=True)
        order = np.argsort(where.ravel(), kind="stable")
        ends = np.cumsum(np.bincount(where.ravel()))
        cells.append((found, np.split(side[order], ends[:-1])))
    (found_l, parts_l), (found_r, parts_r) = cells
    for cell, part in zip(found_l, parts_l, strict=True):
        for k in np.nonzero(np.abs(found_r - cell).sum(axis=1) <= radius)[0]:
            _near(part, parts_r[k], prints, radius, depth + 1, link)


def _compare(batch: pa.Table, radius: int) -> pa.Table:
    """Links within a pair of tiles, as a forest: each linked fingerprint with the smallest index of its part."""
    side = batch.column("side").to_numpy()
    prints = batch.column("print").to_numpy().view(np.uint64)
    left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
    if not len(right):
        right = left  # a tile against itself
    parent = np.arange(len(prints))

    def link(a, b):
        nonlocal parent
        parent = _join(parent, a, b)

    _near(left, right, prints, radius, 0, link)
    moved = np.nonzero(parent != np.arange(len(prints)))[0]
    signed = prints.view(np.int64)
    return pa.table({"a": pa.array(signed[moved]), "b": pa.array(signed[parent[moved]])})


def links(distinct: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Edges (a, b) whose connected parts are those of all pairs of distinct ``print`` within ``radius`` bits.

    A tile is a cell of (bits set in the lower half, in the upper half), cut by hash into several where it
    is fuller than ``tile``. Tiles meet only where the counts differ by ``radius`` at most; every such pair
    is a task of its own, compared exactly, and returns a forest instead of all pairs.
    """
    low, high = F.bit_count(F.col("print").bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_count(F.shiftrightunsigned("print", 32))
    at = distinct.select("print", low.cast("int").alias("low"), high.cast("int").alias("high"))
    # at most 33 x 33 cells
    cells = at.groupBy("low", "high").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    here = at.join(F.broadcast(cells), ["low", "high"]).withColumn("tile", F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"))
    around = cells.select(F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("tiles").alias("tiles2"))
    apart = F.abs(F.col("low") - F.col("low2")) + F.abs(F.col("high") - F.col("high2"))
    # cells near a cell: a table of cells only, with their tiles as ranges
    near = cells.select("low", "high").withColumn("low2", F.explode(F.sequence(F.col("low") - radius, F.col("low") + radius)))
    near = near.withColumn("high2", F.explode(F.sequence(F.col("high") - radius, F.col("high") + radius))).filter(apart <= radius).join(F.broadcast(around), ["low2", "high2"])
    met = here.join(F.broadcast(near.select("low", "high", "low2", "high2", "tiles2")), ["low", "high"]).withColumn("tile2", F.explode(F.sequence(F.lit(0), F.col("tiles2") - 1)))
    mine, other = F.struct("low", "high", "tile"), F.struct(F.col("low2").alias("low"), F.col("high2").alias("high"), F.col("tile2").alias("tile"))
    pairs = met.select(
        "print", F.least(mine, other).alias("p"), F.greatest(mine, other).alias("q"), (mine > other).cast("int").alias("side"),
    )

    def compare(table):
        return _compare(table, radius)

    return pairs.groupBy("p", "q").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = 4, size: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links
    of ``radius`` bits at most, for every row.

    Defined cases: wordless texts share fingerprint 0 and link like any other; a null id has no say in the
    smallest id, and a part that holds only null ids has a null component; repeated rows come out once
    each; an empty table gives no row. Only ``doc_id`` and ``text`` are read.
    """
    rows = stash(fingerprints(docs, size), "prints")
    distinct = rows.groupBy("print").agg(F.min("doc_id").alias("first"))
    # two whole-range scans of a small table: the distinct fingerprints
    distinct = stash(distinct, "distinct")
    parts = components(links(distinct.select("print"), radius))
    rooted = distinct.join(parts.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.join(least, "root").select("print", "component_id")
    return rows.join(known, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
