"""Ranked lexical search: term at a time with limited accumulators.

Documents are cut into blocks; a block is searched for every item as a small index of its own. Within a block an
item's terms are visited from the rarest on. Every document of a visited posting gets an accumulator, until the bounds
of the terms still to come no longer reach the ``k``-th partial score, of this block or of those before it in the task:
from then on no accumulator is added, and those that exist are updated to their exact scores. A task hands on the best of
its blocks, and these are ranked together.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, stash

# Distinct (item, term) pairs that are searched for at a time, and so sent to every task.
PAIRS = 200_000
# Documents, and postings, that one block may hold.
BLOCK_DOCS, BLOCK_POSTINGS = 16_384, 1_000_000
# Groups in which the best of all blocks are first cut, so that an item is no single group.
MERGES = 64
# every byte of a term, lower-cased; a space for all others
_TERM = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256)).lower()
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _items(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of every item; rows that share an id are one item."""
    lowered = F.translate("text", _UPPER, _LOWER)
    pairs = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.explode(F.split(lowered, _SPLIT)).alias("term"))
    return pairs.filter("term <> ''").distinct()


def _index(batches, vocabulary: dict[bytes, int]):
    """Of every document: its id, number of terms, and the wanted ones with their counts."""
    for batch in batches:
        ids, sizes, terms, counts, ends = [], [], [], [], [0]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(_TERM).split()
            if not words:
                continue
            found = Counter(words)
            wanted = found.keys() & vocabulary.keys()
            ids.append(doc)
            sizes.append(len(words))
            terms += [vocabulary[w] for w in wanted]
            counts += [found[w] for w in wanted]
            ends.append(len(terms))
        ends = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, counts)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])


def impact(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term that occurs ``tf`` times adds to the score of a document of ``n`` terms, in 64-bit integers."""
    m = 50 + (50 * n * documents) // length
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Block:
    """Postings of some documents, by term."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, documents: int, length: int):
        docs = np.repeat(np.arange(len(n)), sizes)
        order = np.argsort(terms, kind="stable")
        self.docs, terms = docs[order], terms[order]
        self.parts = impact(weights[terms], counts[order].astype(np.int64), n[self.docs], documents, length)
        self.starts = np.searchsorted(terms, np.arange(len(weights) + 1))
        held = np.nonzero(np.diff(self.starts))[0]
        self.bounds = np.zeros(len(weights), np.int64)
        if len(held):
            self.bounds[held] = np.maximum.reduceat(self.parts, self.starts[held])
        self.size = len(n)

    def best(self, terms: list[int], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of all documents whose score for ``terms``, given from the rarest on, is positive and no
        less than ``floor`` and the ``k``-th best score here."""
        scores = np.zeros(self.size, np.int64)
        bounds = self.bounds[terms]
        left = bounds[::-1].cumsum()[::-1]  # what this and all later terms can add at most
        adding = True
        for at, term in enumerate(terms):
            if not bounds[at]:
                continue
            if adding and max(floor, scores.max() and _kth(scores, k, left[at])) > left[at]:
                adding = False  # a document without an accumulator cannot come in any more, not even by a tie
            docs, parts = self.postings(term)
            if not adding:
                has = scores[docs] > 0
                docs, parts = docs[has], parts[has]
            scores[docs] += parts  # a document is once in a posting list
        found = np.nonzero(scores >= max(floor, _kth(scores, k, 0), 1))[0]
        return found, scores[found]

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.starts[term], self.starts[term + 1])
        return self.docs[own], self.parts[own]


def _kth(scores: np.ndarray, k: int, least: int) -> int:
    """The ``k``-th partial score, or 0 where it is not above ``least``."""
    some = scores[scores > least]
    return int(np.partition(some, len(some) - k)[len(some) - k]) if len(some) >= k else 0


class Best:
    """The best documents of an item so far: scores, whether the id is there, ids and numbers of terms, in order."""

    def __init__(self, k: int):
        self.k = k
        self.columns = [np.zeros(0, np.int64) for _ in range(4)]

    @property
    def floor(self) -> int:
        return int(self.columns[0][-1]) if len(self.columns[0]) == self.k else 0

    def add(self, *columns: np.ndarray) -> None:
        scores, valid, ids, n = (np.concatenate(x) for x in zip(self.columns, columns, strict=True))
        order = np.lexsort((n, ids, valid, -scores))[: self.k]
        self.columns = [x[order] for x in (scores, valid, ids, n)]


def _search(batches, items: list[tuple[int | None, list[int]]], weights: np.ndarray, documents: int, length: int, k: int):
    held: list[pa.RecordBatch] = []
    best = [Best(k) for _ in items]
    docs = postings = 0

    def add_block() -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, terms, counts = (table[c].combine_chunks() for c in ("doc_id", "terms", "counts"))
        n, valid, plain = table["n"].to_numpy(), np.asarray(ids.is_valid()).astype(np.int64), ids.fill_null(0).to_numpy()
        block = Block(n, np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), counts.flatten().to_numpy(), weights, documents, length)
        for own, (_, of_item) in zip(best, items, strict=True):
            at, scores = block.best(of_item, k, own.floor)
            if len(at):
                own.add(scores, valid[at], plain[at], n[at])

    for batch in batches:
        held.append(batch)
        docs += len(batch)
        postings += len(batch.column(2).flatten())
        if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
            add_block()
            held, docs, postings = [], 0, 0
    if docs:
        add_block()
    for own, (item, _) in zip(best, items, strict=True):
        scores, valid, ids, n = own.columns
        if len(scores):
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), pa.array(ids, mask=valid == 0), pa.array(n), pa.array(scores)], ["item_id", "doc_id", "n", "score"])


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of every item: first within groups of its results, then of those that are left."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n")]
    some = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "n", "score"), F.lit(MERGES)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _weight(documents: int) -> Column:
    return F.floor(1000 * F.log(F.lit(2 * documents + 2).cast("double") / (2 * F.col("df") + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = 50, pairs: int = PAIRS) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score`` (above 0).

    Documents stay where they are read; a block is what one task has read of them. Items are searched for in
    rounds of about ``pairs`` (item, term) pairs, all that the driver and the tasks hold of them at a time.

    Defined cases: null texts and texts without a term are no documents and items without a term find nothing; rows that
    share an ``item_id``, null included, are one item with the terms of all; rows that share a ``doc_id`` are documents
    of their own; equal scores ascend by ``doc_id``, nulls first; empty tables give no row. Of ``docs`` only ``doc_id``
    and ``text`` are read, of ``items`` only ``item_id`` and ``text``.
    """
    spark = docs.sparkSession
    wanted = stash(_items(items), "items")
    rounds = max(1, -(-wanted.count() // pairs))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for turn in range(rounds):
        some = wanted.filter(F.pmod(F.xxhash64(F.lit("round"), "item_id"), F.lit(rounds)) == turn).collect()
        if some:
            out = out.unionByName(_round(rows, some, k))
    return out


def _round(rows: DataFrame, pairs: list, k: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({r.term.encode() for r in pairs}))}
    index = stash(arrow(rows, partial(_index, vocabulary=vocabulary), "doc_id bigint, n bigint, terms array<int>, counts array<int>"), "index")
    documents, length = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = {r.term: (r.df, r.weight) for r in df.select("term", "df", _weight(documents).alias("weight")).collect()}  # at most a row per wanted term
    weights = np.zeros(len(vocabulary), np.int64)
    for term, (_, weight) in known.items():
        weights[term] = weight
    own: dict[int | None, list[int]] = {}
    for r in pairs:
        if (term := vocabulary[r.term.encode()]) in known:
            own.setdefault(r.item_id, []).append(term)
    items = [(item, sorted(terms, key=lambda t: (known[t][0], t))) for item, terms in own.items()]
    step = partial(_search, items=items, weights=weights, documents=documents, length=max(length, 1), k=k)
    return _merged(index.mapInArrow(step, "item_id bigint, doc_id bigint, n bigint, score bigint"), k)
