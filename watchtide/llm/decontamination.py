"""Benchmark decontamination by spaced-seed hashing and substitution-tolerant verification."""

from __future__ import annotations

import math
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, lowered, mixed, pieces, prefix_words, stash, text_bytes, word_names, word_spans

# Words of a window, the share of them that must agree, and the fewest words of an item that count as evidence.
SPAN, SHARE, LEAST = 13, 0.8, 5
# Positions of a window fall into four interleaved groups; each seed reads two of them and ignores the
# others, so two substitutions anywhere leave one seed at least untouched.
GROUPS = [tuple(range(g, SPAN, 4)) for g in range(4)]
SEEDS = list(combinations(range(4), 2))
# The table of bits that sorts out hashes which no item has: two bits of it are set for each hash. Bits per
# hash, and its largest size (32 MB).
BITS_EACH, MOST_BITS = 256, 1 << 28
_LOW = 36  # low bits of a hash, which the second bit's place comes from
_WORD = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_TURN = [np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) % 2**64) for j in range(SPAN)]


def word_sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, name) of every word: runs of letters and digits, A-Z lower-cased."""
    low = lowered(data)
    row, starts, lengths = word_spans(low, offsets, _WORD)
    return row, word_names(prefix_words(low), starts, lengths)


def window_hashes(names: np.ndarray, span: int) -> np.ndarray:
    """Seeds x windows: the hash of the words that each seed reads of the ``span`` words at each place."""
    n = len(names) - span + 1
    sums = []
    for group in GROUPS:
        total = np.zeros(n, np.uint64)
        for j in group:
            if j < span:
                total += names[j : j + n] * _TURN[j]
        sums.append(mixed(total))
    return np.stack([mixed(sums[a] + (sums[b] ^ (sums[b] >> np.uint64(7))) * _TURN[3] + np.uint64(1000 * span + k)) for k, (a, b) in enumerate(SEEDS)])


def _windows(row: np.ndarray, names: np.ndarray, span: int):
    """(row, first word, hashes) of every window within one row."""
    if len(names) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((len(SEEDS), 0), np.uint64)
    hashes = window_hashes(names, span)
    own = row[: len(names) - span + 1] == row[span - 1 :]
    at = np.nonzero(own)[0]
    return row[at], at, hashes[:, at]


def _content(names: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, pa.Array]:
    words = names[at[:, None] + np.arange(span)] if len(at) else np.zeros((0, span), np.uint64)
    whole = mixed((words * np.array(_TURN[:span])).sum(axis=1, dtype=np.uint64) + np.uint64(span))
    lists = pa.ListArray.from_arrays(np.arange(0, (len(at) + 1) * span, span, dtype=np.int32), pa.array(words.ravel().view(np.int64)))
    return whole, lists


def _as_rows(ids, row, at, first, span, names, hashes):
    whole, words = _content(names, at, span)
    seeds = pa.ListArray.from_arrays(np.arange(0, (len(at) + 1) * len(SEEDS), len(SEEDS), dtype=np.int32), pa.array(hashes.T.ravel().view(np.int64)))
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(row)), pa.array(at - first[row]), pa.array(np.full(len(at), span, np.int32)), pa.array(whole.view(np.int64)), words, seeds],
        ["id", "at", "span", "window", "words", "hashes"],
    )


_ROWS = "id bigint, at bigint, span int, window bigint, words array<bigint>, hashes array<bigint>"


def _parts(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for a, b in pieces(offsets):
            row, names = word_sequence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            first = np.searchsorted(row, np.arange(b - a))
            yield batch.column(0).slice(a, b - a), row, names, first, b - a


def _item_windows(batches):
    for ids, row, names, first, n in _parts(batches):
        count = np.bincount(row, minlength=n)
        for span in range(LEAST, SPAN + 1):
            # an item shorter than a window is one window of its own length
            fits = count >= SPAN if span == SPAN else count == span
            r, at, hashes = _windows(row, names, span)
            keep = fits[r]
            if keep.any():
                yield _as_rows(ids, r[keep], at[keep], first, span, names, hashes[:, keep])


def _suspects(batches, table, spans: list[int]):
    bits = table.value
    size = int(math.log2(len(bits) * 8))

    def is_set(slot: np.ndarray) -> np.ndarray:
        return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0

    for ids, row, names, first, _ in _parts(batches):
        for span in spans:
            r, at, hashes = _windows(row, names, span)
            seed, place = np.nonzero(is_set(hashes >> np.uint64(64 - size)))
            low = hashes[seed, place] & np.uint64((1 << _LOW) - 1)
            keep = np.unique(place[is_set(low >> np.uint64(_LOW - size))])
            for s in range(0, len(keep), 4096):
                chosen = keep[s : s + 4096]
                yield _as_rows(ids, r[chosen], at[chosen], first, span, names, hashes[:, chosen])


def _bit_table(hashes: DataFrame, count: int) -> np.ndarray:
    bits = min(MOST_BITS, 1 << max(16, math.ceil(math.log2(max(1, count) * BITS_EACH))))
    size = int(math.log2(bits))
    low = F.col("hash").bitwiseAND(F.lit((1 << _LOW) - 1))
    slots = hashes.select(F.explode(F.array(F.shiftrightunsigned("hash", 64 - size), F.shiftrightunsigned(low, _LOW - size))).alias("slot"))
    words = slots.select(F.expr("slot div 64").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toLocalIterator():
        out[r.word] = r.bits
    return out.view(np.uint8)


def overlaps(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """Items that occur in documents: (doc_id, item_id, words, agree).

    Of the ``SPAN`` words of a window of the document and one of the item, in place, ``share`` must agree
    (an item of fewer words is a window of its own length). ``words`` counts the document's words
    within such windows, ``agree`` is the best share. Items with the same text count as the one with the
    smallest id.

    Windows whose seeds all miss a table of bits over the items' hashes are dropped where the text lies;
    the table's size is bounded and a full table only lets more windows through. What is left meets the
    items by hash, as distinct windows, so a passage that a third of all documents hold is compared once.

    Defined cases: null or wordless texts hold nothing; items under ``LEAST`` words are no evidence and
    match nothing; null ids are reported as null, each row without an id being a document of its own (ids
    lie above -2^62, below which such rows are numbered); repeated rows of an id count once; empty tables give no row. Only ``doc_id``, ``text`` and ``item_id``, ``text`` are read.
    """
    spark = docs.sparkSession
    single = items.groupBy("text").agg(F.min(F.col("item_id").cast("bigint")).alias("item_id")).select("item_id", "text")
    known = stash(arrow(single, _item_windows, _ROWS), "items")
    places = known.select(F.col("id").alias("item_id"), "span", F.col("window").alias("item_window")).distinct()
    theirs = known.groupBy("span", "window").agg(F.first("words").alias("theirs"), F.first("hashes").alias("hashes"))
    theirs = theirs.select("span", F.col("window").alias("item_window"), "theirs", F.posexplode("hashes").alias("seed", "hash"))
    size = theirs.agg(F.count("*").alias("n"), F.collect_set("span").alias("spans")).first()
    table = spark.sparkContext.broadcast(_bit_table(theirs.select("hash"), size.n))
    nameless = F.lit(-(1 << 63)).cast("bigint") + F.monotonically_increasing_id()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), nameless).alias("doc_id"), "text")
    suspects = stash(arrow(rows, partial(_suspects, table=table, spans=sorted(size.spans)), _ROWS), "suspects")

    ours = suspects.groupBy("span", "window").agg(F.first("words").alias("ours"), F.first("hashes").alias("hashes"))
    ours = ours.select("span", "window", "ours", F.posexplode("hashes").alias("seed", "hash"))
    same = F.aggregate(F.zip_with("ours", "theirs", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    met = ours.join(theirs, ["span", "seed", "hash"]).select("span", "window", "item_window", (same / F.col("span")).alias("agree"))
    pairs = met.filter(F.col("agree") >= share).distinct().join(places, ["span", "item_window"])
    pairs = pairs.groupBy("span", "window", "item_id").agg(F.max("agree").alias("agree"))
    found = suspects.select(F.col("id").alias("doc_id"), "at", "span", "window").join(pairs, ["span", "window"])
    at = found.groupBy("doc_id", "item_id", "at").agg(F.max("span").alias("span"), F.max("agree").alias("agree"))
    # words covered by overlapping windows of one document; a document and item are one small group
    following = F.lead("at").over(Window.partitionBy("doc_id", "item_id").orderBy("at"))
    covered = F.least(F.col("span").cast("bigint"), F.coalesce(following - F.col("at"), F.col("span").cast("bigint")))
    out = at.withColumn("covered", covered).groupBy("doc_id", "item_id").agg(F.sum("covered").alias("words"), F.max("agree").alias("agree"))
    return out.withColumn("doc_id", F.when(F.col("doc_id") >= -(1 << 62), F.col("doc_id")))
