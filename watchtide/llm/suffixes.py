"""Repeated passages by distributed prefix doubling over content-chosen positions.

A position's name is the pair of the names of its two halves, so names of 8 bytes grow to 16, 32 and 64
where the text lies, and from there, by grouping in Spark, through longer and longer strings to the full
window. A position whose name is unique cannot start a repeat and drops out; one whose whole surroundings
occur twice is settled at once; only what lies between goes on to a longer name.

Naming every byte would shuffle each text dozens of times over. Every window of ``WINDOW`` bytes is
therefore known by one position inside it, its leftmost smallest 64-byte name, which equal windows share.
That is one position in about seventy. A position answers for the windows it was chosen by: with ``d`` the
distance from a window's start to the position, an interval of ``d``.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, mixed, pieces, release, stash, text_bytes

WINDOW = 200
GRAM = 64
# Windows per block in the later rounds; each round names strings of WINDOW + 1 - block bytes and longer.
BLOCKS = (16, 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A
    y = b ^ (b >> np.uint64(29))
    y *= _B
    x += y
    x ^= x >> np.uint64(32)
    return x


def grams(data: np.ndarray) -> np.ndarray:
    """The 64-byte names of all positions, by doubling; positions within 64 bytes of the end read zeros."""
    n = len(data)
    padded = np.zeros(n + 72, np.uint8)
    padded[:n] = data
    x = np.ndarray((n + 64,), dtype="<u8", buffer=padded, strides=(1,)).copy()
    for half in (8, 16, 32):
        x = _pair(x[: len(x) - half], x[half:])
    return mixed(x[:n])


def _leftmost_least(names: np.ndarray, span: int) -> np.ndarray:
    """For each i, the leftmost position of the least name in i .. i + span - 1."""
    least, at, size = names, np.arange(len(names), dtype=np.int32), 1
    while size < span:
        step = min(size, span - size)
        lower = least[step:] < least[: len(least) - step]
        at = np.where(lower, at[step:], at[: len(at) - step])
        least = np.minimum(least[step:], least[: len(least) - step])
        size += step
    return at


def _string_names(names: np.ndarray, start: np.ndarray, length: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Names of strings of ``GRAM`` up to six grams' bytes, from the grams that cover them."""
    out = mixed(length.astype(np.uint64) * _B + salt.astype(np.uint64))
    for k in range(6):
        out = _pair(out, names[start + np.minimum(GRAM * k, length - GRAM)])
    return mixed(out)


def positions(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
    """Of the rows in ``data``: (row, position, smallest d, largest d, core, hull) of every chosen position,
    with the names of the 64 bytes at it and of all bytes that its windows cover."""
    names = grams(data)
    n = len(data)
    if n < window:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    at = _leftmost_least(names, window - GRAM + 1)[: n - window + 1]
    ends = np.repeat(offsets[1:], np.diff(offsets))[: n - window + 1]
    at = np.where(np.arange(len(at)) + window <= ends, at, -1)
    first = np.concatenate(([0], np.nonzero(at[1:] != at[:-1])[0] + 1))
    last = np.concatenate((first[1:], [len(at)])) - 1
    p = at[first].astype(np.int64)
    own = p >= 0
    p, first, last = p[own], first[own], last[own]
    row = np.searchsorted(offsets, p, side="right") - 1
    hull = _string_names(names, first, last - first + window, p - first)
    return row, p - offsets[row], p - last, p - first, names[p], hull


def _survey(batches, window: int):
    packer = zstandard.ZstdCompressor(level=4)
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for a, b in pieces(offsets):
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            row, p, low, high, core, hull = positions(part, own, window)
            raw = part.tobytes()
            packed = [packer.compress(raw[s:e]) for s, e in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
            lists = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=b - a)))).astype(np.int32)
            where = (p << 16) | (low << 8) | high
            as_list = lambda x: pa.ListArray.from_arrays(lists, pa.array(x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(a, b - a), pa.array(np.diff(own)), pa.array(packed, pa.binary()), as_list(where), as_list(core), as_list(hull)],
                ["row", "n_bytes", "packed", "at", "core", "hull"],
            )


def _schema(row: T.DataType, **columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("row", row), *[T.StructField(n, k) for n, k in columns.items()]])


_LONG, _LONGS, _BYTES, _STRING = T.LongType(), T.ArrayType(T.LongType()), T.BinaryType(), T.StringType()


def _cut(batches, block: int, window: int):
    """Blocks of windows of the wanted positions, with the names of their common core and their whole hull."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        uid, size = batch.column("uid").to_numpy(), batch.column("n_bytes").to_numpy()
        for k in range(len(uid)):
            if not size[k]:
                continue
            data = np.frombuffer(unpacker.decompress(batch.column("packed")[k].as_py(), max_output_size=int(size[k])), np.uint8)
            at = batch.column("at")[k].values.to_numpy()
            query = np.array(batch.column("query")[k].values.to_pylist(), bool)
            p, low, high = at >> 16, (at >> 8) & 255, at & 255
            firsts = low // block
            counts = high // block - firsts + 1
            row = np.repeat(np.arange(len(p)), counts)
            step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            which = firsts[row] + step
            x, y = np.maximum(low[row], which * block), np.minimum(high[row], which * block + block - 1)
            p = p[row]
            names = grams(data)
            core = _string_names(names, p - which * block, np.full(len(p), window + 1 - block), which + 1000)
            hull = _string_names(names, p - y, y - x + window, x * 1024 + y + (1 << 20))
            for a in range(0, len(p), 1 << 15):
                s = slice(a, a + (1 << 15))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(p[s]), uid[k])), pa.array((p[s] << 16) | (x[s] << 8) | y[s]), pa.array(query[row][s]), pa.array(core[s].view(np.int64)), pa.array(hull[s].view(np.int64))],
                    ["uid", "at", "query", "core", "hull"],
                )


_ROWS = "uid bigint, at bigint, query boolean, core bigint, hull bigint"


def _round(rows: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """(settled, open): positions whose whole hull occurs elsewhere, and those that need a longer name,
    with one witness for each hull that they may share a part with."""
    # counts are tables of their own before rows meet them: Spark splits a heavy key in a plain join only
    hulls = rows.groupBy("core", "hull").agg(F.count("*").alias("n"), F.max("query").alias("asked"))
    if last:
        twice = stash(hulls.filter("n > 1").select("core", "hull"), "hulls")
        return rows.filter("query").join(twice, ["core", "hull"], "left_semi").select("uid", "at"), None
    hulls = stash(hulls, "hulls")
    cores = hulls.groupBy("core").agg(F.count("*").alias("hulls"), F.max(F.expr("n = 1 and asked")).alias("wanting"))
    cores = stash(cores.filter("hulls > 1 and wanting").select("core", F.lit(True).alias("open")), "cores")
    keys = hulls.join(cores, "core", "left").select("core", "hull", "n", F.coalesce("open", F.lit(False)).alias("open")).filter("n > 1 or open")
    keys = stash(keys, "keys")
    known = stash(rows.join(keys, ["core", "hull"]), "known")
    settled = known.filter("query and n > 1").select("uid", "at")
    witness = known.filter("open and n > 1").groupBy("core", "hull").agg(F.min(F.struct("uid", "at")).alias("one"))
    more = known.filter("open and n = 1").select("uid", "at", "query").unionByName(witness.select("one.uid", "one.at", F.lit(False).alias("query")))
    return settled, more


def repeats(docs: DataFrame, window: int = WINDOW, blocks: tuple[int, ...] = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(survey, settled): every row of ``docs`` with a ``uid``, its size, compressed text and other columns
    (in ``row``); and ``uid`` and ``at`` of the positions whose windows occur again."""
    spark = docs.sparkSession
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(*others).alias("row"))
    schema = _schema(rows.schema["row"].dataType, n_bytes=_LONG, packed=_BYTES, at=_LONGS, core=_LONGS, hull=_LONGS)
    survey = stash(arrow(rows, partial(_survey, window=window), schema).withColumn("uid", F.monotonically_increasing_id()), "survey")
    found = survey.select("uid", F.explode(F.arrays_zip("at", "core", "hull")).alias("x")).select("uid", "x.at", F.lit(True).alias("query"), "x.core", "x.hull")
    common = stash(found.groupBy("core").count().filter("count > 1").select("core"), "cores")
    found = stash(found.join(common, "core", "left_semi"), "positions")
    parts = []
    for k, block in enumerate((0, *blocks)):
        if block:
            wanted = more.groupBy("uid").agg(F.collect_list("at").alias("at"), F.collect_list("query").alias("query"))
            cut = wanted.join(survey.select("uid", "n_bytes", "packed"), "uid").select("uid", "n_bytes", "packed", "at", "query")
            found = stash(arrow(cut, partial(_cut, block=block, window=window), _ROWS), "blocks")
        release(spark)
        settled, more = _round(found, k == len(blocks))
        parts.append(settled)
    settled = parts[0]
    for p in parts[1:]:
        settled = settled.unionByName(p)
    return survey, settled


def _runs(at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by the windows that ``at`` stands for."""
    p, low, high = at >> 16, (at >> 8) & 255, at & 255
    order = np.argsort(p - high, kind="stable")
    start, end = (p - high)[order], (p - low + window)[order]
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    firsts = np.nonzero(new)[0]
    return start[firsts], reach[np.concatenate((firsts[1:], [len(start)])) - 1]


def _kept(batches, window: int, digest: bool):
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for n, packed, at in zip(*(batch.column(c).to_pylist() for c in ("n_bytes", "packed", "at")), strict=True):
            text = unpacker.decompress(packed, max_output_size=n) if n else b""
            starts, ends = _runs(np.array(at, np.int64), window) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            edges = [0, *np.stack((starts, ends), axis=1).ravel().tolist(), n]
            kept = b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
            out.append((n - len(kept), len(starts), hashlib.sha256(kept).hexdigest() if digest else None, None if digest else kept))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        made = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n_bytes"), *made], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _judged(docs: DataFrame, window: int, digest: bool) -> DataFrame:
    survey, settled = repeats(docs, window)
    at = stash(settled.groupBy("uid").agg(F.collect_list("at").alias("at")), "settled")
    release(docs.sparkSession)
    rows = survey.select("uid", "row", "n_bytes", "packed").join(at, "uid", "left").drop("uid")
    schema = _schema(rows.schema["row"].dataType, n_bytes=_LONG, n_removed=_LONG, n_spans=_LONG, kept_sha256=_STRING, kept=_BYTES)
    return arrow(rows, partial(_kept, window=window, digest=digest), schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """Remove every byte covered by a ``window``-byte string that also starts anywhere else in ``docs``.

    Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and either ``kept``,
    the remaining bytes, or with ``digest`` their ``kept_sha256``.

    Defined cases: texts are UTF-8 bytes and a null text is empty; texts shorter than the window keep all;
    strings are judged on the input, so of equal texts none is spared; cuts may fall within a character;
    repeated rows are copies of each other; an empty table gives no row. Only ``doc_id`` and ``text`` are
    read.
    """
    done = _judged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), window, digest)
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept")


def _text(batches):
    for batch in batches:
        texts = [None if k is None else k.decode(errors="ignore") for k in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the bytes that :func:`remove_repeats` removes cut from ``text``; all columns stay.

    Where a cut falls within a character, the rest of the character goes too. A null text becomes empty.
    """
    done = _judged(docs, window, False).select("row", "kept")
    cut = arrow(done, _text, _schema(done.schema["row"].dataType, text=_STRING))
    return cut.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
