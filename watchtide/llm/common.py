"""What the training-data operators share: whole-row reads, shared tables, words and batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

# Rows per Arrow batch handed to Python. Texts may be long, so batches are kept short.
BATCH_ROWS = 256
# UTF-8 bytes of text that one Python step works on at a time.
PIECE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow(df: DataFrame, step, schema: str) -> DataFrame:
    """``mapInArrow`` with short batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(step, schema)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{checkpoint_root(spark).rstrip('/')}/llm-{kind}-{uuid.uuid4().hex}"


def stash(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there, and a lost
    executor costs no more than the tasks that were running on it."""
    path = shared_path(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: its cleaner waits for the driver's garbage
    collector, which on a quiet driver may not run before the disks are full."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its n + 1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if wide.null_count:
        wide = wide.fill_null(b"")
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], dtype=np.uint8) if wide.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(wide) else data[:0], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about ``limit`` bytes; a longer row is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return text.lower().split()


def held_out(modulus: int, rest: int):
    """Whether the checksum of the id, as text, leaves ``rest``; such rows are never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == rest


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_UPPER = np.zeros(256, np.uint8)
_UPPER[ord("A") : ord("Z") + 1] = 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of every maximal run of bytes for which ``inside``, indexed by byte, holds."""
    flag = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = flag[1:] != flag[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True  # words end with their text
    cuts = np.nonzero(edge)[0]
    starts, ends = cuts[:-1], cuts[1:]
    own = flag[starts] if len(data) else np.zeros(0, bool)
    starts, ends = starts[own], ends[own]
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends - starts


def prefix_words(data: np.ndarray) -> np.ndarray:
    """At every position the next eight bytes as one number, first byte lowest; zeros beyond the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 8,), dtype="<u8", buffer=padded, strides=(1,))


def lowered(data: np.ndarray) -> np.ndarray:
    return data + _UPPER[data]


def first_bytes(words: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first ``length`` bytes, eight at most, of each packed number."""
    bits = (np.minimum(length, 8) * 8).astype(np.uint64)
    mask = np.where(bits >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1))
    return words & mask


def word_names(packed: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Names of whole words, from their bytes eight at a time."""
    out = mixed(lengths.astype(np.uint64) + np.uint64(1))
    for at in range(0, int(lengths.max(initial=0)), 8):
        more = lengths > at
        out[more] = mixed(out[more] ^ first_bytes(packed[starts[more] + at], lengths[more] - at)) + np.uint64(at)
    return out
