"""Token ids in length-delimited binary files with checksums, and an offset index for shuffled reads.

A record is: the payload's length (unsigned 64 bits), the masked checksum of those eight bytes, the
payload, its masked checksum (unsigned 32 bits), and one line feed, all little-endian. The payload is a
byte that tells whether the id is null, the id (signed 64 bits) and the token ids in two bytes each (four
if the vocabulary needs them). The checksum is CRC-32, rotated right by 15 bits plus a constant, so that
stored checksums are not themselves checksummed data of the same kind.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, pieces, stash, text_bytes

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
# Text bytes that one file should hold.
FILE_BYTES = 8 << 20
# Text bytes that are cut and encoded at a time; a longer text alone.
STEP_BYTES = 2 << 20
# Distinct cuts of text whose ids a worker remembers in each of two generations.
MEMORY = 300_000
_MASK = 0xA282EAD8
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")
_OWN = struct.Struct("<Bq")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _TAIL.pack(masked(length)), payload, _TAIL.pack(masked(payload))))  # the writer adds the line feed


def records(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of every record; raises on a damaged one."""
    at = 0
    while at < len(content):
        length, check = _HEAD.unpack_from(content, at)
        if check != masked(content[at : at + 8]):
            raise ValueError(f"damaged length at byte {at}")
        payload = content[at + 12 : at + 12 + length]
        if len(payload) != length or _TAIL.unpack_from(content, at + 12 + length)[0] != masked(payload):
            raise ValueError(f"damaged record at byte {at}")
        yield at, payload
        at += 12 + length + 5


# What a byte may be next to a cut: part of a letter, of a visible character, white space, white space but a blank,
# a visible sign, and such a sign but the apostrophe that begins "'s".
_LETTER, _SOLID, _WHITE, _BREAK, _SIGN, _PLAIN = 1, 2, 4, 8, 16, 32
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _SOLID | _SIGN | _PLAIN
_KIND[ord("'")] = _SOLID | _SIGN
_KIND[ord("0") : ord("9") + 1] = _SOLID
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = _LETTER | _SOLID
_KIND[9:14] = _WHITE | _BREAK
_KIND[32] = _WHITE
# Last bytes of the letters from U+00C0 to U+00FF; all of them begin with the same byte.
_LATIN_LEAD = 0xC3
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
# A word whose ids stay the same between line feeds.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_WORDS_AT_ONCE = 64


def cut_places(data: np.ndarray) -> np.ndarray:
    """Whether a text may be cut before each byte without a change of its ids.

    In this kind of vocabulary no unit has white space behind a visible character or mixes letters with signs, apart
    from "'s" and its like. A cut is never made behind white space, where the unit depends on what follows, except
    behind a single character that is no blank and before a letter.
    """
    kind = _KIND[data]
    end = kind.copy()  # the kind of the character that ends here
    if len(data) > 1:
        end[1:][(data[:-1] == _LATIN_LEAD) & _LATIN[data[1:]]] = _LETTER | _SOLID
    places = np.zeros(len(data), bool)
    before, here = end[:-1], kind[1:]
    letter = (here & _LETTER) != 0
    places[1:] = ((before & _SOLID) != 0) & ((here & _WHITE) != 0)
    places[1:] |= ((before & _LETTER) != 0) & ((here & _SIGN) != 0)
    places[1:] |= ((before & _PLAIN) != 0) & letter
    places[2:] |= ((before[1:] & _BREAK) != 0) & ((end[:-2] & _SOLID) != 0) & letter[1:]
    return places


class Encoder:
    """Ids of texts. Texts are cut where that leaves their units whole, equal cuts are found by Arrow, and the ids of
    each cut are remembered: the latest ``MEMORY`` cuts, and those before them until they are replaced."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        special = [re.escape(t.content.encode()) for t in self.model.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(special)) if special else None
        self.line_feed = self.model.encode("\n", add_special_tokens=False).ids
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """The packed ids of every text, the end id last; a null text is empty."""
        data, offsets = text_bytes(texts)
        end = self.packed([END_ID])
        if not len(data):
            return [end] * len(texts)
        starts = np.flatnonzero(self._places(data, offsets))
        borders = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        cuts = pa.Array.from_buffers(pa.binary(), len(starts), [None, borders, pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self._ids(cuts.dictionary.to_pylist()), pa.large_binary()).take(cuts.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(starts, offsets)].tolist()
        content = memoryview(ids.buffers()[2])
        return [b"".join((content[first:last], end)) for first, last in zip(at, at[1:])]

    def _places(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where cuts begin; a text with a special token in it stays whole."""
        places = cut_places(data)
        if self.special is not None and self.special.search(data):
            for first, last in zip(offsets.tolist(), offsets[1:].tolist()):
                if self.special.search(data[first:last]):
                    places[first:last] = False
        places[offsets[offsets < len(data)]] = True
        return places

    def _ids(self, cuts: list[bytes]) -> list[bytes]:
        if len(self.recent) > MEMORY:
            self.older, self.recent = self.recent, {}
        recent, older = self.recent, self.older
        found = list(map(recent.get, cuts))
        words, others = [], []
        for k in (k for k, ids in enumerate(found) if ids is None):
            cut = cuts[k]
            if (ids := older.get(cut)) is not None:
                found[k] = recent[cut] = ids
            else:
                (words if _WORD.fullmatch(cut) else others).append(k)
        # words are encoded many at once, a line feed between two
        for run in (words[n : n + _WORDS_AT_ONCE] for n in range(0, len(words), _WORDS_AT_ONCE)):
            parts = self._words([cuts[k] for k in run])
            if parts is None:
                others += run
                continue
            for k, ids in zip(run, parts, strict=True):
                found[k] = recent[cuts[k]] = ids
        for first in range(0, len(others), 1024):
            run = others[first : first + 1024]
            for k, e in zip(run, self.model.encode_batch_fast([cuts[k].decode() for k in run], add_special_tokens=False), strict=True):
                found[k] = recent[cuts[k]] = self.packed(e.ids)
        return found

    def _words(self, words: list[bytes]) -> list[bytes] | None:
        """Ids of words, encoded as one text; None if the line feeds between them cannot be told from ids of words."""
        if len(self.line_feed) != 1:
            return None
        (e,) = self.model.encode_batch_fast([b"\n".join(words).decode()], add_special_tokens=False)
        ids = np.array(e.ids, f"<u{self.width}")
        feeds = np.flatnonzero(ids == self.line_feed[0])
        if len(feeds) != len(words) - 1:
            return None
        content, feeds = ids.tobytes(), (feeds * self.width).tolist()
        return [content[first:last] for first, last in zip([0, *(f + self.width for f in feeds)], [*feeds, len(content)])]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One per worker process, so that later tasks find what earlier ones have learned."""
    return Encoder(path)


def _frame(batches, vocabulary: str):
    encoder = _encoder(vocabulary)
    for batch in batches:
        ids = batch.column(0).to_pylist()
        offsets = text_bytes(batch.column(1))[1]
        for first, last in pieces(offsets, STEP_BYTES):
            packed = encoder.encode_column(batch.column(1).slice(first, last - first))
            out = [framed(_OWN.pack(i is None, i or 0) + b) for i, b in zip(ids[first:last], packed, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Encode every whole text and write the records to ``folder`` in ascending ``doc_id`` order.

    Files are ranges of ids, numbered in order, and go through Spark's own committer, so that an attempt
    that is lost or repeated leaves nothing behind. Defined cases: a null text is empty and has the end id
    alone; null ids come first; repeated rows keep their own records; an empty table gives no record.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-size // file_bytes))
    ordered = rows.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    framed_rows = arrow(ordered, partial(_frame, vocabulary=path), "value binary")
    framed_rows.select(F.col("value").cast("string").alias("value")).write.option("compression", "none").text(f"{folder}/records")


def _scan(batches, width: int):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for offset, payload in records(content.as_py()):
                null, own = _OWN.unpack_from(payload)
                ids = np.frombuffer(payload, dtype=f"<u{width}", offset=_OWN.size).astype("<u4")
                rows.append((path, offset, len(payload) + 17, None if null else own, len(ids), zlib.crc32(ids.tobytes())))
            for first in range(0, len(rows), 4096):
                columns = list(zip(*rows[first : first + 4096], strict=True))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "offset", "length", "doc_id", "n_tokens", "ids_crc32"])


_INDEX = "file string, offset bigint, length bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/records")
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "content")


def _number(file: str):
    """Place of a file: names have five digits at least, so from 100 000 files on their order as text is another one."""
    return F.regexp_extract(file, "part-([0-9]+)", 1).cast("bigint")


def index(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """Read the files back, check every record, and write the index: where each record lies, its length,
    token count and checksum, and ``start``, the tokens of all records before it."""
    usual = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, "1")  # a row is a whole file
    found = stash(_files(spark, folder).mapInArrow(partial(_scan, width=width), _INDEX), "offsets")
    spark.conf.set(_BATCH, usual)
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    earlier = totals.select("file", (F.sum("n").over(Window.orderBy(_number("file"))) - F.col("n")).alias("earlier"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("offset")) - F.col("n_tokens")
    full = found.withColumn("inside", inside).join(earlier, "file").withColumn("start", F.col("earlier") + F.col("inside"))
    full.select("file", "offset", "length", "doc_id", "start", "n_tokens", "ids_crc32").write.option("compression", "zstd").parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _fetch(batches, width: int):
    for batch in batches:
        for content, offsets, order in zip(batch.column("content"), batch.column("offsets").to_pylist(), batch.column("places").to_pylist(), strict=True):
            content = content.as_py()
            rows = []
            for at, place in zip(offsets, order, strict=True):
                length, _ = _HEAD.unpack_from(content, at)
                payload = content[at + 12 : at + 12 + length]
                null, own = _OWN.unpack_from(payload)
                rows.append((place, None if null else own, np.frombuffer(payload, dtype=f"<u{width}", offset=_OWN.size).astype(np.int32).tolist()))
            for first in range(0, len(rows), 64):
                places, own, ids = zip(*rows[first : first + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(own, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["place", "doc_id", "ids"])


def read_shuffled(spark: SparkSession, folder: str, seed: int = 0, width: int = 2) -> DataFrame:
    """All records in a seeded random order, found by their offsets: ``place`` orders them, ``ids`` holds the tokens."""
    spark.conf.set(_BATCH, "1")
    order = spark.read.parquet(f"{folder}/index").select("file", "offset", F.xxhash64(F.lit(seed), "file", "offset").alias("place"))
    wanted = order.groupBy("file").agg(F.collect_list("offset").alias("offsets"), F.collect_list("place").alias("places"))
    joined = _files(spark, folder).join(wanted, "file").select("content", "offsets", "places")
    return joined.mapInArrow(partial(_fetch, width=width), "place bigint, doc_id bigint, ids array<int>").orderBy("place")
