"""BPE encoding and decoding with word ends, merged over a contiguous array of ranks.

A word is held as its parts and the rank of every pair of neighbouring parts. The least rank is found by a scan, the
boundary inside that pair is deleted and the ranks of the neighbours are looked up again, until no pair has a rank.
Words over ``SHORT`` parts, for which scans would be quadratic, take their pairs from a heap instead.

What the file says around the merges is followed: special tokens are found in the raw text; the rest is
composed (NFC), lower-cased one character at a time and cut into contractions, runs of letters, single digits and runs
of other characters, white space being dropped; bytes are written as printable characters. No word and no composed
character goes beyond white space, so a worker remembers the ids of whole chunks between white space.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from functools import lru_cache, partial
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow

VOCABULARY = "word_bpe_49k.json"
# Parts up to which a word is merged by scans.
SHORT = 128
# Distinct chunks, and words, whose ids a worker remembers in each of two generations; longer ones are not kept.
MEMORY, KEPT_LENGTH = 250_000, 64
# How the file describes its steps, and the pattern of its words.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEPS = ["NFC", "Replace", "Lowercase"]
# Characters that Python takes for white space and the file does not.
_NO_SPACES = "\x1c\x1d\x1e\x1f"
_NO_RANK = 1 << 60
# Planes in which letters and numbers lie.
_LAST = 0x40000


def _inside(codes: list[int]) -> str:
    """Code points in ascending order as the inside of a character class."""
    runs: list[list[int]] = []
    for code in codes:
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class Characters:
    """Which characters are letters and numbers, and how capitals are lowered.

    These are the tables of this Python; for characters that are newer than it the library is asked, so that both
    agree on every character.
    """

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        kinds: dict[str, list[int]] = {"L": [], "N": [], "Cn": []}
        for code in range(_LAST):
            kind = unicodedata.category(chr(code))
            if (found := kinds.get(kind if kind == "Cn" else kind[0])) is not None:
                found.append(code)
        unknown = "".join(map(chr, kinds["Cn"]))
        # beside a letter a letter is no word of its own, and so for other characters
        cut = Split(Regex(_SPLIT), "removed", invert=True).pre_tokenize_str
        letters = [ord(p[1]) for p, _ in cut(" ".join("a" + c for c in unknown)) if len(p) == 2]
        others = {ord(p[1]) for p, _ in cut(" ".join("!" + c for c in unknown)) if len(p) == 2}
        numbers = sorted(set(kinds["Cn"]) - set(letters) - others)
        lowered = Tokenizer.from_file(path).normalizer.normalize_str(unknown)
        self.lower = {ord(c): x for c, x in zip(unknown, lowered, strict=True) if c != x}
        inside = _inside(sorted(kinds["L"] + letters)), _inside(sorted(kinds["N"] + numbers))
        self.exact = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[{0}]+|[{1}]|(?:[^\\s{0}{1}]|[{2}])+".format(*inside, _NO_SPACES))
        # where all characters are of these, the classes of this Python mean the same and are tested faster
        self.quick = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
        self.plain = {chr(c) for c in range(0x250) if unicodedata.category(chr(c)) not in ("No", "Nl", "Cn")} - set(_NO_SPACES)

    def words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        plain = self.plain.issuperset(text)
        if not plain:
            text = text.translate(self.lower).replace("Σ", "σ")  # one character at a time: no final form of sigma
        return (self.quick if plain else self.exact).findall(text.lower())


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: its own where that is printable, else one from 256 on."""
    own = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 for b in range(256)]
    spare = iter(range(256, 512))
    return [chr(b) if own[b] else chr(next(spare)) for b in range(256)]


class Codec:
    """Encodes and decodes by one vocabulary file; holds what a worker has learned about words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        steps = [s["type"] for s in file["normalizer"]["normalizers"]]
        split = file["pre_tokenizer"]["pretokenizers"][0]
        if steps != _STEPS or split["pattern"].get("Regex") != _SPLIT or model["type"] != "BPE" or file["decoder"] or file["post_processor"]:
            raise ValueError("not a vocabulary of this kind")
        self.end = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        merges = [(self.ids[x], self.ids[y], self.ids[x + y]) for x, y in model["merges"]]
        self.ranks = {x << 32 | y: k for k, (x, y, _) in reversed(list(enumerate(merges)))}
        self.joined = [z for _, _, z in merges]
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in file["added_tokens"]):
            raise ValueError("special tokens with conditions are not of this kind")
        self.special = {s: struct.pack("<I", k) for s, k in added.items()}
        self.around = re.compile("(" + "|".join(re.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        names = {k: s for s, k in {**self.ids, **added}.items()}
        self.names = [names.get(k, "").encode() for k in range(max(names) + 1)]
        self.inner = [self.ids[c] for c in byte_characters()]
        self.last = [self.ids[c + self.end] for c in byte_characters()]
        self.characters = Characters(path)
        self.of_word, self.of_chunk = _Known(self._word), _Known(self._chunk)

    def merged(self, word: bytes) -> list[int]:
        """The parts of a word of at least one byte."""
        parts = [*map(self.inner.__getitem__, word[:-1]), self.last[word[-1]]]
        return self._scanned(parts) if len(parts) <= SHORT else self._heaped(parts)

    def _scanned(self, parts: list[int]) -> list[int]:
        rank, joined = self.ranks.get, self.joined
        ranks = [rank(x << 32 | y, _NO_RANK) for x, y in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NO_RANK:
                break
            at = ranks.index(least)  # the leftmost of equals
            new = parts[at] = joined[least]
            del parts[at + 1], ranks[at]  # the boundary between the two
            if at:
                ranks[at - 1] = rank(parts[at - 1] << 32 | new, _NO_RANK)
            if at < len(ranks):
                ranks[at] = rank(new << 32 | parts[at + 1], _NO_RANK)
        return parts

    def _heaped(self, parts: list[int]) -> list[int]:
        """The same for long words: pairs wait in a heap by rank and place; a pair of which a part has changed is skipped."""
        n, rank = len(parts), self.ranks.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]

        def push(x: int) -> None:
            y = after[x]
            if y >= 0 and (r := rank(parts[x] << 32 | parts[y])) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))

        heap: list[tuple[int, int, int, int]] = []
        for x in range(n):
            push(x)
        while heap:
            r, x, left, right = heapq.heappop(heap)
            y = after[x]
            if parts[x] != left or y < 0 or parts[y] != right:
                continue
            parts[x], parts[y] = self.joined[r], -1
            after[x] = after[y]
            if after[x] >= 0:
                before[after[x]] = x
            push(x)
            if before[x] >= 0:
                push(before[x])
        return [p for p in parts if p >= 0]

    def _word(self, word: str) -> bytes:
        parts = self.merged(word.encode())
        return struct.pack(f"<{len(parts)}I", *parts)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.of_word.__getitem__, self.characters.words(chunk)))

    def encode(self, text: str) -> bytes:
        """The ids of a text, each as a little-endian unsigned 32-bit integer."""
        out = []
        for piece in self.around.split(text) if self.around and self.around.search(text) else [text]:
            if (own := self.special.get(piece)) is not None:
                out.append(own)
            elif any(c in piece for c in _NO_SPACES):
                out += map(self.of_chunk.__getitem__, re.split(r"[ \n]+", piece))
            else:
                out += map(self.of_chunk.__getitem__, piece.split())
        self.of_word.turn()
        self.of_chunk.turn()
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The tokens of ids with a space between each two, in UTF-8."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Known(dict):
    """Results of ``work`` by text, worked out when first asked for. Those not asked for in a while are forgotten."""

    def __init__(self, work):
        self.work, self.older = work, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.work(text)
        if len(text) <= KEPT_LENGTH:
            self[text] = found
        return found

    def turn(self) -> None:
        if len(self) > MEMORY:
            self.older = dict(self)
            self.clear()


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One per worker process, so that later tasks find what earlier ones have learned."""
    return Codec(path)


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *[len(b) // 4 for b in ids]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))


def _some(column, rows: int = 32):
    for first in range(0, len(column), rows):
        yield first, min(first + rows, len(column))


def _encode(batches, vocabulary: str):
    own = codec(vocabulary)
    for batch in batches:
        for a, b in _some(batch.column(0)):
            texts = batch.column(1).slice(a, b - a).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists([own.encode(t or "") for t in texts])], ["doc_id", "ids"])


def _decode(batches, vocabulary: str):
    own = codec(vocabulary)
    for batch in batches:
        for a, b in _some(batch.column(0)):
            lists = batch.column(1).slice(a, b - a).to_pylist()
            texts = [own.decode(np.array(x or [], "<u4").tobytes()).decode() for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(texts, pa.string())], ["doc_id", "text"])


def _check(batches, vocabulary: str):
    own = codec(vocabulary)
    for batch in batches:
        rows = []
        for text in batch.column(1):
            ids = own.encode(text.as_py() or "")
            rows.append((len(ids) // 4, sha256(ids).hexdigest(), sha256(own.decode(ids)).hexdigest()))
        n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _rows(docs: DataFrame, column: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), column)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and the token ``ids`` of every whole ``text``.

    Defined cases: a null or empty text, or one of white space alone, has no ids; repeated rows give the same ids each; an
    empty table gives no row; only ``doc_id`` and ``text`` are read. A run of characters without any white space is
    held whole: a word of it beyond ``SHORT`` parts takes some 300 bytes of a worker's memory per byte.
    """
    return arrow(_rows(docs, "text"), partial(_encode, vocabulary=vocabulary or public_tokenizers.path(VOCABULARY)), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and the ``text`` of the ``ids`` of every row: its tokens with spaces between, special ones included."""
    return arrow(_rows(encoded, "ids"), partial(_decode, vocabulary=vocabulary or public_tokenizers.path(VOCABULARY)), "doc_id bigint, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Every text encoded and its ids decoded where they are, told by ``n_tokens``, ``ids_sha256`` (little-endian
    unsigned 32-bit integers) and ``decoded_sha256`` (UTF-8). The cases of :func:`encode` hold; nothing is shuffled."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return arrow(_rows(docs, "text"), partial(_check, vocabulary=vocabulary or public_tokenizers.path(VOCABULARY)), schema)
