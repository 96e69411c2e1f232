"""Sampled segmentations over the piece lattice of a SentencePiece vocabulary, and lossless decoding.

The probability of a segmentation is the product of its pieces' weights. Weights are summed forwards over
the lattice, and pieces are then drawn backwards from the end, each in proportion to what leads up to it.
The draws come from a hash of the row's key, the place and the seed, so a row gives the same pieces
wherever and whenever it is encoded.

A text is cut between two characters that no piece holds next to each other, so its lattice is that of the
units in a row; a unit's sums are kept while it recurs.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache, partial
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, mixed

VOCABULARY = "piece_bpe_32k.model"
# Weights are the pieces' probabilities to this power; lower is more varied.
ALPHA = 1.0
# Lattice positions that a worker keeps before it starts anew; every core has a worker.
MEMORY = 500_000
_ONE = 1 << 32
# Characters of a unit that is summed together with others.
_SHORT = 32
_TURN = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """Forward sums of units, as arrays over lattice positions.

    Edges are the pieces that end at a position, the longest first; those of position k start at
    ``first[k]``. ``upto`` is the cumulative probability of a position's edges, as 32 bits, and ``back`` the
    position that the piece starts from, -1 at the start of a unit.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary: dict[str, tuple[int, float]] = {}
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        # a piece's probability falls with its rank, which is all that a merge vocabulary tells
        total = sum(1 / (r + 3) for r in range(model.get_piece_size()))
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes.append(b"")
            else:
                text = piece.replace("\u2581", " ")
                self.bytes.append(text.encode())
                rank = min(-model.get_score(i), model.get_piece_size())  # a lone space has no rank of its own
                self.vocabulary[text] = (i, -alpha * math.log((rank + 3) * total))
        self.longest = max(map(len, self.vocabulary), default=1)
        # neighbours within a piece, as numbers; the last one is larger than all
        self.inside = np.array(sorted({ord(x) << 21 | ord(y) for t in self.vocabulary for x, y in pairwise(t)} | {1 << 62}), np.int64)
        self.by_length = {}
        for size in range(1, self.longest + 1):
            some = [(t, *v) for t, v in self.vocabulary.items() if len(t) == size]
            names = np.zeros(len(some), np.uint64)
            for k in range(size):
                names = names * _TURN + mixed(np.array([ord(t[0][k]) + 1 for t in some], np.uint64))
            order = np.argsort(names)
            likely = np.zeros(1 << 16, bool)
            likely[(names >> np.uint64(48)).astype(np.int64)] = True
            self.by_length[size] = names[order], np.array([t[1] for t in some], np.int32)[order], np.array([t[2] for t in some])[order], likely
        self.clear()

    def clear(self) -> None:
        self.ends: dict[str, int] = {}
        self.n, self.m = 0, 0
        self.upto, self.first = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int32)
        self.piece, self.back = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def add(self, units: list[str]) -> None:
        """Forward sums of new units: short ones together, by length; others one by one."""
        plain = [u for u in units if len(u) <= _SHORT and self.spelled(u)]
        if plain:
            self._add_short(plain)
        known = set(plain)
        self._add_others([u for u in units if u not in known])

    def spelled(self, unit: str) -> bool:
        return all(map(self.vocabulary.__contains__, unit))

    def _add_short(self, units: list[str]) -> None:
        """A position per character; edges are found by hashing every substring of every length."""
        lengths = np.array([len(u) for u in units])
        stops = np.cumsum(lengths)
        starts = stops - lengths
        codes = mixed(np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1))
        begin, end = np.repeat(starts, lengths), np.repeat(stops, lengths)
        place = np.arange(len(codes))
        name = np.zeros(len(codes), np.uint64)
        found = []
        for size, (names, ids, weights, likely) in self.by_length.items():
            name = name[: len(codes) - size + 1] * _TURN + codes[size - 1 :]
            hit = np.nonzero(likely[(name >> np.uint64(48)).astype(np.int64)])[0]
            spot = np.minimum(np.searchsorted(names, name[hit]), len(names) - 1)
            own = (names[spot] == name[hit]) & (hit + size <= end[hit])
            hit, spot = hit[own], spot[own]
            found.append((hit, hit + size - 1, ids[spot], weights[spot]))
        start, stop, ids, weights = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort((stop << 6) + (start - stop + 63))
        start, stop, ids, weights = start[order], stop[order], ids[order], weights[order]
        back = np.where(start > begin[start], start - 1, -1)
        sums = np.zeros(len(codes) + 1)  # the last stands for the start of a unit
        depth = (place - begin)[stop]
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2))
        score = np.zeros(len(start))
        for d in range(len(cuts) - 1):
            e = by_depth[cuts[d] : cuts[d + 1]]
            score[e] = sums[back[e]] + weights[e]
            firsts = np.nonzero(np.concatenate(([True], stop[e][1:] != stop[e][:-1])))[0]
            sums[stop[e][firsts]] = np.logaddexp.reduceat(score[e], firsts)
        share = (np.exp(score - sums[stop]) * _ONE).astype(np.int64)
        last = np.concatenate((stop[1:] != stop[:-1], [True]))
        firsts = np.concatenate(([0], np.nonzero(last)[0][:-1] + 1))
        upto = np.cumsum(share)
        upto -= np.repeat((upto - share)[firsts], np.diff(np.concatenate((firsts, [len(stop)]))))
        low = np.where(last, _ONE - 1, np.minimum(upto, _ONE - 1))
        n, m = self.n, self.m
        self.upto = self._grown(self.upto, m, low)
        self.first = self._grown(self.first, n, m + firsts)
        self.piece = self._grown(self.piece, m, ids)
        self.back = self._grown(self.back, m, np.where(back >= 0, n + back, -1))
        self.ends.update(zip(units, (n + stops - 1).tolist(), strict=True))
        self.n, self.m = n + len(codes), m + len(stop)

    def _add_others(self, units: list[str]) -> None:
        vocabulary, longest = self.vocabulary, self.longest
        first, low, piece, back = [], [], [], []
        n, m = self.n, self.m
        for unit in units:
            chars = len(unit)
            sums = [0.0] * (chars + 1)
            node = [-1] * (chars + 1)
            for end in range(1, chars + 1):
                edges = []
                for start in range(max(0, end - longest), end):
                    if (hit := vocabulary.get(unit[start:end])) is not None:
                        edges.append((hit[0], sums[start] + hit[1], node[start]))
                if unit[end - 1] not in vocabulary:
                    # a character that no piece spells: its bytes, one after another
                    raw = unit[end - 1].encode()
                    below = node[end - 1]
                    for b in raw[:-1]:
                        first.append(m + len(low))
                        low.append(_ONE - 1)
                        piece.append(self.byte_ids[b])
                        back.append(below)
                        below = n
                        n += 1
                    edges.append((self.byte_ids[raw[-1]], sums[end - 1] - 20.0 * len(raw), below))
                top = max(e[1] for e in edges)
                total = sum(math.exp(e[1] - top) for e in edges)
                sums[end] = top + math.log(total)
                node[end] = n
                first.append(m + len(low))
                upto = 0.0
                for k, (i, s, b) in enumerate(edges):
                    upto += math.exp(s - top) / total
                    low.append(min(int(upto * _ONE), _ONE - 1) if k + 1 < len(edges) else _ONE - 1)
                    piece.append(i)
                    back.append(b)
                n += 1
            self.ends[unit] = node[chars]
        self.upto, self.piece, self.back = (self._grown(a, m, x) for a, x in ((self.upto, low), (self.piece, piece), (self.back, back)))
        self.first = self._grown(self.first, self.n, first)
        self.n, self.m = n, m + len(low)

    @staticmethod
    def _grown(held: np.ndarray, used: int, new) -> np.ndarray:
        if used + len(new) > len(held):
            held = np.concatenate((held[:used], np.zeros(max(len(new), len(held)), held.dtype)))
        held[used : used + len(new)] = new
        return held

    def units(self, texts: list[str]) -> list[list[str]]:
        """Every text, with the space that it starts with, cut wherever no piece spans; an empty text has no unit."""
        full = [" " + t if t else "" for t in texts]
        codes = np.frombuffer("".join(full).encode("utf-32-le"), "<u4").astype(np.int64)
        pairs = codes[:-1] << 21 | codes[1:]
        cuts = np.nonzero(self.inside[np.searchsorted(self.inside, pairs)] != pairs)[0] + 1
        out, first = [], 0
        for t in full:
            low, high = np.searchsorted(cuts, (first + 1, first + len(t)))
            edges = [0, *(cuts[low:high] - first).tolist(), len(t)]
            out.append([t[a:b] for a, b in pairwise(edges)] if t else [])
            first += len(t)
        return out

    def sample(self, texts: list[str], keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts in a row, n + 1 offsets). A text starts with a space of its own; an empty
        text has no pieces."""
        if self.n > MEMORY:
            self.clear()
        units = self.units(texts)
        flat = [u for us in units for u in us]
        if new := set(flat) - self.ends.keys():
            self.add(sorted(new))
        sizes = np.array([len(us) for us in units], np.int64)
        at = np.array(list(map(self.ends.__getitem__, flat)), np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        draw = mixed(keys[text] ^ mixed(place.astype(np.uint64) + np.uint64(seed % 2**63 + 1) * np.uint64(0x9E3779B9)))
        live, step, drawn = np.arange(len(at)), 0, []
        count = np.zeros(len(at), np.int64)
        while len(live):
            u = (mixed(draw[live] + np.uint64(step)) >> np.uint64(32)).astype(np.uint32)
            edge = self.first[at]
            over = np.nonzero(self.upto[edge] < u)[0]
            while len(over):
                edge[over] += 1
                over = over[self.upto[edge[over]] < u[over]]
            drawn.append((live, self.piece[edge]))
            count[live] += 1
            at = self.back[edge].astype(np.int64)
            more = at >= 0
            live, at, step = live[more], at[more], step + 1
        stop = np.cumsum(count)
        out = np.zeros(int(stop[-1]) if len(stop) else 0, np.int32)
        for k, (who, ids) in enumerate(drawn):
            out[stop[who] - 1 - k] = ids
        lengths = np.bincount(text, count, len(texts)).astype(np.int64)
        return out, np.concatenate(([0], np.cumsum(lengths)))

    def decode(self, ids: np.ndarray) -> str:
        """The text that the pieces spell, without the space that every text starts with."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))[1:].decode()


@lru_cache(maxsize=1)
def _lattice(path: str, alpha: float) -> Lattice:
    """One per worker process, so that later tasks find what earlier ones have summed."""
    return Lattice(path, alpha)


def _encoded(batches, path: str, alpha: float, seed: int, check: bool):
    lattice = _lattice(path, alpha)
    for batch in batches:
        ids = batch.column(0)
        keys = mixed(np.array([0 if i is None else i + 1 for i in ids.to_pylist()], np.int64).view(np.uint64))
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for a in range(0, len(texts), 64):
            some = texts[a : a + 64]
            found, offsets = lattice.sample(some, keys[a : a + 64], seed)
            columns = [ids.slice(a, 64)]
            if check:
                parts = [found[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns += [
                    pa.array([len(p) for p in parts], pa.int64()), pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                    pa.array([lattice.decode(p) == t for p, t in zip(parts, some, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids_crc32", "lossless"])
            else:
                columns.append(pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(found)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "pieces"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def encode(docs: DataFrame, seed: int = 1, alpha: float = ALPHA, vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and ``pieces``, a sampled segmentation of every whole text.

    Texts are taken as they are, without normalization, so decoding gives back every character; a
    character that no piece spells becomes its UTF-8 bytes. Defined cases: null and empty texts have no
    pieces; rows are keyed by id (null ids share a key), so repeated rows get the same pieces; an empty
    table gives no row. Only ``doc_id`` and ``text`` are read.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    return arrow(_rows(docs), partial(_encoded, path=path, alpha=alpha, seed=seed, check=False), "doc_id bigint, pieces array<int>")


def encode_checked(docs: DataFrame, seed: int = 1, alpha: float = ALPHA, vocabulary: str | None = None) -> DataFrame:
    """Encode as :func:`encode` does, decode again, and report per row the number of pieces, the CRC-32 of
    their ids as little-endian unsigned 32-bit integers, and whether the text came back whole."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    step = partial(_encoded, path=path, alpha=alpha, seed=seed, check=True)
    return arrow(_rows(docs), step, "doc_id bigint, n_pieces bigint, ids_crc32 bigint, lossless boolean")


def _decoded(batches, path: str):
    lattice = _lattice(path, ALPHA)
    for batch in batches:
        texts = [lattice.decode(np.array(p or [], np.int32)) for p in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``pieces``; null pieces are an empty text."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    return arrow(encoded.select("doc_id", "pieces"), partial(_decoded, path=path), "doc_id bigint, text string")
