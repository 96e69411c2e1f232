"""Text quality by the vote of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, held_out, mixed, pieces, prefix_words, text_bytes, word_names, word_spans
from .samples import labelled

# Hashed byte trigrams, latent dimensions, labelled rows kept per class, neighbours that vote.
TERMS = 2048
DIMENSIONS = 64
PER_CLASS = 2000
NEIGHBOURS = 25
SHARPNESS = 8.0
# Shares that describe a text's form, and their weight against all terms together.
SHAPES, GAIN = 6, np.float32(1.0)
MODULUS, REST, THRESHOLD = 4, 2, 0.7


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x terms: how often each hashed trigram of bytes occurs in each text."""
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, TERMS), np.float32)
    wide = data.astype(np.uint32)
    grams = wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))
    terms = ((grams * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    inside = row[:-2] == row[2:]
    flat = (row[:-2] * TERMS + terms)[inside]
    return np.bincount(flat, minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)


def _kinds() -> dict[str, np.ndarray]:
    table = {k: np.zeros(256, bool) for k in ("space", "letter", "upper", "digit", "mark")}
    for c in range(256):
        table["space"][c] = c in b" \t\n\r\x0b\x0c"
        table["upper"][c] = 65 <= c <= 90
        table["letter"][c] = 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
        table["digit"][c] = 48 <= c <= 57
        table["mark"][c] = not (table["space"][c] or table["letter"][c] or table["digit"][c] or c in b".,")
    return table


_KINDS = _kinds()


def shapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x SHAPES: shares, 0 to 1, that tell how a text is made rather than what it says."""
    n = len(offsets) - 1
    out = np.zeros((n, SHAPES), np.float32)
    if not len(data):
        return out
    row = np.repeat(np.arange(n), np.diff(offsets))
    share = lambda of, among: np.divide(of, among, out=np.zeros(n), where=among > 0)
    count = lambda kind: np.bincount(row, _KINDS[kind][data], n)
    letters, size = count("letter"), np.diff(offsets).astype(float)
    own, start, length = word_spans(data, offsets, ~_KINDS["space"])
    names = word_names(prefix_words(data), start, length)
    words = np.bincount(own, minlength=n).astype(float)
    again = np.zeros(len(own), bool)
    again[1:] = (names[1:] == names[:-1]) & (own[1:] == own[:-1])
    # pairs of words seen before in the same text
    pair = names[:-1] + np.uint64(31) * mixed(names[1:])
    same = own[1:] == own[:-1]
    order = np.lexsort((pair[same], own[:-1][same]))
    pr, ow = pair[same][order], own[:-1][same][order]
    old = np.zeros(len(pr), bool)
    old[1:] = (pr[1:] == pr[:-1]) & (ow[1:] == ow[:-1])
    pairs = np.bincount(ow, minlength=n).astype(float)
    out[:, 0] = share(np.bincount(own, again, n), words)
    out[:, 1] = share(np.bincount(ow, old, n), pairs)
    out[:, 2] = share(count("upper"), letters)
    out[:, 3] = np.minimum(1, 4 * share(count("mark"), size))
    out[:, 4] = np.minimum(1, 4 * share(count("digit"), size))
    out[:, 5] = share(np.bincount(own, ~_KINDS["letter"][data[start + length - 1]], n), words)
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x (TERMS + SHAPES)."""
    return np.concatenate((term_counts(data, offsets), shapes(data, offsets)), axis=1)


def _each(batches, column: int, step=features):
    for batch in batches:
        data, offsets = text_bytes(batch.column(column))
        for a, b in pieces(offsets):
            yield batch, a, b, step(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _spread(batches):
    texts, seen = 0, np.zeros(TERMS, np.int64)
    for _, a, b, counts in _each(batches, 0, term_counts):
        texts += b - a
        seen += (counts > 0).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS)), pa.array(np.concatenate(([texts], seen)))], ["term", "n"])


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Texts in all, then texts with each term, over every row of ``docs``; one row per term and task is summed."""
    spread = arrow(docs.select("text"), _spread, "term bigint, n bigint")
    out = np.zeros(TERMS + 1)
    for r in spread.groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term + 1] = r.n
    return out


def _weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted terms of length 1, and the shapes beside them."""
    return np.concatenate((_unit(np.log1p(x[:, :TERMS]) * idf), GAIN * x[:, TERMS:]), axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class Model:
    """Size is bounded: (TERMS + SHAPES) x (DIMENSIONS + 1) and at most 2 x PER_CLASS x (DIMENSIONS + 2) numbers."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    prior: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weigh(counts, self.idf) @ self.basis)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled vectors; the prior where none is near."""
        z = self.latent(counts)
        out = np.full(len(z), self.prior)
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for first in range(0, len(z), 64):
            cosine = z[first : first + 64] @ self.vectors.T
            near = np.argpartition(cosine, -k, axis=1)[:, -k:]
            w = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS * self.weight[near]
            total = w.sum(axis=1)
            share = np.divide((w * self.y[near]).sum(axis=1), total, out=np.full(len(total), self.prior), where=total > 0)
            out[first : first + 64] = share
        return np.clip(out, 0, 1)


def _sampled(batches):
    for batch, a, b, counts in _each(batches, 1):
        rows = [r.tobytes() for r in counts]
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(rows, pa.binary())], ["doc_id", "y", "counts"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Term weights from all documents; basis and voters from at most ``per_class`` labelled rows per class."""
    seen = document_frequencies(docs)
    idf = (np.log((1 + seen[0]) / (1 + seen[1:])) + 1).astype(np.float32)
    chosen, counts = labelled(docs, labels, "quality", MODULUS, REST, per_class)
    rows = arrow(chosen.select("doc_id", "text", "y"), _sampled, "doc_id bigint, y int, counts binary").orderBy("doc_id").collect()
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if not rows:
        return Model(idf, np.zeros((TERMS + SHAPES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), prior)
    y = np.array([r.y for r in rows])
    x = _weigh(np.stack([np.frombuffer(r.counts, np.float32) for r in rows]), idf)
    # the leading right singular vectors, by subspace iteration
    q = np.random.default_rng(7).standard_normal((TERMS + SHAPES, min(DIMENSIONS, len(rows), TERMS))).astype(np.float32)
    for _ in range(8):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    basis = q.astype(np.float32)
    kept = np.bincount(y, minlength=2)
    weight = np.array([counts.get(c, 0) / max(kept[c], 1) for c in (0, 1)])
    return Model(idf, basis, _unit(x @ basis), y.astype(float), weight[y], prior)


def _scored(batches, model):
    for batch, a, b, counts in _each(batches, 1):
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.value.score(counts), pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` for every row of ``docs``.

    Labelled vectors are broadcast (their number is a parameter); every text, whole, is compared with
    all of them in blocks of exact cosine products. Defined cases: null, empty and very short texts
    (under three bytes) get the share of label 1 among learnable labels, 0.5 if there are none; repeated
    rows score alike; equal similarities may be ordered either way; an empty table gives no row. Only
    ``doc_id`` and ``text`` are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = arrow(rows, partial(_scored, model=model), "doc_id bigint, score double")
    return scored.select("doc_id", held_out(MODULUS, REST).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _passing(batches, model, text: int, threshold: float):
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        good = np.concatenate([model.value.score(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in pieces(offsets)] or [np.zeros(0)]) >= threshold
        yield batch.filter(pa.array(good))


def keep(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score reaches ``threshold``; nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))
    step = partial(_passing, model=model, text=docs.columns.index("text"), threshold=threshold)
    return arrow(docs, step, docs.schema)
