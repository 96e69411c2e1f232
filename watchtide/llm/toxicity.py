"""Toxicity by weak supervision: many weak voters, a label model over their votes, a linear classifier."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, first_bytes, held_out, lowered, mixed, pieces, prefix_words, stash, text_bytes, word_names, word_spans
from .samples import labelled

PER_CLASS = 3000
# Features that classifier and lexicons may hold, texts a feature must occur in, and its least log-odds.
VOCABULARY = 4000
SUPPORT = 5
ODDS = 3.0
# Learned lexicons of each kind of feature.
SPLITS = 3
MODULUS, REST, THRESHOLD = 5, 0, 0.5

# A plain lexicon of English insults.
INSULTS = (
    "ass asshole bastard bitch bullshit clown cockroach coward creep cretin crap damn dickhead disgusting dumb dumbass fool freak fuck fucking "
    "garbage hate hideous idiot idiotic ignorant imbecile jerk kill liar loser lunatic moron moronic nasty nazi parasite pathetic pig "
    "psycho racist rat retard scum shit shitty sick slut stupid subhuman sucks trash ugly vermin vile whore worthless"
).split()
KINDS = (3, 4, 5, 6, 7, 8, 0)  # bytes of a prefix; 0: the whole word
_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_SALT = [np.uint64(((k + 1) * 0x9E3779B97F4A7C15) % 2**64) for k in range(len(KINDS))]
# Names of the pattern features: mostly capitals, rows of exclamation marks, rows of other marks.
PATTERNS = np.arange(1, 4, dtype=np.uint64)


def _names(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, kind: int) -> np.ndarray:
    packed = prefix_words(data)
    size = KINDS[kind]
    if size:
        return mixed(first_bytes(packed[starts], np.minimum(lengths, size)) ^ _SALT[kind])
    return mixed(word_names(packed, starts, lengths) ^ _SALT[kind])


def word_features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature name) pairs of each text: prefixes and words, lower-cased, and patterns.

    With ``wanted``, sorted names, only those are kept; a small table of their low bits sorts out most
    others first.
    """
    n = len(offsets) - 1
    rows, names = [], []
    if wanted is not None:
        likely = np.zeros(1 << 16, bool)
        likely[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
    low = lowered(data)
    row, starts, lengths = word_spans(low, offsets, _LETTER)
    for kind, size in enumerate(KINDS):
        long_enough = lengths >= max(size, 3)
        r, name = row[long_enough], _names(low, starts[long_enough], lengths[long_enough], kind)
        if wanted is not None:
            keep = likely[(name & np.uint64(0xFFFF)).astype(np.int64)]
            r, name = r[keep], name[keep]
        rows.append(r)
        names.append(name)
    if len(data):
        at = np.repeat(np.arange(n), np.diff(offsets))
        letters, capitals = np.bincount(at, _LETTER[data], n), np.bincount(at, _UPPER[data], n)
        double = lambda c: np.bincount(at[1:], (data[1:] == c) & (data[:-1] == c) & (at[1:] == at[:-1]), n)
        for k, on in enumerate((capitals > 0.5 * np.maximum(letters, 20), double(33) > 2, double(42) + double(37) + double(36) > 2)):
            rows.append(np.nonzero(on)[0])
            names.append(np.full(int(on.sum()), PATTERNS[k]))
    row, name = np.concatenate(rows), np.concatenate(names)
    if wanted is not None:
        spot = np.minimum(np.searchsorted(wanted, name), max(len(wanted) - 1, 0))
        keep = wanted[spot] == name if len(wanted) else np.zeros(len(name), bool)
        row, name = row[keep], name[keep]
    if not len(row):
        return row, name
    order = np.lexsort((name, row))
    row, name = row[order], name[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (name[1:] != name[:-1])))
    return row[new], name[new]


def lexicon_names() -> np.ndarray:
    data = np.frombuffer(" ".join(INSULTS).encode(), np.uint8)
    row, starts, lengths = word_spans(data, np.array([0, len(data)]), _LETTER)
    return np.unique(_names(data, starts, lengths, len(KINDS) - 1))


def _sampled(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        ids, ys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for a, b in pieces(offsets):
            row, name = word_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for s in range(0, len(row), 1 << 15):
                e = slice(s, s + (1 << 15))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + row[e]]), pa.array(ys[a + row[e]]), pa.array(name[e].view(np.int64))], ["doc_id", "y", "name"])


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the positive class per row, and the weight of each voter.

    ``votes`` holds 1 and 0. Each voter's accuracy on either class is estimated by expectation
    maximization, first as if voters were independent. Voters that still agree once that class is accounted
    for then share their weight, by the correlation of their residuals beyond what chance makes of as many
    rows, and the estimate goes on.
    """
    q = np.clip(start.astype(float), 0.05, 0.95)
    weight = np.ones(votes.shape[1])
    for k in range(rounds):
        total = q.sum(), (1 - q).sum()
        hit = (q @ votes + 1) / (total[0] + 2)
        false = ((1 - q) @ votes + 1) / (total[1] + 2)
        if k == rounds // 2:
            residual = votes - (q[:, None] * hit + (1 - q)[:, None] * false)
            spread = residual.std(axis=0) + 1e-9
            alike = np.abs((residual / spread).T @ (residual / spread)) / max(len(votes), 1)
            chance = 3 / np.sqrt(max(len(votes), 1))
            weight = 1 / (1 + np.maximum(alike - chance, 0).sum(axis=1) - np.maximum(np.diag(alike) - chance, 0))
        gain = np.log(hit / false), np.log((1 - hit) / (1 - false))
        prior = (total[0] + 1) / (len(q) + 2)
        logit = np.log(prior / (1 - prior)) + votes @ (weight * gain[0]) + (1 - votes) @ (weight * gain[1])
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q, weight


@dataclass
class Model:
    """At most VOCABULARY names with a weight each, and the weights of the patterns and the lexicon."""

    names: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, name = word_features(data, offsets, self.names)
        sums = np.bincount(row, self.weights[np.searchsorted(self.names, name)] if len(name) else None, len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled ids per class; equal texts count once."""
    chosen, counts = labelled(docs, labels, "toxic", MODULUS, REST, per_class)
    texts = chosen.withColumn("digest", F.xxhash64("text")).dropDuplicates(["digest"]).select("doc_id", "text", "y")
    found = stash(arrow(texts, _sampled, "doc_id bigint, y int, name bigint"), "features")
    held = found.groupBy("y").agg(F.count_distinct("doc_id").alias("n")).collect()
    n = {r.y: r.n for r in held}
    fixed = lexicon_names()
    keep = found.sparkSession.createDataFrame([(int(x),) for x in np.concatenate((fixed, PATTERNS)).view(np.int64)], "name bigint")
    odds = F.log((F.col("n1") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("n0") + 0.5) / (n.get(0, 0) + 1))
    told = found.groupBy("name").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).withColumn("odds", odds)
    strong = told.filter((F.col("n1") >= SUPPORT) & (F.col("odds") >= ODDS)).orderBy(F.desc(F.col("odds") * F.sqrt("n1")), "name").limit(VOCABULARY)
    names = stash(strong.select("name").unionByName(keep).distinct(), "names")
    rows = found.join(names, "name").groupBy("doc_id").agg(F.first("y").alias("y"), F.collect_list("name").alias("names"))
    empty = found.select("doc_id", "y").distinct().join(rows.select("doc_id"), "doc_id", "left_anti").withColumn("names", F.array().cast("array<bigint>"))
    sample = rows.unionByName(empty).orderBy("doc_id").collect()
    known = np.unique(np.array([r.name for r in names.collect()], np.int64).view(np.uint64))
    if not sample or len({r.y for r in sample}) < 2:
        share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        return Model(known, np.zeros(len(known)), float(np.log((share + 1e-3) / (1 - share + 1e-3))))

    y = np.array([r.y for r in sample], float)
    sizes = [len(r.names) for r in sample]
    doc = np.repeat(np.arange(len(sample)), sizes)
    spot = np.searchsorted(known, np.array([x for r in sample for x in r.names], np.int64).view(np.uint64))
    lexical = np.isin(known, fixed)
    pattern = np.isin(known, PATTERNS)
    learned = ~lexical & ~pattern
    # voters: the plain lexicon, each pattern, learned lexicons by slices of the names, and the label given
    groups = [lexical[spot]] + [known[spot] == p for p in PATTERNS]
    groups += [learned[spot] & (known[spot] % np.uint64(SPLITS * len(KINDS)) == np.uint64(k)) for k in range(SPLITS * len(KINDS))]
    votes = np.stack([np.bincount(doc, g, len(sample)) > 0 for g in groups] + [y > 0.5], axis=1).astype(float)
    posterior, _ = label_model(votes, y)

    # logistic regression on the posterior labels, rows weighted to the shares of all labelled rows
    kept = np.bincount(y.astype(int), minlength=2)
    share = np.array([counts.get(c, 0) / max(kept[c], 1) for c in (0, 1)])[y.astype(int)]
    share = share / share.mean()
    w, bias = np.zeros(len(known)), 0.0
    step, momentum, mb = np.zeros(len(known)), 0.9, 0.0
    for _ in range(800):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[spot], len(sample)) + bias, -30, 30)))
        error = share * (p - posterior) / len(sample)
        step = momentum * step - 2.0 * (np.bincount(spot, error[doc], len(known)) + 2e-5 * w)
        mb = momentum * mb - 2.0 * error.sum()
        w, bias = np.maximum(w + step, 0), bias + mb
    # words of the lexicon that the sample lacks count like those it has
    seen = np.bincount(spot, minlength=len(known)) > 0
    if (lexical & seen).any():
        w[lexical & ~seen] = w[lexical & seen].mean()
    return Model(known, w, float(bias))


def _scored(batches, model):
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for a, b in pieces(offsets):
            scores = model.value.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores, pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` for every row of ``docs``.

    Every text is read whole; weights are positive, so a long text cannot hide what it holds. Defined
    cases: null, empty and wordless texts get the score of a text without any known feature; repeated rows
    score alike; without labels of both classes every text gets the labelled share; an empty table gives
    no row. Only ``doc_id`` and ``text`` are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = arrow(rows, partial(_scored, model=model), "doc_id bigint, score double")
    return scored.select("doc_id", held_out(MODULUS, REST).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
