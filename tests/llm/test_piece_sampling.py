import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tests.llm.fixtures import awkward, awkward_texts, empty
from watchtide.llm import piece_sampling

PATH = public_tokenizers.path(piece_sampling.VOCABULARY)


@pytest.fixture(scope="module")
def lattice():
    return piece_sampling.Lattice(PATH, 1.0)


def segmentations(vocabulary, text):
    if not text:
        return [((), 0.0)]
    out = []
    for end in range(1, len(text) + 1):
        if text[:end] in vocabulary:
            i, w = vocabulary[text[:end]]
            out += [((i, *rest), w + more) for rest, more in segmentations(vocabulary, text[end:])]
    return out


@pytest.mark.parametrize("word", ["being", "Teré"])
def test_draws_follow_the_product_of_weights(word, monkeypatch):
    flat = piece_sampling.Lattice(PATH, 0.3)
    all_of = {s: math.exp(w) for s, w in segmentations(flat.vocabulary, " " + word)}
    total, n = sum(all_of.values()), 30_000
    ids, offsets = flat.sample([word] * n, piece_sampling.mixed(np.arange(n).astype(np.uint64)), 3)
    drawn = Counter(tuple(ids[offsets[i] : offsets[i + 1]].tolist()) for i in range(n))
    assert set(drawn) <= set(all_of)
    for s, w in all_of.items():
        share = w / total
        assert abs(drawn[s] / n - share) < 5 * math.sqrt(share / n) + 1e-4


@pytest.mark.parametrize("text", ["a\n   b", "so.\u201d I", "a);\r\n", "    x", "b\u00bb, c"])
def test_draws_cover_the_whole_lattice_of_the_vocabulary(text):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    flat = piece_sampling.Lattice(PATH, 0.2)
    plain = {model.id_to_piece(i).replace("\u2581", " ") for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    assert plain == set(flat.vocabulary)
    spelled = dict(flat.vocabulary)
    for c in set(" " + text) - plain:
        assert len(c.encode()) == 1
        spelled[c] = (flat.byte_ids[ord(c)], -20.0)
    all_of = {s: math.exp(w) for s, w in segmentations(spelled, " " + text)}
    total, n = sum(all_of.values()), 30_000
    ids, offsets = flat.sample([text] * n, piece_sampling.mixed(np.arange(n).astype(np.uint64)), 3)
    drawn = Counter(tuple(ids[offsets[i] : offsets[i + 1]].tolist()) for i in range(n))
    assert set(drawn) <= set(all_of)
    for s, w in all_of.items():
        share = w / total
        assert abs(drawn[s] / n - share) < 5 * math.sqrt(share / n) + 2e-4
    assert flat.decode(ids[offsets[0] : offsets[1]]) == text


def test_both_ways_to_sum_agree(lattice):
    words = [" being", "Teré", " two", "."]
    slow = piece_sampling.Lattice(PATH, 1.0)
    slow._add_others(words)
    lattice.clear()
    lattice._add_short(words)
    for w in words:
        for a in (lattice, slow):
            assert w in a.ends
        at, to = lattice.ends[w], slow.ends[w]
        for a, k in ((lattice, at), (slow, to)):
            assert a.back[a.first[k]] >= -1
    assert np.abs(lattice.upto[: lattice.m].astype(float) - slow.upto[: slow.m]).max() < 8
    assert lattice.piece[: lattice.m].tolist() == slow.piece[: slow.m].tolist()


def test_whole_texts_come_back(spark, lattice):
    rows = piece_sampling.encode_checked(awkward(spark)).collect()
    assert len(rows) == len(awkward_texts()) and all(r.lossless for r in rows)
    encoded = piece_sampling.encode(awkward(spark))
    decoded = piece_sampling.decode(encoded).collect()
    assert sorted((str(r.doc_id), r.text) for r in decoded) == sorted((str(d), t or "") for d, t, _ in awkward_texts())


def test_rows_are_reproducible_whatever_the_partitioning(spark):
    docs = awkward(spark)
    pieces = lambda df, seed: sorted((str(r.doc_id), r.pieces) for r in piece_sampling.encode(df, seed).collect())
    first = pieces(docs, 1)
    assert first == pieces(docs.repartition(7), 1)
    assert first != pieces(docs, 2)


def test_empty_table(spark):
    assert piece_sampling.encode(empty(spark)).collect() == []


def test_memory_of_a_worker_is_bounded():
    import random

    rng = random.Random(7)
    worker, most = piece_sampling.Lattice(PATH, 1.0), 0
    for _ in range(9):
        texts = [" ".join("".join(rng.choices("etaoinsrhl", k=9)) for _ in range(700)) for _ in range(16)]
        worker.sample(texts, np.arange(16, dtype=np.uint64), 1)
        most = max(most, sum(a.nbytes for a in (worker.upto, worker.first, worker.piece, worker.back)))
    assert worker.n < 9 * 16 * 700 * 9 and most < 40e6
