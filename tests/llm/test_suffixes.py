import hashlib
import random
from collections import Counter

import pytest

from tests.llm.fixtures import awkward, awkward_texts, empty
from watchtide.llm import suffixes


def brute(texts, window):
    blobs = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in blobs for i in range(len(b) - window + 1))
    out = []
    for b in blobs:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, docs, texts, window=200):
    rows = suffixes.remove_repeats(docs, window, digest=True).collect()
    want = sorted((str(d), *x) for (d, _), x in zip(texts, brute([t for _, t in texts], window), strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want


def test_awkward_texts_match_brute_force(spark):
    check(spark, awkward(spark), [(d, t) for d, t, _ in awkward_texts()])


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps_match_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(150, 420))) for _ in range(6)]
    texts = []
    for k in range(40):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) // 2)
            parts.append(p[a : a + rng.randint(50, 400)] * rng.choice([1, 1, 1, 3]))
            parts.append("".join(rng.choice("xyz") for _ in range(rng.randint(0, 30))))
        texts.append((k, "".join(parts)))
    check(spark, spark.createDataFrame(texts, "doc_id bigint, text string"), texts)


def test_cut_keeps_all_columns_and_whole_characters(spark):
    docs = awkward(spark)
    cut = suffixes.cut_repeats(docs)
    assert cut.columns == docs.columns
    rows = cut.collect()
    assert len(rows) == docs.count() and all(r.core == "clash" for r in rows)
    assert {r.text for r in rows if r.doc_id == 2} == {""} and {r.text for r in rows if r.doc_id == 4} == {""}
    assert all("�" not in r.text for r in rows)


def test_empty_table(spark):
    assert suffixes.remove_repeats(empty(spark), digest=True).collect() == []
    assert suffixes.cut_repeats(empty(spark)).collect() == []
