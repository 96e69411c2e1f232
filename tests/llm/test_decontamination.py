import random
import re

import numpy as np

from tests.llm.fixtures import awkward, empty, plain_words, sentence
from watchtide.llm import decontamination

ITEMS = "item_id bigint, text string, words string"


def brute(docs, items):
    single = {}
    for i, t in items:
        if t is not None:
            single[t] = i if t not in single else min(i, single[t])
    out = set()
    for d, t in docs:
        a = plain_words(t)
        for text, i in single.items():
            b = plain_words(text)
            span = min(decontamination.SPAN, len(b))
            if span < decontamination.LEAST:
                continue
            best = 0
            for x in range(len(a) - span + 1):
                for y in range(len(b) - span + 1):
                    best = max(best, sum(p == q for p, q in zip(a[x : x + span], b[y : y + span], strict=True)))
            if best >= decontamination.SHARE * span:
                out.add((d, i))
    return out


def test_substitutions_match_brute_force(spark):
    rng = random.Random(2)
    items = [(k, sentence(rng, n)) for k, n in enumerate([4, 5, 7, 9, 12, 13, 14, 30, 50])] + [(20, None), (21, ""), (7, None)]
    items.append((30, items[7][1]))
    docs = []
    for k in range(60):
        words = rng.choice([t for _, t in items if t]).split(" ")
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "zz"
        docs.append((k, sentence(rng, rng.randint(0, 20)) + " " + re.sub("[a-z]", lambda m: m[0].upper(), " ".join(words)) + ", " + sentence(rng, rng.randint(0, 20))))
    docs += [(100, None), (101, ""), (3, docs[3][1]), (102, sentence(rng, 3000))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = decontamination.overlaps(frame, spark.createDataFrame([(i, t, "clash") for i, t in items], ITEMS)).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) > 20
    assert all(r.agree >= decontamination.SHARE and r.words >= decontamination.LEAST for r in rows)


def test_every_two_substitutions_leave_a_seed():
    rng = np.random.default_rng(0)
    names = rng.integers(0, 2**63, decontamination.SPAN, dtype=np.uint64)
    whole = decontamination.window_hashes(names, decontamination.SPAN)[:, 0]
    for i in range(decontamination.SPAN):
        for j in range(i):
            other = names.copy()
            other[[i, j]] = 1, 2
            assert (decontamination.window_hashes(other, decontamination.SPAN)[:, 0] == whole).any()


def test_a_full_table_of_bits_loses_nothing(spark, monkeypatch):
    rng = random.Random(4)
    items = [(k, sentence(rng, 20)) for k in range(5)]
    docs = [(k, sentence(rng, 30) + " " + items[k % 5][1]) for k in range(10)]
    monkeypatch.setattr(decontamination, "MOST_BITS", 1 << 7)
    found = decontamination.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(k, k % 5) for k in range(10)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert decontamination.overlaps(awkward(spark), none).collect() == []
    assert decontamination.overlaps(empty(spark), spark.createDataFrame([(1, "a b c d e f", "x")], ITEMS)).collect() == []


def test_rows_without_ids_stay_apart(spark):
    words = " ".join(f"w{k}" for k in range(15))
    docs = spark.createDataFrame([(None, words), (None, "x " + words), (3, words)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, words)], "item_id bigint, text string")
    rows = decontamination.overlaps(docs, items).collect()
    assert sorted((str(r.doc_id), r.words, r.agree) for r in rows) == [("3", 15, 1.0), ("None", 15, 1.0), ("None", 15, 1.0)]
