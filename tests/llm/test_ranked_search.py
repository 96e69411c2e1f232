import math
import random
from collections import Counter, defaultdict

import pytest

from tests.llm.fixtures import awkward, empty, plain_words
from watchtide.llm import ranked_search

ITEMS = "item_id bigint, text string, doc_id bigint, score string"


def brute(docs, items, k):
    """All scores of all documents, from the definition."""
    bags = [(d, Counter(plain_words(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    documents, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(plain_words(text))
    out = []
    for item, terms in wanted.items():
        found = []
        for d, b in bags:
            n, score = sum(b.values()), 0
            m = 100 - 50 + (50 * n * documents) // length
            for t in terms & b.keys():
                w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m))
            if score > 0:
                found.append((-score, d is not None, d or 0))
        out += [(str(item), rank, str(d if there else None), -score) for rank, (score, there, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def found(docs, items, k, **more):
    return sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in ranked_search.search(docs, items, k, **more).collect())


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], ITEMS)


AWKWARD = [(1, "ta ri ONE, Äpfel äpfel äPFEL"), (2, None), (3, ""), (4, " .,- "), (5, "nowhere"), (None, "ri mo"), (None, "lo"), (6, "ta"), (6, "ta"), (7, "日本語のテキスト 𝔘 x00"), (8, "momo xyzzy ßuta")]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_awkward_rows_match_brute_force(spark, k):
    docs = awkward(spark)
    assert found(docs, items_of(spark, AWKWARD), k) == brute([(r.doc_id, r.text) for r in docs.collect()], AWKWARD, k)


def test_blocks_rounds_and_ties_match_brute_force(spark, monkeypatch):
    """Many small blocks, several rounds of items, and copies that tie."""
    monkeypatch.setattr(ranked_search, "MERGES", 3)
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(4000)]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 80)))) for k in range(900)]
    docs += [(1000 + k, docs[k % 7][1]) for k in range(300)] + [(5, docs[9][1]), (5, docs[9][1])]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))) for k in range(40)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    want = brute(docs, items, 10)
    assert found(frame, items_of(spark, items), 10) == want
    assert found(frame, items_of(spark, items), 10, pairs=100) == want


def test_accumulators_stop_and_survivors_stay_exact():
    import numpy as np

    rng = random.Random(6)
    n = np.array([rng.randint(20, 60) for _ in range(400)])
    lists = [[(t, rng.randint(1, 4)) for t in range(12) if rng.random() < (t + 1) / 13] for _ in n]
    terms = np.array([t for x in lists for t, _ in x])
    counts = np.array([c for x in lists for _, c in x])
    weights = np.array([4000 // (t * t + 1) for t in range(12)], np.int64)
    block = ranked_search.Block(n, np.array([len(x) for x in lists]), terms, counts, weights, len(n), int(n.sum()))
    exact = np.zeros(len(n), np.int64)
    for t in range(12):
        docs, parts = block.postings(t)
        exact[docs] += parts
    reached = []
    postings = block.postings
    block.postings = lambda t: (reached.append(t), postings(t))[1]
    places, scores = block.best(list(range(12)), 5, 0)
    best = sorted(exact, reverse=True)[:5]
    assert sorted(scores, reverse=True)[:5] == best and all(exact[p] == s for p, s in zip(places, scores, strict=True))
    assert set(np.nonzero(exact >= best[-1])[0]) <= set(places.tolist())
    # above a floor that no document reaches nothing gets an accumulator
    assert len(block.best(list(range(12)), 5, int(exact.max()) + block.bounds.sum())[0]) == 0


def test_no_documents_and_no_items(spark):
    assert found(empty(spark), items_of(spark, AWKWARD), 5) == []
    assert found(awkward(spark), items_of(spark, []), 5) == []
    assert found(awkward(spark), items_of(spark, [(1, "nowhere")]), 5) == []
