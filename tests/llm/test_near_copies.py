import random

from tests.llm.fixtures import awkward, awkward_texts, empty, sentence, words
from watchtide.llm import near_copies, stages
from watchtide.llm.common import table

SF = "/root/testdata/sf0.01"


def brute_parts(texts):
    """Parts over all pairs of five-word shingle sets with a similarity of 0.8 or more."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if 5 * len(sets[i]) < 4 * len(sets[j]):
                break
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def check(spark, docs, texts):
    parts, least = brute_parts([t for _, t in texts]), {}
    for (d, _), p in zip(texts, parts, strict=True):
        if d is not None:
            least[p] = min(least.get(p, d), d)
    want = sorted((str(d), str(least.get(p))) for (d, _), p in zip(texts, parts, strict=True))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in near_copies.near_copies(docs).collect()) == want
    return want


def changed(rng, text, n):
    w = text.split(" ")
    for k in rng.sample(range(len(w)), n):
        w[k] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_copies_at_the_edge_of_similarity_match_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for _ in range(40):
        base = sentence(rng, rng.randint(60, 400))
        texts.append(base)
        texts += [changed(rng, base, max(1, round(share * len(base.split())))) for share in (0.005, 0.015, 0.02, 0.022, 0.025, 0.04)]
    texts = list(enumerate(texts))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    want = check(spark, docs, texts)
    assert 60 < len({p for _, p in want}) < len(texts)
    monkeypatch.setattr(near_copies, "TILE", 40)
    monkeypatch.setattr(near_copies, "BLOCK", 700)
    check(spark, docs, texts)


def test_awkward_and_empty_tables(spark):
    check(spark, awkward(spark), [(d, t) for d, t, _ in awkward_texts()])
    assert near_copies.near_copies(empty(spark)).collect() == []


def test_stage_drops_the_near_copies_of_a_table(spark):
    docs = table(spark, SF, "documents").filter("doc_id < 1000")
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    parts = brute_parts([t for _, t in texts])
    want = {texts[p][0] for p in set(parts)}
    assert {r.doc_id for r in stages.near_dedup(spark, docs, SF).collect()} == want
