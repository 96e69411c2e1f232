import numpy as np
import xxhash

from tests.llm.fixtures import awkward, awkward_texts, empty, words
from watchtide.llm import graph, simhash


def brute_print(text, size):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def check(spark, docs, texts, radius, size):
    rows = simhash.near_duplicates(docs, radius, size).collect()
    prints = [brute_print(t, size) for _, t in texts]
    parts = brute_components(prints, radius)
    least = {}
    for (d, _), p in zip(texts, parts, strict=True):
        if d is not None:
            least[p] = min(least.get(p, d), d)
    want = sorted((str(d), f"{x:016x}", str(least.get(p))) for (d, _), x, p in zip(texts, prints, parts, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == want


def test_awkward_texts_match_brute_force(spark):
    texts = [(d, t) for d, t, _ in awkward_texts()]
    check(spark, awkward(spark), texts, 4, 4)


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []


def test_links_in_small_tiles_match_all_pairs(spark):
    rng = np.random.default_rng(0)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = {int(s) for s in seeds}
    for s in seeds:  # chains of close fingerprints
        x = int(s)
        for _ in range(12):
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in prints]
    want = brute_components(prints, 4)
    for tile in (3, 1 << 16):
        edges = simhash.links(spark.createDataFrame(signed, "print bigint"), 4, tile)
        got = {r.node: r.root for r in graph.components(edges).collect()}
        groups = {}
        for (x,), part in zip(signed, want, strict=True):
            groups.setdefault(part, set()).add(got.get(x, x))
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set.union(*groups.values()))


def test_sub_tiles_agree_with_direct_comparison(monkeypatch):
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 600, dtype=np.uint64)
    prints[300:] = prints[:300] ^ (np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64))
    found = []
    for direct in (1 << 30, 64):
        monkeypatch.setattr(simhash, "_DIRECT", direct)
        pairs = set()
        simhash._near(np.arange(600), np.arange(600), prints, 4, 0, lambda a, b: pairs.update(zip(a.tolist(), b.tolist(), strict=True)))
        found.append(pairs)
    assert found[0] == found[1] and len(found[0]) >= 1200


def test_long_chain_is_one_part(spark):
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in graph.components(edges).collect()} == {0}
