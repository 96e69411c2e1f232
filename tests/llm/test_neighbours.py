import numpy as np

from watchtide.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, bucket string, part string, qid string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash", "clash", "clash") for i, v in rows], SCHEMA)


def brute(rows, queries, n=10):
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in sound:
        if q in queries:
            d = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in sound if i != q)
            out[q] = d[:n]
    return out


def test_small_tables_are_exact_and_defined(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.standard_normal(5)) for k in range(8)]
    rows += [(100, None), (200, [0, 0, 0, 0, 0]), (300, [1, None, 0, 0, 0]), (400, [float("nan"), 1, 1, 1, 1]), (500, [float("inf"), 1, 1, 1, 1]), (600, rows[1][1]), (700, rows[1][1])]
    df = frame(spark, rows)
    got = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    want = brute(rows, {0, 100, 200, 300, 400, 500, 600, 700})
    assert set(got) == {0, 600, 700}
    for q, best in want.items():
        assert [(round(s, 9), v) for s, v in (got[q][k] for k in sorted(got[q]))] == [(round(s, 9), v) for s, v in best]
    assert got[600][1] == (0.0, 1)


def test_recall_and_many_copies(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 24))
    rows = [(k, centres[k % 30] + 0.6 * rng.standard_normal(24)) for k in range(1500)]
    rows += [(2000 + k, rows[7][1]) for k in range(400)]
    df = frame(spark, rows)
    got = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, {i for i, _ in rows if i % 100 == 0})
    assert set(got) == set(want)
    hits = [len({v for _, v, _ in got[q]} & {v for _, v in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9 and all(len(g) == 10 for g in got.values())
    # copies: the nearest are the smallest ids of equal vectors
    assert [v for _, v, _ in sorted(got[2300])] == [7, *range(2000, 2009)]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert neighbours.nearest(none, none).collect() == []
    some = frame(spark, [(1, [1.0, 2.0])])
    assert neighbours.nearest(some, some).collect() == []


def test_ids_with_several_vectors_and_without_id(spark):
    import random

    rng = random.Random(7)
    rows = [(k // 2 if k < 40 else k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(120)] + [(None, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours.nearest(frame, frame.filter("vec_id % 5 = 0"), 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    for q in {d for d, _ in rows if d is not None and d % 5 == 0}:
        least = {}
        for a in (v for d, v in rows if d == q):
            for d, b in rows:
                if d is not None and d != q:
                    least[d] = min(least.get(d, 9e9), sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5)
        want = sorted((s, d) for d, s in least.items())[:7]
        have = sorted(got[q])
        assert [k for k, _, _ in have] == list(range(1, 8)) and len({d for _, d, _ in have}) == 7
        assert sum(d in {d for _, d in want} for _, d, _ in have) >= 6
        assert all(abs(s - least[d]) < 1e-6 for _, d, s in have)
