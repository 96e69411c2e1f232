import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, awkward, empty
from watchtide.llm import merkle


def digest(text):
    return sha256(text.encode()).hexdigest()


def record(r, lower=False):
    text = r["text"]
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def climb(nodes, paths):
    """The root of a list of nodes; every node's siblings go to its path as (before, after)."""
    under = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = range(0, len(nodes), 16)
        for a in runs:
            run = nodes[a : a + 16]
            for j in range(len(run)):
                for k in under[a + j]:
                    paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
        under = [[k for some in under[a : a + 16] for k in some] for a in runs]
        nodes = [digest("".join(nodes[a : a + 16])) for a in runs]
    return nodes[0]


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, own = [], {}
    for s in order:
        docs = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, digest(record(r))))
        paths = [[] for _ in docs]
        subroots.append(climb([digest(record(r)) for r in docs], paths))
        own[s] = docs, paths
    tops = [[] for _ in order]
    root = climb(subroots, tops)
    out = []
    for s, subroot, top in zip(order, subroots, tops, strict=True):
        for r, path in zip(*own[s], strict=True):
            leaf, whole = digest(record(r)), path + top
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            folded = digest(record(r, lower=True)) if tampered else leaf
            for before, after in whole:
                folded = digest(before + folded + after)
            out.append((str(r["doc_id"]), leaf, subroot, root, digest("".join(a + b for a, b in whole)), folded, folded == root))
    return sorted(out)


def found(docs):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.audit(docs).collect())


def test_awkward_rows_match_brute_force(spark):
    docs = awkward(spark).withColumn("text", F.initcap("text"))
    want = brute([r.asDict() for r in docs.collect()])
    assert found(docs) == want
    assert {v for *_, v in want} == {True, False}


@pytest.mark.parametrize("slices", [7, 100_000])
def test_deep_trees_and_many_sources_match_brute_force(spark, monkeypatch, slices):
    """Sources of one row and of thousands, more sources than a run holds, ranges and salts at work."""
    monkeypatch.setattr(merkle, "SLICE_ROWS", max(slices, 400 if slices < 100 else slices))
    monkeypatch.setattr(merkle, "MEETING", 3)
    rng = random.Random(4)
    rows = []
    for k in range(5300):
        source = "hot" if k < 4400 else rng.choice([None, "", "ä", "z", *[f"s{i}" for i in range(300)]])
        rows.append((rng.randrange(-3000, 10**7), f"Text {k}", "en", source, k, *[None] * 14))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).repartition(9)
    assert found(docs) == brute([r.asDict() for r in docs.collect()])


def test_one_source_one_row_and_no_rows(spark):
    docs = awkward(spark)
    same = docs.selectExpr("doc_id", "text", "lang", "'x' AS source", "n_chars")
    assert found(same) == brute([r.asDict() for r in same.collect()])
    one = docs.filter("doc_id = 7").select("doc_id", "text", "lang", "source", "n_chars")
    (row,) = merkle.audit(one).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == digest("")
    assert merkle.audit(empty(spark)).collect() == []


def test_any_change_breaks_the_proof(spark):
    manifest = merkle.build(awkward(spark))
    paths = merkle.proofs(manifest)
    assert {r[0] for r in paths.select(merkle.fold(F.col("leaf"), F.col("path"))).collect()} == {manifest.root}
    wrong = paths.select(merkle.fold(merkle.digest(F.concat("leaf", F.lit("x"))), F.col("path"))).collect()
    assert manifest.root not in {r[0] for r in wrong}
