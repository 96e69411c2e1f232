import zlib

import numpy as np
import pytest

from tests.llm.fixtures import awkward, awkward_texts, empty
from watchtide.llm import quality, toxicity
from watchtide.llm.common import table
from watchtide.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LABELS = "doc_id bigint, quality int, toxic int"


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


@pytest.mark.parametrize(("name", "column", "modulus", "rest", "least"), [("op8_quality", "quality", 4, 2, 0.9), ("op9_toxicity", "toxic", 5, 0, 0.75)])
def test_held_out_rows_are_ranked_well(spark, name, column, modulus, rest, least):
    labels = {r.doc_id: r[column] for r in table(spark, SF, "labels").collect()}
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) and 0 <= r.score <= 1
    out = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert auc(np.array([s for s, _ in out]), np.array([y for _, y in out])) >= least


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) quality", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) toxic")
    for module in (quality, toxicity):
        a, b = ({r.doc_id: r.score for r in module.score(docs, x).collect()} for x in (labels, flipped))
        assert a == b


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward_rows_get_a_score(spark, module):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (5, 0, 1), (7, 0, 1), (9, None, None), (None, 1, 1), (11, 1, 0), (13, 0, 1), (999, 1, 1), (1, 1, 0)], LABELS)
    rows = module.score(awkward(spark), labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _, _ in awkward_texts())
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    blank = {r.score for r in rows if r.doc_id in (4, 5)}
    assert len(blank) == 1
    assert len({r.score for r in rows if r.doc_id == 2}) == 1


@pytest.mark.parametrize("module", [quality, toxicity])
def test_no_labels_and_no_rows(spark, module):
    none = spark.createDataFrame([], LABELS)
    assert {round(r.score, 6) for r in module.score(awkward(spark), none).collect()} == {0.5}
    assert module.score(empty(spark), none).collect() == []


def test_kept_rows_are_those_that_pass(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    passed = {r.doc_id for r in quality.score(docs, labels).filter("predicted = 1").collect()}
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == passed


def test_label_model_finds_accurate_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    good = np.stack([np.where(rng.random(4000) < 0.9, y, ~y) for _ in range(4)], axis=1)
    poor = np.stack([rng.random(4000) < 0.5 for _ in range(3)], axis=1)
    twins = np.repeat(poor[:, :1], 6, axis=1)
    votes = np.concatenate((good, poor, twins), axis=1).astype(float)
    posterior, weight = toxicity.label_model(votes, good.mean(axis=1))
    assert ((posterior > 0.5) == y).mean() > 0.95
    assert weight[7:].max() < 0.25 < weight[:4].min()  # copies of a voter share one vote
