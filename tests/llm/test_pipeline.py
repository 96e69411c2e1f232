import corpus_pipeline
from tests.llm.fixtures import awkward, empty, plain_words
from tests.llm.test_near_copies import brute_parts
from tests.llm.test_suffixes import brute
from watchtide.llm import decontamination, quality, stages
from watchtide.llm.common import stash, table

SF = "/root/testdata/sf0.001"


def test_every_stage_takes_effect_on_all_rows_of_the_one_before(spark):
    docs = table(spark, SF, "documents")
    columns, labels = docs.columns, table(spark, SF, "labels")
    left = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "sentencepiece_encoding"]
    items = [plain_words(r.text) for r in table(spark, SF, "benchmark").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stash(stage(spark, docs, SF))
        if k == 0:
            good = {r.doc_id for r in quality.score(before, labels).filter("predicted = 1").collect()}
            left = {d: t for d, t in left.items() if d in good}
        elif k == 1:
            ids = sorted(left)
            parts = brute_parts([left[d] for d in ids])
            left = {ids[p]: left[ids[p]] for p in set(parts)}
        elif k == 2:
            ids = sorted(left)
            sizes = {d: n - gone for d, (n, gone, _, _) in zip(ids, brute([left[d] for d in ids], 200), strict=True)}
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert set(texts) == set(ids)
            # a cut inside a character takes the rest of it along
            assert all(0 <= sizes[d] - len(texts[d].encode()) <= 6 for d in ids)
            left = texts
        elif k == 3:
            def holds(text):
                a = plain_words(text)
                for b in items:
                    span = min(decontamination.SPAN, len(b))
                    pairs = ((x, y) for x in range(len(a) - span + 1) for y in range(len(b) - span + 1) if a[x] == b[y] or a[x + 1 : x + 3] == b[y + 1 : y + 3])
                    if any(sum(p == q for p, q in zip(a[x : x + span], b[y : y + span], strict=True)) >= decontamination.SHARE * span for x, y in pairs):
                        return True
                return False

            left = {d: t for d, t in left.items() if not holds(t)}
        if k < 4:
            assert docs.columns == columns
        rows = docs.collect()
        assert len(rows) == len(left) and {r.doc_id for r in rows} == set(left), name
    from watchtide.llm import piece_sampling

    decoded = {r.doc_id: r.text for r in piece_sampling.decode(docs).collect()}
    assert decoded == left
    whole = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.pieces for r in whole} == {r.doc_id: r.pieces for r in docs.collect()}


def test_stages_take_awkward_and_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF).collect() == []
    docs = awkward(spark)
    for stage in (stages.keep_good, stages.near_dedup, stages.cut_repeats, stages.decontaminate):
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(docs.columns)
        out.collect()
    one = {r.doc_id: r for r in stages.near_dedup(spark, docs, SF).collect()}
    assert 1 in one and 2 not in one and None in one
    # two unrelated texts share this id: neither goes
    assert len(stages.near_dedup(spark, docs, SF).filter("doc_id = 16").collect()) == 2
