import zlib
from collections import Counter, defaultdict

from tests.llm.fixtures import awkward, awkward_texts, empty
from watchtide.llm import sharding


def test_shards_are_even_gapless_and_follow_the_mixture(spark):
    rows = sharding.interleave(awkward(spark), shards=5, slice_rows=7).collect()
    texts = awkward_texts()
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(5))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slices_do_not_change_the_result(spark):
    docs = awkward(spark).dropDuplicates(["doc_id", "text"])
    key = lambda r: (r.doc_id is None, r.doc_id, r.text_crc32)
    one, many = (sorted(((*key(r), r.shard, r.slot) for r in sharding.interleave(docs, 4, slice_rows=n).collect()), key=str) for n in (1000, 3))
    assert one == many


def test_sources_spread_in_proportion(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "'t' AS text", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end AS source")
    got = sharding.interleave(docs, 9, slice_rows=50).join(docs, "doc_id").groupBy("shard").agg({"source": "count"}).collect()
    hot = sharding.interleave(docs, 9, slice_rows=50).join(docs.filter("source = 'hot'"), "doc_id").groupBy("shard").count().collect()
    assert {r[1] for r in got} == {100}
    assert all(32 <= r["count"] <= 35 for r in hot)


def test_more_shards_than_rows_and_no_rows(spark):
    assert sharding.interleave(empty(spark), 24).collect() == []
    few = sharding.interleave(spark.createDataFrame([(1, "a", "s"), (2, None, None)], "doc_id bigint, text string, source string"), 24).collect()
    assert sorted(r.slot for r in few) == [0, 0]
