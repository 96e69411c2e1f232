from tests.llm.fixtures import DOCS, awkward, awkward_texts, empty
from watchtide.llm import licences
from watchtide.llm.common import table
from watchtide.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
# The lines by which the shared documents name their licence.
LINES = {
    "mit": "Released under the MIT License",
    "apache": "Licensed under the Apache License, Version 2.0",
    "gpl": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
}


def test_whole_table_matches_known_lines(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = QUERIES["op1_licences"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert set(r.families) == {f for f, line in LINES.items() if line in texts[r.doc_id]}, r.doc_id
        assert (r.licence is None) == (not r.families) and (r.probability is None or r.probability >= licences.CERTAIN)


def test_awkward_rows_and_notices(spark):
    notices = [
        (900, "intro words here\nPERMISSION is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in it", "mit"),
        (901, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
        (902, "you must have a license to drive under the law of the land", None),
        (903, "the free of the to the by the under the", None),
    ]
    extra = spark.createDataFrame([(i, t, "en", "s", len(t), *["clash"] * 14) for i, t, _ in notices], DOCS)
    docs = awkward(spark).unionByName(extra)
    model = licences.fit(docs)
    rows = licences.scan(docs, model).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted([str(d) for d, _, _ in awkward_texts()] + [str(n[0]) for n in notices])
    got = {r.doc_id: r.licence for r in rows}
    assert {i: got[i] for i, _, _ in notices} == {i: f for i, _, f in notices}
    assert all(got[d] is None for d, _, _ in awkward_texts())


def test_plan_has_no_python(spark):
    docs = table(spark, SF, "documents")
    plan = licences.scan(docs, licences.fit(docs))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_empty_table(spark):
    assert licences.scan(empty(spark)).collect() == []


def test_two_licences_on_a_line_and_rows_without_ids(spark):
    dual = "Licensed under the Apache License, Version 2.0. Licensed under the MIT license."
    mit, gpl = "Released under the MIT License", "This work is licensed under the GNU General Public License, version 3"
    long = "tavo miri lo " * 300
    texts = [
        (1, dual, ["apache", "mit"]), (2, f"{long} {mit} {long} {gpl}. {long}", ["gpl", "mit"]), (None, mit, ["mit"]), (None, "no notice", []), (4, f"{mit}\n{dual}", ["apache", "mit"]),
        (5, "Licensed under CC BY-NC 4.0", ["cc-by-nc"]), (6, "Licensed under the GNU Lesser General Public License, version 2.1.", ["lgpl"]),
        (7, licences.TEMPLATES["lgpl"][0], ["lgpl"]), (8, licences.TEMPLATES["agpl"][0] + " " + licences.TEMPLATES["mit"][0], ["agpl", "mit"]),
    ]
    rows = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id bigint, text string")
    found = licences.scan(rows, licences.fit(table(spark, SF, "documents"))).collect()
    assert sorted((str(r.doc_id), r.families) for r in found) == sorted((str(i), f) for i, _, f in texts)
