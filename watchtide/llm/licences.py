"""Licence scans of paragraphs: a trained n-gram classifier, calibrated, and confirmed against templates.

Everything runs as DataFrame operations. Word n-grams are hashed; those that occur in a licence template meet
a small table of weights by a join, and a paragraph's evidence is the sum of its weights.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash

# Families and the sentences by which works name their licence.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under the CC0 1.0 Universal Public Domain Dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "gpl": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
}
UNKNOWN = "unknown"
# Paragraphs of documents that teach the unknown class; hashed features; n-gram sizes.
UNKNOWN_SAMPLE, FEATURES, SIZES = 4000, 1 << 13, (2, 3)
# Least calibrated probability of a family, and least share of a template or of the paragraph that must agree.
CERTAIN, AGREE = 0.5, 0.6
_SCALES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _grams(words: Column, sizes=SIZES) -> Column:
    """Hashes of the n-grams of a list of words."""


    def of_size(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.lit(n), *[F.get(words, i + k) for k in range(n)]))

    return F.concat(*map(of_size, sizes))


def _row_key(docs: DataFrame) -> list[Column]:
    """A text is named by its row's id, null being the least number, and its hash."""
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("doc"), F.xxhash64("text").alias("digest")]


def _paragraphs(docs: DataFrame) -> DataFrame:
    """(doc, digest, at, words) of the non-empty lines of every text."""
    rows = docs.select(*_row_key(docs), F.posexplode(F.split("text", "\\R")).alias("at", "line"))
    return rows.select("doc", "digest", "at", _words(F.col("line")).alias("words")).filter(F.size("words") > 0)


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(family, k, text) for family, texts in sorted(TEMPLATES.items()) for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "family string, template int, text string").withColumn("words", _words(F.col("text")))


class Model:
    """Tables as large as the templates: a weight per family and n-gram, and the n-grams of each template."""

    def __init__(self, weights: DataFrame, biases: dict[str, float], scale: float, parts: DataFrame):
        self.weights, self.biases, self.scale, self.parts = weights, biases, scale, parts


def fit(docs: DataFrame, unknown_sample: int = UNKNOWN_SAMPLE) -> Model:
    """Logistic regression over templates, their halves and thirds, and ``unknown_sample`` paragraphs of
    ``docs`` that share no three words with a template; a fifth of the rows calibrates the scale."""
    spark = docs.sparkSession
    templates = stash(_templates(spark).coalesce(1), "templates")
    triples = templates.select(F.explode(_grams(F.col("words"), (3,))).alias("gram")).distinct()
    size = F.size("words")
    cut = lambda first, last: F.slice("words", F.floor(size * first).cast("int") + 1, F.greatest(F.floor(size * (last - first)).cast("int"), F.lit(1)))
    shapes = [F.col("words"), cut(0, 0.5), cut(0.5, 1), cut(0.0, 0.7), cut(0.3, 1), cut(0.15, 0.85), F.concat(F.array(F.lit("copyright"), F.lit("2020")), "words"), F.concat("words", F.array(F.lit("see"), F.lit("notice")))]
    known = templates.select("family", F.explode(F.array(*shapes)).alias("words"))
    # the lines of the smallest hashes, found by hash alone, are then fetched
    lines = docs.select(F.explode(F.split("text", "\\R")).alias("line")).select("line", F.xxhash64("line").alias("draw"))
    draws = stash(lines.select("draw").distinct().orderBy("draw").limit(unknown_sample), "draws")
    plain = lines.join(F.broadcast(draws), "draw").dropDuplicates(["draw"]).select("draw", _words(F.col("line")).alias("words"))
    plain = stash(plain.filter(F.size("words") >= 3).coalesce(2), "plain")
    near = plain.select("draw", F.explode(_grams(F.col("words"), (3,))).alias("gram")).join(triples, "gram").select("draw").distinct()
    unknown = plain.join(near, "draw", "left_anti").select(F.lit(UNKNOWN).alias("family"), "words")
    rows = known.unionByName(unknown).withColumn("grams", F.array_distinct(_grams(F.col("words"))))
    vocabulary = stash(templates.select(F.explode(_grams(F.col("words"))).alias("gram")).distinct().coalesce(1), "grams")  # bounded by the templates
    names = sorted(TEMPLATES) + [UNKNOWN]
    label = F.array_position(F.array(*map(F.lit, names)), F.col("family")).cast("double") - 1
    # only n-grams of templates are features
    kept = rows.select(F.xxhash64("family", "words").alias("row"), "family", F.explode_outer("grams").alias("gram")).join(vocabulary.withColumn("own", F.lit(True)), "gram", "left")
    lists = kept.groupBy("row", "family").agg(F.collect_set(F.when(F.col("own"), F.col("gram").cast("string"))).alias("terms"))
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="terms", outputCol="features")
    table = stash(lists.select("row", "family", "terms", label.alias("label")).coalesce(2), "examples")  # bounded by the sample
    weight = F.when(F.col("family") == UNKNOWN, F.lit(1.0)).otherwise(F.lit(4.0))
    learn = hashing.transform(table.filter("pmod(row, 5) <> 0")).withColumn("weight", weight)
    fitted = LogisticRegression(family="multinomial", regParam=0.0005, maxIter=40, weightCol="weight", standardization=False).fit(learn)
    w, b = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    grams = [r.gram for r in vocabulary.orderBy("gram").collect()]
    spots = [hashing.indexOf(str(g)) for g in grams]
    present = int(max(r.label for r in table.select("label").distinct().collect())) + 1
    weights = spark.createDataFrame([(g, [float(w[k, s]) if k < len(w) else 0.0 for k in range(present)]) for g, s in zip(grams, spots, strict=True)], "gram bigint, w array<double>")
    biases = {names[k]: float(b[k]) for k in range(present)}
    weights = stash(weights.coalesce(1), "weights")

    # the scale under which held-back rows are likeliest
    held = table.filter("pmod(row, 5) = 0").select("row", "label", F.explode_outer("terms").alias("term"))
    sums = held.join(F.broadcast(weights.withColumn("term", F.col("gram").cast("string"))), "term", "left").groupBy("row", "label").agg(*[F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(present)])
    logits = [F.col(f"s{k}") + F.lit(biases[names[k]]) for k in range(present)]
    losses = sums.agg(*[F.sum(F.log(sum(F.exp(z * t) for z in logits)) - F.element_at(F.array(*logits), F.col("label").cast("int") + 1) * t).alias(f"l{i}") for i, t in enumerate(_SCALES)]).first()
    scale = min(zip((x if x is not None else 0.0 for x in losses), _SCALES, strict=True))[1]
    sets = templates.select("family", "template", F.array_distinct(_grams(F.col("words"), (2, 3))).alias("grams"))
    parts = stash(sets.select("family", "template", F.size("grams").alias("of"), F.explode("grams").alias("gram")).coalesce(1), "parts")
    return Model(weights, biases, scale, parts)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``licence`` (the likeliest confirmed family, else null), ``probability``,
    ``paragraphs`` (lines with a confirmed licence) and ``families`` (all confirmed, in order).

    A line of text is a paragraph and may name several licences. A family is taken if it is likelier than
    no licence, at a calibrated probability of ``CERTAIN``, and if one of its templates confirms it: ``AGREE`` of the
    template's two- and three-word sequences occur in the paragraph, or as much of the paragraph's occurs in the
    template. A template whose sequences found there are all among those of a better confirmed template of
    another family (more of them, then a larger share) is explained by that one and confirms nothing.

    Defined cases: null, empty and wordless texts have no licence; equal probabilities go to the family first
    by name; repeated rows get the same result; an empty table gives no row. Only ``doc_id`` and
    ``text`` are read.
    """
    model = model or fit(docs)
    names = list(model.biases)
    key = ["doc", "digest", "at"]
    lines = _paragraphs(docs).select(*key, (F.greatest(2 * F.size("words") - 3, F.lit(1))).alias("of_line"), F.explode(_grams(F.col("words"))).alias("gram"))
    hits = stash(lines.join(F.broadcast(model.weights.select("gram")), "gram").distinct(), "hits")
    sums = hits.join(F.broadcast(model.weights), "gram").groupBy(*key).agg(F.max("of_line").alias("of_line"), *[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(names))])
    logit = {n: (F.col(f"s{k}") + F.lit(model.biases[n])) * model.scale for k, n in enumerate(names)}
    against = logit.get(UNKNOWN, F.lit(0.0))
    each = F.array(*[F.struct(F.lit(n).alias("family"), (1 / (1 + F.exp(against - z))).alias("probability")) for n, z in logit.items() if n != UNKNOWN])
    likely = F.filter(each, lambda x: x["probability"] >= CERTAIN)
    guessed = sums.select(*key, "of_line", F.explode(likely).alias("guess")).select(*key, "of_line", "guess.*")
    shared = hits.select(*key, "gram").join(guessed, key).join(F.broadcast(model.parts), ["family", "gram"]).groupBy(*key, "family", "probability", "template").agg(
        F.count("*").alias("n"), F.max("of").alias("of"), F.max("of_line").alias("of_line"), F.collect_set("gram").alias("grams")
    )
    good = shared.filter((F.col("n") >= AGREE * F.col("of")) | (F.col("n") >= AGREE * F.col("of_line")))
    # templates per line are few, and their sequences as many as the templates have
    rank = F.struct("n", (F.col("n") / F.col("of")).alias("share"), "family", "template")
    lists = good.groupBy(*key).agg(F.collect_list(F.struct(rank.alias("rank"), "family", "probability", "grams")).alias("all"))
    explained = lambda t: F.exists("all", lambda u: (u["family"] != t["family"]) & (u["rank"] > t["rank"]) & (F.size(F.array_except(t["grams"], u["grams"])) == 0))
    confirmed = lists.select(*key, F.explode(F.filter("all", lambda t: ~explained(t))).alias("t")).select(*key, "t.family", "t.probability").distinct()
    found = confirmed.groupBy("doc", "digest").agg(
        F.min(F.struct((-F.round("probability", 6)).alias("p"), "family")).alias("top"), F.count_distinct("at").alias("paragraphs"), F.array_sort(F.collect_set("family")).alias("families")
    )
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_row_key(docs))
    return rows.join(found, ["doc", "digest"], "left").select(
        "doc_id", F.col("top.family").alias("licence"), (-F.col("top.p")).alias("probability"), F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"), F.coalesce("families", F.array().cast("array<string>")).alias("families")
    )
