"""Awkward rows and brute-force versions."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

# extra columns bear names that operators use inside
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("at", "core", "uid", "row", "print", "slice", "score", "y", "nth", "digest", "words", "kept", "root", "id")],
])


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ta", "ri", "mo", "né", "ßu", "lo", "ki"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward_texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): nulls, empty, spaces only, copies, near copies, shared passages, one very long text."""
    rng = random.Random(3)
    shared, base = sentence(rng, 70), sentence(rng, 150)
    near = base.split(" ")
    near[40] = "xyzzy"
    rows = [
        (1, base, "a"), (2, base, "a"), (3, " ".join(near), "b"), (4, None, None), (5, "", "a"), (6, " \n\t ", "b"), (7, "one", "a"), (8, "One", "c"),
        (9, sentence(rng, 30) + " " + shared + " " + sentence(rng, 30), "a"), (10, shared + "\n" + sentence(rng, 5), "b"), (11, sentence(rng, 12) + shared, None),
        (12, "日本語のテキスト 𝔘 ▁ á \x00 " + sentence(rng, 9), "a"), (13, "ab" * 300, "a"), (14, sentence(rng, 6000), "a"), (15, "x" * 700, "b"),
        (None, sentence(rng, 20), "a"), (16, sentence(rng, 44), "a"), (16, sentence(rng, 45), "a"), (2, base, "a"), (17, "  two  spaces ", "a"), (18, "Die ÄPFEL die Äpfel", "b"),
    ]
    rows += [(100 + k, sentence(rng, rng.randint(1, 60)), rng.choice("ab")) for k in range(30)]
    return rows


def awkward(spark):
    rows = [(d, t, "en", s, None if t is None else len(t), *["clash"] * 14) for d, t, s in awkward_texts()]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_words(text: str | None) -> list[bytes]:
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
