import random
import struct
from hashlib import sha256

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.fixtures import awkward, awkward_texts, empty
from watchtide.llm import word_bpe
from watchtide.llm.common import table

PATH = public_tokenizers.path(word_bpe.VOCABULARY)


@pytest.fixture(scope="module")
def codec():
    return word_bpe.Codec(PATH)


@pytest.fixture(scope="module")
def library():
    model = Tokenizer.from_file(PATH)
    model.no_truncation()
    model.no_padding()
    return model


def same(codec, library, texts):
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        own = codec.encode(text)
        assert own == struct.pack(f"<{len(ids)}I", *ids), text[:200]
        assert codec.decode(own).decode() == library.decode(ids, skip_special_tokens=False)


def test_every_character_as_the_library(codec, library):
    codes = [*range(0xD800), *range(0xE000, 0x1F000), *range(0x1F000, 0x110000, 97)]
    same(codec, library, (" ".join(f"A{chr(k)}b1{chr(k)}" for k in codes[a : a + 4096]) for a in range(0, len(codes), 4096)))


def test_random_texts_as_the_library(codec, library):
    rng = random.Random(1)
    codes = [*range(32, 127), 9, 10, 0x1C, 0x1F, 0x85, 0xA0, 0x130, 0x301, 0x327, 0x344, 0x3A3, 0x5B0, 0x5BC, 0x5D0, 0xF71, 0xF72, 0x1100, 0x1161, 0x11A8, 0x1E9E, 0x200D, 0x2028, 0x4E00, 0xFB01, 0x1D400, 0x1F600]
    letters = [chr(k) for k in codes]
    same(codec, library, ("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5000)))
    parts = ["<|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "́", "'s", "'LL", "'ve", "!'re", " ", "x", "É", "\n\n"]
    same(codec, library, ("".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(1000)))


def test_long_words_as_the_library(codec, library):
    rng = random.Random(2)
    same(codec, library, ["".join(rng.choice("abcdeé漢=-") for _ in range(n)) for n in (127, 128, 129, 300, 5000)])
    same(codec, library, ["a" * 5000, "=" * 3000, "the" * 700, "ab" * 64, "ab" * 65])


def test_scans_and_heap_agree(codec):
    rng = random.Random(3)
    for _ in range(1000):
        word = "".join(rng.choice("theinganrouéß") for _ in range(rng.randint(1, 40))).encode()
        parts = [*map(codec.inner.__getitem__, word[:-1]), codec.last[word[-1]]]
        assert codec._scanned(list(parts)) == codec._heaped(list(parts))


def test_forgotten_words_are_found_again(library, monkeypatch):
    monkeypatch.setattr(word_bpe, "MEMORY", 5)
    same(word_bpe.Codec(PATH), library, [t or "" for _, t, _ in awkward_texts()])


def test_whole_documents_as_the_library(spark, library):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = len(ids), sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), sha256(decoded.encode()).hexdigest()
    assert {r[0]: tuple(r[1:]) for r in word_bpe.round_trip(docs).collect()} == want


def test_awkward_rows_and_the_general_interface(spark, library):
    docs = awkward(spark)
    encoded = word_bpe.encode(docs)
    rows = sorted((str(r.doc_id), r.ids) for r in encoded.collect())
    assert rows == sorted((str(d), library.encode(t or "", add_special_tokens=False).ids) for d, t, _ in awkward_texts())
    texts = sorted((str(r.doc_id), r.text) for r in word_bpe.decode(encoded).collect())
    assert texts == sorted((i, library.decode(ids, skip_special_tokens=False)) for i, ids in rows)
    assert word_bpe.round_trip(docs).count() == len(rows)
    none = sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in word_bpe.round_trip(docs.filter("doc_id in (4, 5, 6)")).collect()} == {(0, none, none)}
    assert word_bpe.encode(empty(spark)).collect() == word_bpe.round_trip(empty(spark)).collect() == []
