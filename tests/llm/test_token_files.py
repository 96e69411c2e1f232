import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.fixtures import awkward, awkward_texts, empty, sentence
from watchtide.llm import token_files
from watchtide.llm.common import shared_path

PATH = public_tokenizers.path(token_files.VOCABULARY)


def test_cuts_do_not_change_ids():
    model = Tokenizer.from_file(PATH)
    encoder = token_files.Encoder(PATH)
    rng = random.Random(5)
    signs = ["don't", "we're they'll", " ", "  ", "\n", "\t", "<|endoftext|>", "é", "́", "я", "²", "a_b", "'s", "12", "|", "(x)", "日本", "\x1c", "ABC", "l'été", "."]
    texts = ["".join(rng.choice(signs) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12))) + sentence(rng, 3) for _ in range(400)]
    texts += [t or "" for _, t, _ in awkward_texts()]
    for t, packed in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u2").tolist() == [*model.encode(t, add_special_tokens=False).ids, token_files.END_ID], t


def test_white_space_before_words_keeps_its_ids():
    model = Tokenizer.from_file(PATH)
    encoder = token_files.Encoder(PATH)
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()] + ["\u180e", "\u200b", "\ufeff"]
    common = [" ", "\n", "\r", "\t", "\xa0", "\x1c", "\u2003"]
    runs = ["".join(r) for r in [*itertools.product(spaces, repeat=1), *itertools.product(spaces, repeat=2), *itertools.product(common, repeat=3), *itertools.product(common[:4], repeat=4)]]
    texts = [f"{before}{run}word{after}" for run in runs for before in ("", "a", "One.", "12", "x'", "é") for after in ("", run + "Two one")]
    assert "a\n\nword" in texts and "a \n\nword" in texts
    whole = model.encode_batch_fast(texts, add_special_tokens=False)
    for t, packed, e in zip(texts, encoder.encode(texts), whole, strict=True):
        assert np.frombuffer(packed, "<u2").tolist() == [*e.ids, token_files.END_ID], repr(t)


def test_memory_may_turn_over(monkeypatch):
    monkeypatch.setattr(token_files, "MEMORY", 5)
    texts = [sentence(random.Random(k), 20) for k in range(30)]
    small, large = token_files.Encoder(PATH), token_files.Encoder(PATH)
    assert [small.encode([t]) for t in texts] == [[x] for x in large.encode(texts)]


def test_files_round_trip(spark):
    folder = shared_path(spark, "test")
    token_files.write(awkward(spark), folder, file_bytes=2000)
    index = token_files.index(spark, folder).collect()
    model = Tokenizer.from_file(PATH)
    ids = [(d, [*model.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, _ in awkward_texts()]
    want = sorted((str(d), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in ids)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in index) == want
    assert len({r.file for r in index}) > 3
    at = 0
    for r in sorted(index, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(index, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])

    read = token_files.read_shuffled(spark, folder, seed=3).collect()
    assert sorted((str(r.doc_id), r.ids) for r in read) == sorted((str(d), i) for d, i in ids)
    again = token_files.read_shuffled(spark, folder, seed=3).collect()
    other = token_files.read_shuffled(spark, folder, seed=4).collect()
    assert [r.ids for r in read] == [r.ids for r in again] != [r.ids for r in other]


def test_damage_is_noticed():
    good = token_files.framed(b"payload") + b"\n" + token_files.framed(b"more") + b"\n"
    assert [p for _, p in token_files.records(good)] == [b"payload", b"more"]
    for at in (0, 9, 14, 20):
        with pytest.raises(ValueError):
            list(token_files.records(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]))


def test_empty_table(spark):
    folder = shared_path(spark, "test")
    token_files.write(empty(spark), folder)
    assert token_files.index(spark, folder).collect() == []


def test_files_follow_their_numbers(spark):
    numbers = [0, 9, 10, 99_999, 100_000, 100_009, 1_000_000]
    names = spark.createDataFrame([(f"part-{n:05d}-abc-c000.txt",) for n in reversed(numbers)], "file string")
    assert [r[0] for r in names.orderBy(token_files._number("file")).select(token_files._number("file")).collect()] == numbers


def test_parts_without_text_are_not_looked_up(monkeypatch):
    class Watched(dict):
        def __getitem__(self, key):
            assert key
            return super().__getitem__(key)

    encoder = token_files.Encoder(PATH)
    encoder.recent = Watched(encoder.recent)
    texts = ["One two three, four.", "", "and more"]
    assert encoder.encode(texts) == token_files.Encoder(PATH).encode(texts)


def test_words_are_encoded_many_at_once(monkeypatch):
    class Counted:
        def __init__(self, model):
            self.model, self.texts = model, 0

        def encode_batch_fast(self, texts, **how):
            self.texts += len(texts)
            return self.model.encode_batch_fast(texts, **how)

    words = list(dict.fromkeys(w for k in range(200) for w in sentence(random.Random(k), 40).split()))
    texts = [" ".join(words), "\n".join(words), "Élan,Çà été; " + ". ".join(words)]
    encoder = token_files.Encoder(PATH)
    encoder.model = counted = Counted(encoder.model)
    want = [[*counted.model.encode(t, add_special_tokens=False).ids, token_files.END_ID] for t in texts]
    assert [np.frombuffer(p, "<u2").tolist() for p in encoder.encode(texts)] == want
    assert counted.texts < len(words)
    # where line feeds cannot be told apart, words are encoded one by one
    monkeypatch.setattr(token_files.Encoder, "_words", lambda self, words: None)
    assert [np.frombuffer(p, "<u2").tolist() for p in token_files.Encoder(PATH).encode(texts)] == want


def test_texts_beside_a_special_one_are_cut(spark):
    encoder, model = token_files.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["<|endof", "text|> one two", "", None, "a<|endoftext|>b c", "three four", "", "\nfive\n six"]
    got = encoder.encode(texts)
    assert [np.frombuffer(p, "<u2").tolist() for p in got] == [[*model.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert b" four" in encoder.recent and b"a<|endoftext|>b c" in encoder.recent
