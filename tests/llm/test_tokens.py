import os
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.tokens import DEFAULT_TOKENIZER, Encoder, decode_ids, encode_corpus, read_tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_TOKENIZER), reason="no vocabulary file")


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return Encoder(read_tokenizer(DEFAULT_TOKENIZER))


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60) | st.text(alphabet="ab \n'é", max_size=40))
def test_equals_the_public_library(public, encoder, text):
    assert encoder.encode([text])[0].tolist() == public(text)


def test_special_names_runs_and_long_words(public, encoder):
    for text in ("<|endoftext|> x", "a" * 5000, "=" * 3001, "\n" * 2000 + "x", "abcdefghij" * 700, "don't I'll we've"):
        assert encoder.encode([text])[0].tolist() == public(text)


def test_rows(spark, public):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello world", "x"), (None, "dup", "x")]
    got = encode_corpus(spark.createDataFrame(rows, "id bigint, t string, ids string"), "id", "t")
    assert got.columns == ["id", "ids"]
    assert sorted((str(r["id"]), r["ids"]) for r in got.collect()) == sorted((str(i), public(t or "")) for i, t, _ in rows)
    assert encode_corpus(spark.createDataFrame([], "id bigint, t string"), "id", "t").count() == 0


LONG = [
    lambda r, n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)), lambda r, n: "".join(r.choice("ab") for _ in range(n)), lambda r, n: r.choice("aé=") * n,
    lambda r, n: "".join(r.choice(["the", "ing", "lamp", "é", "ü", "tion"]) for _ in range(n // 3)), lambda r, n: "".join(r.choice("=-_*#") * r.randint(1, 300) for _ in range(n // 100)),
    lambda r, n: (r.choice(["abc", "xyzzy", "qu"]) * n)[:n], lambda r, n: "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(n // 3)),
]


def test_long_words_by_blocks(public, encoder):
    rng = random.Random(8)
    for make in LONG:
        for n in (300, 513, 700, 1500, 4000):
            word = make(rng, n)
            assert encoder.encode([word])[0].tolist() == public(word), word[:40]


def test_blocks_that_never_meet(public, encoder, monkeypatch):
    monkeypatch.setattr(Encoder, "_meet", staticmethod(lambda before, places, ids: None))
    word = "".join(random.Random(1).choice("abcdefgh") for _ in range(2500))
    encoder.cache.clear()
    assert encoder.encode([word])[0].tolist() == public(word)


def test_long_words_take_linear_time(encoder):
    def seconds(n):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        began = time.perf_counter()
        encoder.encode([word])
        return time.perf_counter() - began

    rng = random.Random(9)
    seconds(6000)
    assert seconds(60_000) < 25 * seconds(6000)


def test_round_trip(spark):
    rows = [(1, "Hello  wörld\n— 日本 \U0001f600", "x"), (2, None, "x"), (3, "", "x"), (4, "a" * 3000, "x")]
    ids = encode_corpus(spark.createDataFrame(rows, "id bigint, t string, text string"), "id", "t")
    got = {r["id"]: r["text"] for r in decode_ids(ids, "id", "ids").collect()}
    assert got == {i: t or "" for i, t, _ in rows}
    assert decode_ids(spark.createDataFrame([(1, None)], "id int, ids array<int>"), "id", "ids").first()["text"] is None
