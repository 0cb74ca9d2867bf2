import pytest

from tallybook.llm import tokenizer

TEXTS = ["Hello  world, it's 1,234.50!", None, "", "   \n\t x", "<|endoftext|> ñ 🙂 東京 ퟿", "a" * 3000, "ab" * 700 + " tail", "word " * 20_000, "\x00\x01"]


def test_matches_the_public_library(spark):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer.VOCABULARY)
    lib.encode_special_tokens = True
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "clash")], "doc_id long, text string, ids string")
    rows = tokenizer.token_ids(frame).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert list(r["ids"]) == (lib.encode(TEXTS[r["doc_id"]], add_special_tokens=False).ids if TEXTS[r["doc_id"]] else [])


def test_round_trip_and_short_recursion():
    enc = tokenizer.Encoder(tokenizer.VOCABULARY, steps=3)  # words need several rounds
    texts = [t for t in TEXTS[:6] if t]
    assert [enc.decode(i) for i in enc.encode(texts)] == texts


def test_empty(spark):
    assert tokenizer.token_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0
