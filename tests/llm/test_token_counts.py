import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from grainline.llm import token_counts
from grainline.llm.token_counts import PieceCounter, count_tokens, encode_long

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)
with open(FILE, encoding="utf-8") as f:
    COUNTER = PieceCounter(f.read())
ALPHABET = [*"abcDEF ' \t\n\x0b\x1c\x1d\x85\xa0éÉİΣſsdtl0123½²٣漢字😀👍🏽.,!?-_\x00​﻿ﬁ×÷ªº", "　", "<|endoftext|>", "<|endo", "ftext|>", "   ", "'re", "\r\n"]


def whole(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


def odd_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(400)]
    return [*texts, "", None, "a<|endoftext|>b<|endoftext|><|endoftext|>c", " " * 500, "x" * 3000, "ab " * 900, "\n \n" * 300]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=150), st.integers(1, 40), st.integers(1, 12))
def test_spliced_chunks_have_the_whole_texts_pieces(symbols, chunk, overlap):
    text = "".join(symbols)
    assert COUNTER.total(text) == whole(text)
    if text:
        ends, tokens = encode_long(text, COUNTER.encode, COUNTER.margin, chunk, min(overlap, chunk))
        want = COUNTER.encode(text, 0)
        assert np.array_equal(ends, want[0]) and np.array_equal(tokens, want[1])


def test_overlaps_widen_over_long_pieces():
    text = "one two " + "x" * 5000 + " three " + " " * 700 + "four<|endoftext|>" + "é" * 900 + " five"
    starts = []

    def encode(chunk, start):
        starts.append(start)
        return COUNTER.encode(chunk, start)

    ends, tokens = encode_long(text, encode, COUNTER.margin, 200, 20)
    want = COUNTER.encode(text, 0)
    assert np.array_equal(ends, want[0]) and tokens[-1] == want[1][-1] == whole(text)
    assert len(starts) < 120  # widened overlaps double


def test_matches_the_library(spark, make, sample, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_PIECES", 2_000)  # forgets and learns again
    texts = [t for _, t in sample] + odd_texts()
    got = {r["doc_id"]: r for r in count_tokens(make(texts), FILE, ["doc_id"], chunk=300, overlap=40).collect()}
    for i, t in enumerate(texts):
        n = whole(t)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 512), t


def test_parts_of_huge_texts_are_counted_apart(spark, make, sample):
    """Texts of many parts, one of them with pieces longer than a part."""
    words = " ".join(t for _, t in sample if t)[:60_000]
    texts = [words, words[:30_000] + "y" * 9_000 + words[30_000:], "z" * 20_000, "short", None, words, "<|endoftext|>" * 2000, " " * 9_000 + words[:5_000]]
    out = count_tokens(make(texts, extra=True), FILE, ["doc_id", "lang", "key"], chunk=700, overlap=50, part=4_000, part_overlap=300)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(texts) and out.columns == ["doc_id", "lang", "key", "n_bytes", "n_tokens", "over_limit"]
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == whole(t), i


def test_nulls_repeats_clashing_names_and_empty(make):
    docs = make([(1, None), (1, None), (None, ""), (2, "Hello world"), (2, "Hello world")], extra=True)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(docs, FILE, ["doc_id"], limit=1).collect())
    assert got == [("1", 0, 0, False), ("1", 0, 0, False), ("2", 11, 2, True), ("2", 11, 2, True), ("None", 0, 0, False)]
    with pytest.raises(ValueError):
        count_tokens(docs, FILE, ["doc_id", "n_tokens"] if "n_tokens" in docs.columns else ["n_tokens"])
    with pytest.raises(ValueError):
        count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])
    assert count_tokens(make([]), FILE, ["doc_id"]).collect() == []
