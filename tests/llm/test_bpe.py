import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from grainline.llm import bpe
from grainline.llm.bpe import PairIndexBpe, digests, encode

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def odd_texts():
    rng = random.Random(1)
    alphabet = list("abcDEF ' \t\n\x1c\x1d　\x85\xa0éÉéİΣςſsdtl0123½²٣漢字😀👍🏽.,!?-_\x00​﻿ﬁǅ×÷ªº") + ["<|endoftext|>", "'s", "'LL"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(600)]
    return texts + ["", "a<|endoftext|>b <|startoftext|><|endoftext|>c", "<|ENDOFTEXT|>", "ΑΣ ΑΣ.", "a" * 3000, "é ́e", "it's 'S We'Ve", "ab" * 40_000]


def test_matches_the_library(spark, make, sample, library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 50_000)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 2_000)  # forgets and learns again
    texts = [t for _, t in sample] + odd_texts()
    got = {r["doc_id"]: r for r in digests(encode(make(texts), FILE, ["doc_id"])).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want, t[:100]


def test_nulls_repeats_clashing_names_and_empty(make):
    docs = make([(1, None), (1, None), (None, ""), (2, "Hello")], extra=True)
    got = sorted((str(r["doc_id"]), r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in encode(docs, FILE, ["doc_id", "lang"]).collect())
    assert [g[:2] for g in got] == [("1", 0), ("1", 0), ("2", 1), ("None", 0)] and got[2][3] == "hello</w>"
    with pytest.raises(ValueError):
        encode(docs, FILE, ["doc_id", "ids"])
    assert encode(make([]), FILE, ["doc_id"]).collect() == []


def test_overlapping_pairs_merge_from_the_left(library):
    with open(FILE, encoding="utf-8") as f:
        mine = PairIndexBpe(f.read())
    words = ["a" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 20)] + ["haha" * 9 + "h"]
    for w, ids in zip(words, mine.encode_pieces(words)):
        assert ids == library.encode(w, add_special_tokens=False).ids
