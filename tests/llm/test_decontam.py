import random
import re

import numpy as np

from grainline.llm import decontam
from grainline.llm.decontam import FmIndex, WaveletMatrix, contamination_report, find_contamination, suffix_array

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items, window=13):
    phrases = {}
    for i, t in items:
        w = words(t)
        if i is not None:
            for k in range(max(1, len(w) - window + 1) if w else 0):
                phrases.setdefault(tuple(w[k:k + window]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if own := phrases.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(spark, make, docs, items, **kw):
    table = spark.createDataFrame(items, "item_id long, text string")
    found = find_contamination(make(docs, extra=True), table, ["doc_id", "text"], **kw)
    rows = found.collect()
    report = {(r["doc_id"], r["n_words"], r["n_hit"]): r["contaminated"] for r in contamination_report(found).collect()}
    for r in rows:  # the spans hold the words that were hit
        raw = (r["text"] or "").encode()
        cut = [words(raw[s["start"]:s["end"]].decode()) for s in r["spans"]]
        assert [len(c) for c in cut] == [h["end"] - h["start"] for h in r["hits"]]
    hits = lambda r: sum(h["end"] - h["start"] for h in r["hits"])
    return sorted(((r["doc_id"], r["n_words"], hits(r), r["items"], report[r["doc_id"], r["n_words"], hits(r)]) for r in rows), key=repr)


def test_given_tables(spark, make, sample, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_BYTES", 60_000)  # several shards
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    want = brute(sample, items)
    assert any(w[4] for w in want)
    assert run(spark, make, sample, items) == want
    assert run(spark, make, sample, items, block_bytes=2_000) == want  # several blocks of phrases


def test_short_items_and_odd_rows(spark, make):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(60)))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "A-B,a.b A"), (52, "A-B,a.b A"), (None, "é É b"), (53, "a b " * 40_000), (54, "... !!")]
    items = [(1, "a b"), (2, "c"), (3, None), (None, "d d"), (5, ""), (6, "é b"), (7, "É"), (8, "a b c d e a b c d e a b c d"), (1, "e e e"), (10, "!?")]
    assert run(spark, make, docs, items) == brute(docs, items)
    assert run(spark, make, docs, []) == brute(docs, [])
    assert run(spark, make, [], items) == []


def test_index_counts_and_locates():
    rng = np.random.default_rng(0)
    seq = rng.integers(0, 4, 3000)
    seq[-1] = 0
    seq[:40] = 1  # a long run
    ranked = lambda i: [(1, int(c), 0) if c else (0, 0, i + k) for k, c in enumerate(seq[i:])]
    order = suffix_array(seq)
    cut = lambda i: next(ranked(i)[: k + 1] for k, c in enumerate(seq[i:]) if c == 0)
    assert order.tolist() == sorted(range(len(seq)), key=cut)
    index = FmIndex(seq, 4)
    for phrase in ([1], [1, 2], [3, 3, 1], [1] * 20, [2, 2, 2, 2, 2, 2, 2]):
        low, high = index.search(np.array([phrase]))
        places = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert places == [i for i in range(len(seq)) if seq[i:i + len(phrase)].tolist() == phrase]


def test_wavelet_matrix():
    values = np.random.default_rng(1).integers(0, 37, 500)
    tree = WaveletMatrix(values, 37)
    at = np.arange(501)
    for c in (0, 5, 36):
        assert tree.rank(np.full(501, c), at.copy()).tolist() == [int((values[:i] == c).sum()) for i in at]
    assert tree.access(np.arange(500)).tolist() == values.tolist()
