import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from grainline.llm import hmm
from grainline.llm.hmm import Hmm, Lockstep, score_documents
from grainline.llm.toxicity import remainder

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def model(states=3, classes=5, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return Hmm(norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, classes))))


def by_paths(m, seq):
    """(probability, expected starts, moves, emissions) over all state paths."""
    total, start, move, emit = 0.0, np.zeros_like(m.start), np.zeros_like(m.move), np.zeros_like(m.emit)
    for path in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * np.prod([m.emit[s, c] for s, c in zip(path, seq)]) * np.prod([m.move[a, b] for a, b in zip(path, path[1:])])
        total += p
        start[path[0]] += p
        for a, b in zip(path, path[1:]):
            move[a, b] += p
        for s, c in zip(path, seq):
            emit[s, c] += p
    return total, start / total, move / total, emit / total


def test_forward_and_counts_against_all_paths():
    m, rng = model(), random.Random(1)
    seqs = [np.array([rng.randrange(5) for _ in range(n)]) for n in (1, 6, 3, 6, 2)]
    steps = Lockstep(seqs)
    want = [by_paths(m, s) for s in seqs]
    assert np.allclose(steps.log10(m), [math.log10(w[0]) for w in want])
    for got, parts in zip(steps.counts(m), zip(*[w[1:] for w in want])):
        assert np.allclose(got, sum(parts))


def test_long_sequences_scaled_once_in_some_steps(monkeypatch):
    m, rng = model(2), random.Random(2)
    seqs = [np.array([rng.randrange(5) for _ in range(n)]) for n in (10, 9, 11, 8)]
    want = [by_paths(m, s) for s in seqs]
    for every in (1, 3, hmm.SCALED):
        monkeypatch.setattr(hmm, "SCALED", every)
        steps = Lockstep(seqs)
        assert np.allclose(steps.log10(m), [math.log10(w[0]) for w in want])
        for got, parts in zip(steps.counts(m), zip(*[w[1:] for w in want])):
            assert np.allclose(got, sum(parts))
    rare = Hmm(m.start, m.move, np.full((2, 5), 1e-27))
    steps = Lockstep([np.zeros(4_000, np.int64)])
    assert np.allclose(steps.log10(rare), [-27 * 4_000]) and all(np.isfinite(x).all() for x in steps.counts(rare))


def test_iterations_raise_the_likelihood():
    rng = random.Random(5)
    seqs = [np.array([rng.choice((0, 1) if i % 2 else (2, 3, 4)) for _ in range(30)]) for i in range(60)]
    m, last = Hmm.guess(np.ones(5), 2), -math.inf
    for _ in range(6):
        steps = Lockstep(seqs)
        now = steps.log10(m).sum()
        assert now > last
        last, m = now, Hmm.from_counts(*steps.counts(m))


def check_counts(rows, got):
    tokens = [WORD.findall((t or "").encode().lower()) + [None] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    total, kinds = sum(c.values()), len(c)
    want = sorted((str(d), h, len(ws), sum(c[w] > 0 for w in ws), total, round(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws), 4))
                  for (d, _), ws, h in zip(rows, tokens, held))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want


def run(df):
    return score_documents(df, remainder(F.col("doc_id")) == 1).collect()


def test_given_documents(make, sample, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_WORDS", 400)  # many blocks
    monkeypatch.setattr(hmm, "BATCH_TOKENS", 3_000)
    got = run(make(sample))
    check_counts(sample, got)
    for held in (True, False):
        part = [r for r in got if r["held_out"] == held]
        assert sum(r["score"] for r in part) > sum(r["base_score"] for r in part)


def test_nulls_repeats_clashing_names_and_empty(make):
    rows = [(1, None), (1, None), (2, ""), (None, "a b"), (4, "word " * 30_000), (5, "Word\x0bword\x1cword"), (6, "é É")]
    got = run(make(rows, extra=True))
    check_counts(rows, got)
    same = {r["score"] for r in got if r["doc_id"] in (1, 2)}
    assert len(same) == 1 and all(math.isfinite(r["score"]) for r in got)
    assert run(make([])) == []
    only_held = [(i, "x y") for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]
    check_counts(only_held, run(make(only_held)))


def test_all_training_texts_take_part_in_all_rounds(make, monkeypatch):
    """Texts that are all longer than 2,000 tokens: every round gains, and the
    states part the two kinds of words."""
    rng = random.Random(3)
    kinds = [[f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]]
    rows = [(i, " ".join(w for k in range(50) for w in rng.choices(kinds[k % 2], k=50))) for i in range(12)]
    found = []
    whole = hmm.baum_welch

    def watched(*args):
        model, gains = whole(*args)
        found.extend(gains)
        return model, gains

    monkeypatch.setattr(hmm, "baum_welch", watched)
    got = run(make(rows))
    assert len(found) > 3 and all(b > a for a, b in zip(found, found[1:]))
    assert found[-1] - found[-2] < hmm.GAIN * abs(found[-2])
    # without the classes' unknown mass, 40 rounds in memory reach 0.259 a token
    assert sum(r["score"] for r in got) - sum(r["base_score"] for r in got) > 0.24 * sum(r["n_tokens"] for r in got)


def test_scores_do_not_depend_on_the_partitions(make, sample, monkeypatch):
    monkeypatch.setattr(hmm, "TOP_WORDS", 150)  # most words share classes, and ties stand at the bound
    rows = sample + [(10_000 + i, f"thin{i % 7} spread{i % 11} words") for i in range(200)]
    one, many = ({r["doc_id"]: r for r in run(make(rows).repartition(n))} for n in (1, 16))
    assert one.keys() == many.keys()
    for d, r in one.items():
        assert math.isclose(r["score"], many[d]["score"], rel_tol=1e-9)
        assert math.isclose(r["base_score"], many[d]["base_score"], rel_tol=1e-12)


def test_own_classes_are_the_words_of_largest_full_counts(make, sample, monkeypatch):
    monkeypatch.setattr(hmm, "TOP_WORDS", 60)
    docs = make(sample).repartition(16).selectExpr("doc_id", "false AS held_out", "cast(text AS binary) AS text")
    blocks = hmm.written(docs.mapInArrow(hmm._blocks, hmm.BLOCK), "blocks")
    found, _ = hmm._vocabulary(blocks)
    c = Counter(w for _, t in sample for w in WORD.findall((t or "").encode().lower()) + [b""])
    assert list(found.class_total[:60]) == sorted(c.values(), reverse=True)[:60]
    assert found.total == sum(c.values()) and found.distinct == len(c)
