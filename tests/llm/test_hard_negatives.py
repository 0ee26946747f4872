import math
import random

import numpy as np
import pytest

from grainline.llm import hard_negatives
from grainline.llm.hard_negatives import Anchors, Codes, mine, rotations

SCHEMA = "vec_id long, embedding array<float>, label int, row string, block string, x string"


def brute(rows, k_positive=5, k_negative=5, percent=80, every=100, scale=256):
    kept = []
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in vector], label))
    out = []
    for i, (anchor, a, label) in enumerate(kept):
        if anchor % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a, v)), vec_id, same == label) for j, (vec_id, v, same) in enumerate(kept) if j != i)
        for score, positive, _ in [s for s in scored if s[2]][:k_positive]:
            ps = -score
            fits = [s for s in scored if not s[2] and percent * ps <= 100 * -s[0] <= 100 * ps][:k_negative]
            out += [(anchor, positive, rank + 1, s[1], ps, -s[0]) for rank, s in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, every=100, **more):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in mine(df.repartition(3), f"vec_id % {every} = 0", **more).collect())


def made(n, width, seed, clusters=4, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(clusters)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("width", [3, 64, 70])
def test_equals_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "PAIRS", 100)
    rows = made(300, width, width)
    assert mined(spark, rows, every=10, anchor_block=7) == brute(rows, every=10)
    assert mined(spark, rows, every=25, k_positive=2, k_negative=9, percent=50, levels=1) == brute(rows, 2, 9, 50, 25)


def test_ties_repeats_nulls_and_odd_vectors(spark):
    same = [(i, [0.5, 0.5, 0.25], i % 2) for i in range(0, 40, 5)]
    odd = [(0, None, 1), (10, [1.0, None, 2.0], 1), (20, [float("nan"), 0.0, 0.0], 1), (30, [float("inf"), 0.0, 0.0], 0), (40, [1.0, 1.0, 1.0], None),
           (None, [1.0, 1.0, 1.0], 1), (50, [0.0, 0.0, 0.0], 1), (60, [-0.5, -0.5, -0.5], 0), (70, [], 1), (80, [2.0], 0)]
    repeats = [(10, [0.5, 0.5, 0.25], 0), (10, [0.5, 0.5, 0.25], 1), (20, [0.25, 1.0, 1.0], 0)]
    rows = same + odd + repeats + same
    got = mined(spark, rows, every=10)
    assert got == brute(rows, every=10) and len(got) > 50


def test_large_components_are_scored_exactly(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.choice([0, 3, 5]) for _ in range(8)], i % 2) for i in range(60)]
    assert mined(spark, rows, every=5) == brute(rows, every=5)
    rows = [(i, [3e15, 1.0 + i], i % 2) for i in range(6)] + [(6, [1e30, 1.0], 0)]
    got = mined(spark, rows, every=3)
    assert got and all(abs(g[4]) <= 2**63 and abs(g[5]) <= 2**63 for g in got)


def test_empty_tables_and_lone_labels(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1), (100, [1.0], 2)]) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []


def test_intervals_hold_and_narrow_with_levels():
    rng = np.random.default_rng(3)
    x = np.floor(rng.standard_normal((200, 64)) * 100)
    a = np.floor(rng.standard_normal((20, 64)) * 100)
    exact, widths = a @ x.T, []
    for levels in (1, 3):
        turns = rotations(64, levels)
        low, high = Anchors(a, turns).interval(Codes.of(x, turns))
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).mean())
    assert widths[1] < 0.7 * widths[0]
