import math
import random
import struct

import numpy as np
import pytest

from grainline.llm import topk
from grainline.llm.topk import top_k

LONG = 2**63 - 1


def whole(c):
    return int(c) * 64 if abs(c) >= 2.0**53 else math.floor(64 * c)


def brute(rows, k):
    """Every row but the query's own is a candidate, repeated ids included."""
    fine = [(i, [whole(c) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for a, (q, u) in enumerate(fine):
        if q % 20 == 0:
            scored = sorted((-sum(s * t for s, t in zip(u, v)), i) for b, (i, v) in enumerate(fine) if b != a)[:k]
            out += [(q, n + 1, i, max(-LONG, min(LONG, -s))) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, k, kind="float"):
    df = spark.createDataFrame([(i, x, 1, "x") for i, x in rows], f"vec_id long, embedding array<{kind}>, row int, id string")
    got = top_k(df, "id % 20 = 0", k)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(tuple(r) for r in got.collect())


def hard_rows():
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(120)]
    rows += [(i, rows[0][1]) for i in range(200, 300)]  # one hot vector: long ties
    return rows + [(400, None), (420, [float("nan")] * 6), (440, [None, 1.0]), (460, [float("inf")]), (None, [1.0] * 6), (480, [])]


def test_against_brute_force_with_ties_and_nulls(spark):
    assert run(spark, hard_rows(), 7) == brute(hard_rows(), 7)


def test_many_blocks_of_queries_and_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 5)
    assert run(spark, hard_rows(), 3) == brute(hard_rows(), 3)


def test_rows_that_share_an_id_are_rows_each(spark):
    rows = [(0, [1.0]), (1, [1.0]), (1, [2.0]), (2, [0.5]), (20, [3.0]), (20, [3.0]), (20, [-1.0])]
    got = run(spark, rows, 20)
    assert got == brute(rows, 20)
    assert (0, 1, 20, 64 * 192) in got and (0, 3, 1, 64 * 128) in got and (20, 1, 20, 192 * 192) in got


def test_a_hot_id_and_repeated_rows(spark):
    rows = [(40, [0.25 * (i % 3), 1.0]) for i in range(60)] + [(i, [1.0, -0.5]) for i in range(30)]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_wide_range_of_scores_and_few_candidates(spark):
    single = lambda x: [struct.unpack("f", struct.pack("f", c))[0] for c in x]
    rows = [(0, [1e6, -3.0]), (20, [1e-3, 2.0]), (21, [-1e6, 0.5])]
    assert run(spark, rows, 20) == brute([(i, single(x)) for i, x in rows], 20)


@pytest.mark.parametrize("big", [3e15, 1e10, 1e30])
def test_any_finite_component(spark, big):
    """Scores past 2^53 and past a long."""
    rows = [(0, [big, -3.0]), (20, [big, 1.0]), (21, [-big, 0.5]), (22, [big, 2.0]), (23, [1.0, 1.0]), (24, [0.0, -1.0]), (40, [big / 7, big / 3])]
    got = run(spark, rows, 4, "double")
    assert got == brute(rows, 4)


def test_products_of_the_largest_doubles():
    x = np.array([[1.5e308, -3.0], [2.0**53 + 2, 0.99], [-1e307, 0.0]])
    got = topk._scores(topk._floored(x, 64), topk._floored(x, 64))
    want = [[sum(whole(a) * whole(b) for a, b in zip(u, v)) for v in x.tolist()] for u in x.tolist()]
    assert got.tolist() == want


def test_empty_tables(spark):
    assert run(spark, [], 5) == []
    assert run(spark, [(1, [1.0]), (2, [2.0])], 5) == []
    assert run(spark, [(0, [1.0])], 5) == []
    assert run(spark, [(0, []), (20, [])], 5) == [(0, 1, 20, 0), (20, 1, 0, 0)]
