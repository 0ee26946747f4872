"""Reconciliation of large results: the rows of the plain one, by digests."""

import random

import pytest

from grainline.operators import audit as A

SCHEMA = "k bigint, region string, n bigint, x double"


def table(n, seed=1):
    rng = random.Random(seed)
    return [(i if i % 97 else None, f"r{i}" if i % 5 or not i % 97 else None, rng.choice([None, i % 7]), rng.choice([None, 0.0, -1.5, rng.gauss(0, 1) * 10.0 ** rng.randrange(-9, 9)]))
            for i in range(n)]


def both(spark, a, b, **kw):
    a, b = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    return a, b, (["k", "region"], ["n", "x"])


def same(spark, a, b):
    a, b, names = both(spark, a, b)
    found = sorted(map(str, A.reconcile_large(a, b, *names).collect()))
    assert found == sorted(map(str, A.reconcile(a, b, *names).collect()))
    return found


def test_equal_results_are_not_joined(spark):
    a, b, names = both(spark, table(2000), table(2000)[::-1])
    out = A.reconcile_large(a, b.repartition(7), *names)
    assert out.count() == 0
    assert "ExistingRDD" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", [A.FEW_ROWS, 3])
def test_planted_differences_are_all_found(spark, monkeypatch, few):
    monkeypatch.setattr(A, "FEW_ROWS", few)  # 3: down through the levels
    a = table(3000)
    b = [r[:3] + ((r[3] * (1 + 1e-9)) if r[3] else r[3],) for r in a]
    b[10], b[20], b[30] = b[10][:2] + (99, b[10][3]), b[20][:3] + (123.0,), b[30][:3] + (float("nan"),)
    b[40] = b[40][:3] + (float("inf"),)
    del b[50]
    b.append((10_000, "new", 1, 1.0))
    assert len(same(spark, a, b)) == 6


def test_all_rows_differ_and_more_buckets_than_the_driver_may_hold(spark, monkeypatch):
    a = table(1500)
    b = [r[:2] + ((r[2] or 0) + 100,) + r[3:] for r in a]
    assert len(same(spark, a, b)) == 1500
    monkeypatch.setattr(A, "MOST_BUCKETS", 10)
    assert len(same(spark, a, b)) == 1500


def test_repeated_rows_empty_sides_and_other_types(spark):
    a = table(50)
    assert same(spark, a, a + a[:1]) == []  # the plain one pairs a repeated row with its like
    assert len(same(spark, a, [])) == 50 and len(same(spark, [], a)) == 50 and same(spark, [], []) == []
    left, right, names = both(spark, a, a)
    assert A.reconcile_large(left, right.selectExpr("CAST(k AS INT) k", "region", "CAST(n AS SMALLINT) n", "x"), *names).count() == 0
    for bad in (dict(keys=[], metrics=["n"]), dict(keys=["k"], metrics=["n"], rel_tol=0)):
        with pytest.raises(ValueError):
            A.reconcile_large(left, right, **bad)


def test_values_of_one_cell_are_within_the_tolerance(spark):
    rng = random.Random(3)
    rows = [(x, x * (1 + rng.uniform(-3e-6, 3e-6))) for x in (rng.choice([-1, 1]) * 10 ** rng.uniform(-30, 30) for _ in range(5000))]
    df = spark.createDataFrame(rows, "x double, y double")
    in_cell = df.where(A._cell(df.x, 1e-6) == A._cell(df.y, 1e-6))
    assert 0 < in_cell.count() < 5000
    assert in_cell.where("abs(x - y) > 1e-6 * greatest(abs(x), abs(y))").count() == 0
