"""Result audits (DQ-1, DQ-2, JOIN-5)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.derived import effective_dims
from ..operators.serve import DAY, prepare_base
from ..spec import ChartSpec

#: Bits of the key hash that name a bucket, level by level, of ``reconcile_large``.
LEVEL_BITS = (12, 20, 28, 36)
#: Buckets that the driver holds and sends to every task (8 bytes each).
MOST_BUCKETS = 65_536
#: So few rows of a side are joined without looking closer.
FEW_ROWS = 1_000_000


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str], rel_tol: float = 1e-6) -> DataFrame:
    """DQ-1 / JOIN-5: rows that differ between two results.

    Full outer join on NULL-safe keys; a row is reported when it is on one side
    only, or a metric differs (NULL = NULL, NaN = NaN): whole numbers at all, others
    by more than ``rel_tol`` relative, or if only one of them is finite.
    An empty result means equal row sets and values. ``keys`` must name the
    columns that identify a row (a keyless join would pair every row).
    """
    if not keys:
        raise ValueError("reconcile needs the key columns that identify a row")
    la = a.select(*keys, *[F.col(m).alias(f"a_{m}") for m in metrics]).withColumn("_in_a", F.lit(True))
    rb = b.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[F.col(m).alias(f"b_{m}") for m in metrics]).withColumn("_in_b", F.lit(True))
    cond = None
    for k in keys:
        c = la[k].eqNullSafe(rb[f"_b_{k}"])
        cond = c if cond is None else cond & c
    j = la.join(rb, on=cond, how="full_outer")
    bad = ~(F.coalesce(F.col("_in_a"), F.lit(False)) & F.coalesce(F.col("_in_b"), F.lit(False)))
    for m in metrics:
        x, y = F.col(f"a_{m}"), F.col(f"b_{m}")
        xd, yd = x.cast("double"), y.cast("double")
        largest = F.greatest(F.abs(xd), F.abs(yd), F.lit(1e-12))
        near = F.when(xd == yd, F.lit(False)).when(F.isnan(largest) | (largest == math.inf), F.lit(True))
        apart = x != y if _whole(a, b, m) else near.otherwise(F.abs(xd - yd) > F.lit(rel_tol) * largest)
        differ = F.when(x.isNull() & y.isNull(), F.lit(False)).when(x.isNull() | y.isNull(), F.lit(True)).otherwise(apart)
        bad = bad | differ
    out = j.where(bad)
    return out.select(
        *[F.coalesce(F.col(k), F.col(f"_b_{k}")).alias(k) for k in keys],
        F.coalesce(F.col("_in_a"), F.lit(False)).alias("in_a"),
        F.coalesce(F.col("_in_b"), F.lit(False)).alias("in_b"),
        *[F.col(c).cast("double").alias(c) for m in metrics for c in (f"a_{m}", f"b_{m}")],
    )


def _whole(a: DataFrame, b: DataFrame, column: str) -> bool:
    return all(isinstance(f.schema[column].dataType, T.IntegralType) for f in (a, b))


def _cell(c: Column, rel_tol: float) -> Column:
    """A number that two doubles share only if they are within ``rel_tol``: the place
    of the double's size on a grid of half that width, with its sign."""
    x = c.cast("double")
    size = F.floor(F.log(F.abs(x)) / F.lit(math.log1p(rel_tol / 2)))
    special = F.isnan(x) | (F.abs(x) == math.inf) | (x == 0)
    return F.struct(F.when(special, x + F.lit(0.0)), F.when(~special, size), F.signum(F.when(~special, x)))


def reconcile_large(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str], rel_tol: float = 1e-6) -> DataFrame:
    """``reconcile`` of two large stored results that are mostly equal: its rows,
    without joining what is the same.

    Rows are dealt to buckets by a hash of their keys. A bucket has an order-free
    digest on each side: its row count and the sums of two hashes of keys and
    values (doubles by cells of half the tolerance, so that values with one digest
    are within it). Only buckets whose digests differ are looked into, by 256
    smaller ones each, until few rows are left, a level leaves more than half of
    the rows before it, or more buckets differ than the driver may hold. The rows
    left are joined. Equal inputs shuffle digests only.

    Each level reads both inputs again. Values that are near but in two cells
    make their bucket differ; the join then finds them equal.
    """
    if not keys:
        raise ValueError("reconcile needs the key columns that identify a row")
    if rel_tol <= 0:
        raise ValueError("rel_tol must be above 0")
    spark = a.sparkSession

    def value(c: str) -> Column:
        return F.col(c).cast("bigint") if _whole(a, b, c) else F.col(c)

    def hashed(df: DataFrame) -> DataFrame:
        by_key = [p for k in keys for p in (value(k), F.col(k).isNull())]
        by_value = [p for m in metrics for p in (value(m) if _whole(a, b, m) else _cell(F.col(m), rel_tol), F.col(m).isNull())]
        return df.select(*keys, *metrics, F.xxhash64(*by_key).alias("_hash")).withColumns(
            {f"_sum{i}": F.xxhash64(F.lit(i), *by_key, *by_value) for i in (1, 2)})

    def bucket(bits: int) -> Column:
        return F.shiftrightunsigned("_hash", 64 - bits)

    def digests(df: DataFrame, bits: int, side: str) -> DataFrame:
        total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
        return df.groupBy(bucket(bits).alias("bucket")).agg(
            F.count(F.lit(1)).alias("rows"), F.struct(F.count(F.lit(1)), total("_sum1"), total("_sum2")).alias("digest")).withColumn("side", F.lit(side))

    sides, rows_before = [hashed(a), hashed(b)], None
    left = sides
    for bits in LEVEL_BITS:
        both = digests(left[0], bits, "a").unionByName(digests(left[1], bits, "b")).groupBy("bucket").agg(
            F.sum("rows").alias("rows"), F.max(F.when(F.col("side") == "a", F.col("digest"))).alias("da"), F.max(F.when(F.col("side") == "b", F.col("digest"))).alias("db"))
        found = both.where(~F.col("da").eqNullSafe(F.col("db"))).select("bucket", "rows").limit(MOST_BUCKETS + 1).collect()
        if not found:
            return reconcile(*[spark.createDataFrame([], f.select(*keys, *metrics).schema) for f in (a, b)], keys, metrics, rel_tol)
        if len(found) > MOST_BUCKETS:
            break
        differ = F.broadcast(spark.createDataFrame([(r["bucket"],) for r in found], "_bucket bigint"))
        left = [s.join(differ, bucket(bits) == F.col("_bucket"), "left_semi") for s in sides]
        rows = sum(r["rows"] for r in found)
        if rows <= FEW_ROWS or rows_before is not None and 2 * rows > rows_before:
            break
        rows_before = rows
    return reconcile(*[s.select(*keys, *metrics) for s in left], keys, metrics, rel_tol)


def audit_independence(spec: ChartSpec, cache: DataFrame) -> DataFrame:
    """DQ-2: for every metric declared independent of some dims, the (day, grain)
    groups whose rows disagree - more than one distinct value, or a NULL and
    non-NULL mix. Such a declaration is false and MAX would hide it."""
    base = prepare_base(spec, cache)
    dims = effective_dims(spec, cache.columns)
    by_grain: dict[tuple, list] = {}
    for m in spec.metrics:
        if not m.is_formula and m.independent_of:
            grain = tuple(d.col for d in dims if d.name not in set(m.independent_of))
            by_grain.setdefault(grain, []).append(m)
    parts = []
    for grain, metrics in by_grain.items():  # one scan for all metrics of a grain
        g = base.groupBy(DAY, *grain).agg(
            F.count(F.lit(1)).alias("rows"),
            *[f(F.col(m.column)).alias(f"{n}_{i}") for i, m in enumerate(metrics)
              for n, f in (("lo", F.min), ("hi", F.max), ("none", lambda c: F.count_if(c.isNull())))],
        )
        key = F.to_json(F.struct(*[F.col(c) for c in grain])) if grain else F.lit("{}")
        found = F.array(*[
            F.struct(
                F.lit(m.name).alias("metric"), F.col(f"none_{i}").alias("nulls"),
                F.col(f"lo_{i}").cast("double").alias("min_value"), F.col(f"hi_{i}").cast("double").alias("max_value"),
                ((F.col(f"lo_{i}") != F.col(f"hi_{i}")) | ((F.col(f"none_{i}") > 0) & (F.col(f"none_{i}") < F.col("rows")))).alias("bad"),
            ) for i, m in enumerate(metrics)
        ])
        each = g.select(F.col(DAY).alias("day"), key.alias("grain"), "rows", F.explode(found).alias("f")).where("f.bad")
        parts.append(each.select("f.metric", "day", "grain", "rows", "f.nulls", "f.min_value", "f.max_value"))
    if not parts:
        return cache.sparkSession.createDataFrame(
            [], "metric string, day date, grain string, rows bigint, nulls bigint, min_value double, max_value double"
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_unique_grain(spec: ChartSpec, cache: DataFrame) -> DataFrame:
    """The precondition of serving (T1) and of ``ChartSpec.unique_grain``:
    (day, every dimension) groups that hold more than one row."""
    base = prepare_base(spec, cache)
    cols = [d.col for d in effective_dims(spec, cache.columns)]
    return base.groupBy(F.col(DAY).alias("day"), *cols).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
