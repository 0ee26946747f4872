"""1-based position of each row in a sort order, per group, without gathering
a group into one task.

Bounds are picked once from a bounded sample of the sort keys; a row's bucket
is the number of bounds not above its key, so buckets follow the order for any
bounds. Rows are numbered inside (group, bucket), and the counts of the buckets
before are added, joined on the values (group, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets a frame is cut into, and sampled keys for each bound.
BUCKETS, SAMPLES = 64, 16


def _bounds(keyed: DataFrame, buckets: int) -> Column:
    """An array literal of sort keys that cut a sample into even parts."""
    key_type = keyed.schema["_key"].dataType
    sample = keyed.select("_key").orderBy(F.xxhash64("_key")).limit(buckets * SAMPLES)
    keys = F.sort_array(F.collect_list("_key"))
    text = sample.agg(F.to_json(F.filter(keys, lambda _, i: i % SAMPLES == SAMPLES - 1))).first()[0]
    return F.from_json(F.lit(text or "[]"), T.ArrayType(key_type))


def ordinal(df: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "position",
            buckets: int = BUCKETS) -> DataFrame:
    """``df`` with column ``name``: the row's place in the ascending order of
    ``order`` within its ``group``. Rows with equal keys are numbered in no
    particular order; every row is kept."""
    group = list(group or [])
    keyed = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    bounds = _bounds(keyed, buckets)
    keyed = keyed.withColumn("_bucket", F.size(F.filter(bounds, lambda b: b <= F.col("_key"))))
    inside = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy("_key"))
    counts = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = keyed.withColumn("_in", inside)
    same = numbered["_bucket"] == starts["_b"]
    for g in group:
        same = same & numbered[g].eqNullSafe(starts[f"_g_{g}"])
    return numbered.join(starts, same).select(*df.columns, (F.col("_start") + F.col("_in")).cast("int").alias(name))
