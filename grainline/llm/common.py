"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.session import shared_root

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the cluster's shared folder and read
    back: cuts the lineage and survives lost executors. The folder is named by
    a fresh id, so a repeated run never reads an earlier run's rows."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/grainline-llm/{uuid.uuid4().hex}/{name}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Appended:
    """A folder in the cluster's shared folder to which a loop appends what each
    round finds, so that the plan of the whole does not grow with the rounds.
    A round's rows appear once its job has ended, whole."""

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.schema = spark, schema
        self.path = f"{shared_root(spark)}/grainline-llm/{uuid.uuid4().hex}/{name}"
        spark.createDataFrame([], schema).write.option("compression", "zstd").parquet(self.path)

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").option("compression", "zstd").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def least_hashes(df: DataFrame, key: str, k: int, rows: int) -> DataFrame:
    """The ``k`` rows of least hash of ``key``, of about ``rows`` in all. Rows
    that cannot be among them, but for the odds of four times as many, go before
    the sort, so that partitions do not send ``k`` rows each to the driver. A
    sample: it may be smaller where few keys are repeated very often."""
    hashed = F.xxhash64(key)
    share = 4 * k / max(1, rows)
    if share < 1:
        df = df.filter(hashed < F.lit(int(-(2**63) + 2**64 * share)))
    return df.orderBy(hashed, *df.columns).limit(k)
