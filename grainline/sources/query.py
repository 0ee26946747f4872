"""Run a chart's source query for a window (SRC-1) and probe its schema (SRC-4).

The query is Spark SQL over whatever tables or views the session knows
(parquet/Delta/JDBC-backed views registered by the caller). Nothing here
collects rows: the result is a lazy DataFrame that the refresh writes.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..spec import ChartSpec
from .template import bind_template, window_args

_TRAILING_LIMIT = re.compile(r"\s+LIMIT\s+\d+(\s+OFFSET\s+\d+)?\s*$", re.IGNORECASE)


def source_query(spark: SparkSession, spec: ChartSpec, start: _dt.date, end: _dt.date) -> DataFrame:
    text = bind_template(spec.query, spec.variables, start, end).rstrip().rstrip(";")
    args = window_args(text, start, end)
    return spark.sql(text, args=args) if args else spark.sql(text)


def probe_schema(spark: SparkSession, spec: ChartSpec, sample: _dt.date | None = None) -> T.StructType:
    """Column names and types without running a job: Spark analyses the plan only."""
    day = sample or _dt.date(2000, 1, 1)
    text = bind_template(spec.query, spec.variables, day, day).rstrip().rstrip(";").rstrip()
    text = _TRAILING_LIMIT.sub("", text)
    args = window_args(text, day, day)
    df = spark.sql(text, args=args) if args else spark.sql(text)
    return df.schema
