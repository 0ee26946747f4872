"""AGG-6: the cohort view - a pivot on one dimension (e.g. install date) split
by another (e.g. days since install), widened to one column per split value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import ChartSpec, DataRequest
from .serve import resolve, serve_plan


def cohort_rows(spec: ChartSpec, req: DataRequest, cache: DataFrame, metric: str) -> tuple[DataFrame, str, str]:
    """The cohort view in long form, for any number of split values: the served
    rows (x-axis = a dimension, exactly one split dimension) with the split as
    text, and the names of the two columns."""
    plan = resolve(spec, req, cache.columns)
    if plan.x_axis is None or len(plan.requested_dims) != 2:
        raise ValueError("cohort_view needs an x-axis dimension and exactly one split dimension")
    x_col, split_col = plan.col(plan.requested_dims[0]), plan.col(plan.requested_dims[1])
    rows = serve_plan(plan, cache, ordered=False).withColumn(split_col, F.col(split_col).cast("string"))
    return rows.select(x_col, split_col, metric), x_col, split_col


def cohort_view(spec: ChartSpec, req: DataRequest, cache: DataFrame, metric: str, split_values: list[str]) -> DataFrame:
    """The wide form: one column for each of the wanted ``split_values``."""
    rows, x_col, split_col = cohort_rows(spec, req, cache, metric)
    wide = rows.groupBy(x_col).pivot(split_col, split_values).agg(F.first(metric))
    return wide.orderBy(F.col(x_col).asc_nulls_last())
