"""Derived dimensions (DRV-1, DRV-3) and combo labels (SCL-2).

A derived dimension is computed at scan time from its source column, so a
changed bucket map applies to every cached row on the next read without
rewriting the cache (DRV-2).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import ChartSpec, DerivedDim, Dim

# The marker shown for a NULL dimension value and the combo separator.
NULL_LABEL = "∅"
COMBO_SEP = " · "


def derive_bucket(d: DerivedDim, col: Column | None = None) -> Column:
    """``CASE WHEN upper(trim(src)) IN (...) THEN bucket ... ELSE default END``."""
    src = F.upper(F.trim(col if col is not None else F.col(d.source_column)))
    expr = None
    for bucket, values in d.buckets:
        folded = [str(v).strip().upper() for v in values]
        cond = src.isin(folded)
        expr = F.when(cond, F.lit(bucket)) if expr is None else expr.when(cond, F.lit(bucket))
    if expr is None:
        return F.lit(d.default)
    return expr.otherwise(F.lit(d.default))


def applicable_derived(spec: ChartSpec, columns: Iterable[str]) -> list[DerivedDim]:
    """Derived dims that no declared dim shadows and that the cache can carry:
    their source column is present (computed here) or the column itself is."""
    cols = set(columns)
    declared = {d.name for d in spec.dims}
    return [
        d for d in spec.derived
        if d.name not in declared and (d.source_column in cols or d.name in cols)
    ]


def effective_dims(spec: ChartSpec, columns: Iterable[str]) -> list[Dim]:
    """Declared dims plus the applicable derived ones (DRV-3)."""
    extra = [
        Dim(name=d.name, column=d.name, value_order="natural", derived=True)
        for d in applicable_derived(spec, columns)
    ]
    return list(spec.dims) + extra


def with_derived(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """Add the applicable derived dimension columns to a cache frame (DRV-1).

    The bucket is recomputed from the source column whenever that column is
    present, so an undeclared column of the same name is replaced.
    """
    adds = {
        d.name: derive_bucket(d)
        for d in applicable_derived(spec, df.columns)
        if d.source_column in df.columns
    }
    return df.withColumns(adds) if adds else df


def combo_label(cols: list[str], null_label: str = NULL_LABEL) -> Column:
    """Series label: dim values joined by `` · ``, NULL shown as a marker (SCL-2)."""
    if not cols:
        return F.lit("")
    return F.concat_ws(COMBO_SEP, *[F.coalesce(F.col(c).cast("string"), F.lit(null_label)) for c in cols])
