"""Dimension value lists (SRT-3), per-value totals (AGG-7) and the union of
value lists across a dashboard's charts (SET-1).

Outputs are long frames ``(dimension, value, position)``; ``value`` is the
value rendered as text so dimensions of different types share one column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.derived import effective_dims
from ..functions.natural import natural_key
from ..functions.ordinal import ordinal
from ..operators.serve import DAY, prepare_base
from ..spec import ChartSpec


def _date_filtered(spec: ChartSpec, cache: DataFrame, from_date=None, to_date=None) -> DataFrame:
    base = prepare_base(spec, cache)
    if from_date:
        base = base.where(F.col(DAY) >= F.lit(from_date))
    if to_date:
        base = base.where(F.col(DAY) <= F.lit(to_date))
    return base


def order_metric(spec: ChartSpec):
    """The first base metric in display order: drives ``metric`` value order."""
    return next((m for m in spec.metrics if m.column), None)


def _as_number(base: DataFrame, column: str):
    """A metric column as DOUBLE; text that is no number is NULL."""
    c = F.col(column)
    return c.cast("double") if isinstance(base.schema[column].dataType, T.NumericType) else c.cast("string").try_cast("double")


def dim_totals(spec: ChartSpec, cache: DataFrame, dim: str, from_date=None, to_date=None) -> DataFrame:
    """AGG-7: plain SUM of the order metric per value of ``dim`` (text -> NULL).

    Not de-duplicated for independent metrics: it only ranks values.
    """
    d = {x.name: x for x in effective_dims(spec, cache.columns)}[dim]
    m = order_metric(spec)
    base = _date_filtered(spec, cache, from_date, to_date)
    return base.groupBy(F.col(d.col).alias("value")).agg(F.sum(_as_number(base, m.column)).alias("total"))


def _value_totals(spec: ChartSpec, cache: DataFrame, eff, from_date=None, to_date=None) -> DataFrame:
    """One scan: every row exploded into its (dimension, value) pairs, then one
    aggregate (map-side partial) giving each value its order-metric total and
    its value in its own type (one of vn / vd / vs is set per dimension)."""
    base = _date_filtered(spec, cache, from_date, to_date)
    m = order_metric(spec)
    metric = _as_number(base, m.column) if m is not None else F.lit(None).cast("double")
    pairs = []
    for d in eff:
        v, dtype = F.col(d.col), base.schema[d.col].dataType
        numeric = isinstance(dtype, T.NumericType)
        temporal = isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))
        pairs.append(F.struct(
            F.lit(d.name).alias("dimension"),
            v.cast("string").alias("value"),
            (v.cast("double") if numeric else F.lit(None).cast("double")).alias("vn"),
            (v.cast("timestamp_ntz") if temporal else F.lit(None).cast("timestamp_ntz")).alias("vd"),
            (F.lit(None).cast("string") if numeric or temporal else v.cast("string")).alias("vs"),
        ))
    exploded = base.select(F.explode(F.array(*pairs)).alias("p"), metric.alias("_m")).select("p.*", "_m")
    return exploded.where(F.col("value").isNotNull()).groupBy("dimension", "value", "vn", "vd", "vs").agg(
        F.sum("_m").alias("_tot")
    )


def _order_key(metric_dims: list[str]):
    """Sort key of a value inside its dimension: total descending (NULL last)
    for ``metric`` dims, the natural key otherwise; ties by the typed value."""
    is_metric = F.col("dimension").isin(metric_dims) if metric_dims else F.lit(False)
    return F.struct(
        F.when(is_metric, F.col("_tot").isNull()).alias("n"),
        F.when(is_metric, -F.col("_tot")).alias("t"),
        F.when(~is_metric, natural_key(F.col("value"))).alias("k"),
        "vn", "vd", "vs",
    )


def dim_values(spec: ChartSpec, cache: DataFrame, from_date=None, to_date=None, dims=None) -> DataFrame:
    """SRT-3: distinct non-NULL values per dimension, positioned in the dim's own order.

    ``natural``: number-aware label order. ``metric``: order-metric total
    descending, NULL totals last, ties by value. The date bounds narrow the
    values; the extent (:func:`date_extent`) always covers the whole cache.

    One scan and one aggregate (:func:`_value_totals`), then one distributed
    ordinal numbers the values of every dimension.
    """
    eff = [d for d in effective_dims(spec, cache.columns) if dims is None or d.name in dims]
    if not eff:
        return cache.sparkSession.createDataFrame([], "dimension string, value string, position int")
    totals = _value_totals(spec, cache, eff, from_date, to_date)
    metric_dims = [d.name for d in eff if d.value_order == "metric"] if order_metric(spec) is not None else []
    return ordinal(totals, [_order_key(metric_dims)], group=["dimension"]).select("dimension", "value", "position")


def date_extent(spec: ChartSpec, cache: DataFrame) -> DataFrame:
    """The whole cache's MIN/MAX day, whatever the requested range (T18)."""
    base = prepare_base(spec, cache)
    return base.agg(F.min(DAY).alias("date_min"), F.max(DAY).alias("date_max"))


def filter_values(charts: list[tuple[ChartSpec, DataFrame]], wanted: list[str]) -> DataFrame:
    """SET-1: per wanted dim, the union of values across the distinct charts that
    have it. ``natural`` dims are re-sorted over the union; ``metric`` dims keep
    first-seen order (chart order, then each chart's own ranking).

    A value's first-seen place is the smallest (chart index, that chart's sort
    key) over the charts holding it, so one aggregate and one ordinal suffice.
    The first chart carrying a dimension decides its value order.
    """
    order_of: dict[str, str] = {}
    parts = []
    for i, (spec, cache) in enumerate(charts):
        have = {d.name: d for d in effective_dims(spec, cache.columns)}
        eff = [have[w] for w in wanted if w in have]
        if not eff:
            continue
        for d in eff:
            order_of.setdefault(d.name, d.value_order if order_metric(spec) is not None else "natural")
        chart_metric_dims = [d.name for d in eff if d.value_order == "metric"] if order_metric(spec) is not None else []
        totals = _value_totals(spec, cache, eff)
        parts.append(totals.select("dimension", "value", F.struct(F.lit(i).alias("c"), _order_key(chart_metric_dims).alias("o")).alias("_seen")))
    if not parts:
        raise ValueError("no chart carries any of the wanted dimensions")
    allv = parts[0]
    for p in parts[1:]:
        allv = allv.unionByName(p)
    first = allv.groupBy("dimension", "value").agg(F.min("_seen").alias("_first"))
    metric_dims = [d for d, o in order_of.items() if o == "metric"]
    is_metric = F.col("dimension").isin(metric_dims) if metric_dims else F.lit(False)
    key = F.struct(
        F.when(is_metric, F.col("_first")).alias("f"),
        F.when(~is_metric, natural_key(F.col("value"))).alias("k"),
        F.col("value").alias("v"),
    )
    return ordinal(first, [key], group=["dimension"]).select("dimension", "value", "position")
