"""Series shaping on served rows (SER-*, WIN-*, AGG-8/9, FLT-5/6, JOIN-3/4).

Served rows are reshaped into a long frame, one row per point::

    x, metric, combo, value        (+ the split dimension columns)

``combo`` labels a dimension combination (``US · ios``); a series is a
(metric, combo) pair. Everything stays long and lazy; the wide, one column per
series form is produced only at the sink (:func:`to_wide`).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import bucket_start
from ..functions.derived import combo_label
from ..functions.natural import natural_key
from ..functions.ordinal import ordinal

SERIES = ["metric", "combo"]
X = "x"

# The per-granularity period-over-period offsets (months, days).
DELTAS = {
    "day": {"short": (0, 1), "long": (0, 7)},
    "week": {"short": (0, 7), "long": (0, 28)},
    "month": {"short": (1, 0), "long": (12, 0)},
}


def to_series(rows: DataFrame, x_col: str, split_cols: list[str], metrics: list[str]) -> DataFrame:
    """SER-1: one series per metric x dimension combo; the x column is the axis."""
    split_cols = [c for c in split_cols if c != x_col]
    base = rows.select(
        F.col(x_col).alias(X),
        *[F.col(c) for c in split_cols],
        combo_label(split_cols).alias("combo"),
        *[F.col(m).cast("double").alias(m) for m in metrics],
    )
    return base.unpivot([X, *split_cols, "combo"], metrics, "metric", "value")


def hide_series(series: DataFrame, hidden_combos: list[str]) -> DataFrame:
    """FLT-6: drop hidden series before share/average so shares renormalize."""
    return series.where(~F.col("combo").isin(hidden_combos)) if hidden_combos else series


def clamp_to_window(series: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """FLT-5: keep only x values inside the picked window (date-typed axis)."""
    return series.where(F.col(X).between(F.lit(start), F.lit(end)))


def _interval(granularity: str) -> Column:
    return {"day": F.expr("INTERVAL 1 DAY"), "week": F.expr("INTERVAL 7 DAYS"), "month": F.expr("INTERVAL 1 MONTH")}[granularity]


def fill_gaps(series: DataFrame, start: _dt.date, end: _dt.date, granularity: str = "day") -> DataFrame:
    """SER-2 / JOIN-3: every bucket of [start, end] for every series, NULL where no data.

    The bucket spine is generated per series with ``sequence`` (its length is
    the window in buckets), then the points are LEFT JOINed onto it.
    """
    lo, hi = bucket_start(start, granularity), bucket_start(end, granularity)
    keys = series.select(*SERIES).distinct()
    spine = keys.select(*SERIES, F.explode(F.sequence(F.lit(lo), F.lit(hi), _interval(granularity))).alias(X))
    points = series.select(*SERIES, X, "value")
    return spine.join(points, [*SERIES, X], "left")


def fill_axis(series: DataFrame) -> DataFrame:
    """Every series at every x the rows hold (the union of their x values),
    NULL where a series has no point: the grid a dashboard widget draws.

    The axis is numbered once (distributed ordinal); each series expands to
    the positions 1..n with ``sequence`` and the positions are equi-joined to
    their x values, so no cross join is planned. The output is the grid itself.
    """
    axis = ordinal(series.select(X).distinct(), [F.col(X)], name="_pos")
    n = axis.agg(F.max("_pos")).scalar()  # the axis length, a scalar subquery
    keys = series.select(*SERIES).distinct()
    grid = keys.select(*SERIES, F.explode(F.sequence(F.lit(1), n)).alias("_pos")).join(axis, "_pos").drop("_pos")
    return grid.join(series.select(*SERIES, X, "value"), [*SERIES, X], "left")


def series_totals(series: DataFrame) -> DataFrame:
    """AGG-8: per (metric, combo) total, NULL counted as 0."""
    return series.groupBy(*SERIES).agg(F.sum(F.coalesce(F.col("value"), F.lit(0.0))).alias("total"))


def top_series(series: DataFrame, cap: int, by_metric: str | None = None) -> DataFrame:
    """WIN-3 / SRT-5: keep the ``cap`` biggest series.

    ``by_metric`` set (chart page): combos are ranked by that metric's total and
    every metric of a kept combo stays. Unset (dashboard widgets): each
    (metric, combo) series is ranked by its own total. Ties break by natural
    combo order. The top-k is a distributed ``orderBy().limit()``; the kept
    keys are joined back.
    """
    totals = series_totals(series)
    if by_metric is not None:
        ranked = totals.where(F.col("metric") == by_metric).select("combo", "total")
        keep = ranked.orderBy(F.col("total").desc(), natural_key(F.col("combo")), F.col("combo")).limit(cap).select("combo")
        return series.join(keep, "combo", "left_semi")
    keep = totals.orderBy(F.col("total").desc(), F.col("metric"), natural_key(F.col("combo")), F.col("combo")).limit(cap).select(*SERIES)
    return series.join(keep, SERIES, "left_semi")


def cap_series(series: DataFrame, cap: int, by_metric: str | None = None) -> tuple[DataFrame, DataFrame]:
    """SER-3: top series plus a one-row report (present, kept, dropped)."""
    kept = top_series(series, cap, by_metric)
    unit = F.col("combo") if by_metric is not None else F.concat_ws("\u0000", *SERIES)
    report = series.agg(F.countDistinct(unit).alias("present")).select(
        "present",
        F.least(F.col("present"), F.lit(cap)).alias("kept"),
        F.greatest(F.col("present") - F.lit(cap), F.lit(0)).alias("dropped"),
    )
    return kept, report


def order_series(series: DataFrame, value_order: str = "natural", metric_order: list[str] | None = None) -> DataFrame:
    """SRT-4: a ``series_rank`` for display - metric order first (dashboards),
    then natural combo order, or total descending for ``metric`` value order."""
    totals = series_totals(series)
    order = []
    if metric_order:
        order.append(F.array_position(F.array(*[F.lit(m) for m in metric_order]), F.col("metric")))
    if value_order == "metric":
        order.append(-F.col("total"))
    order += [natural_key(F.col("combo")), F.col("combo"), F.col("metric")]
    ranked = ordinal(totals, order, name="series_rank").select(*SERIES, "series_rank")
    return series.join(ranked, SERIES, "left")


def share_of_total(series: DataFrame) -> DataFrame:
    """WIN-2 / SER-4: value / (sum of the metric's series at x) x 100; 0 when the
    point is missing or the total is <= 0. Expects a complete grid (fill_gaps).

    Totals are an aggregate per (metric, x) joined back; AQE broadcasts them
    (one row per metric and bucket)."""
    totals = series.groupBy("metric", X).agg(F.sum(F.coalesce(F.col("value"), F.lit(0.0))).alias("_total"))
    share = F.when(F.col("value").isNotNull() & (F.col("_total") > 0), F.col("value") / F.col("_total") * 100).otherwise(F.lit(0.0))
    return series.join(totals, ["metric", X], "left").withColumn("value", share).drop("_total")


def moving_average(series: DataFrame, n: int) -> DataFrame:
    """WIN-1 / SER-5: trailing mean over the last ``n`` axis rows, NULLs skipped,
    NULL when the window holds no value. Partitioned by series: a window holds
    one series, whose length is the axis length."""
    w = Window.partitionBy(*SERIES).orderBy(X).rowsBetween(-(n - 1), 0)
    return series.withColumn("value", F.avg("value").over(w))


def _shift(x: Column, months: int, days: int) -> Column:
    out = x
    if months:
        out = F.add_months(out, months)
    if days:
        out = F.date_add(out, days)
    return out


def _pct(now: Column, then: Column) -> Column:
    raw = (now - then) / then * 100
    return F.when(now.isNotNull() & then.isNotNull() & (then != 0), F.floor(raw + 0.5).cast("bigint"))


def deltas(series: DataFrame, granularity: str = "day", keys: list[str] = SERIES) -> DataFrame:
    """SER-6 / JOIN-4: two period-over-period changes per point, each against the
    value at the *exact* earlier date (a gap gives NULL), as half-up rounded
    integer percents; NULL when either side is missing or the prior is 0."""
    cfg = DELTAS[granularity]
    out = series
    for label, (months, days) in cfg.items():
        prior = series.select(*keys, _shift(F.col(X), months, days).alias(X), F.col("value").alias(f"_{label}"))
        out = out.join(prior, [*keys, X], "left")
        out = out.withColumn(f"{label}_pct", _pct(F.col("value"), F.col(f"_{label}"))).drop(f"_{label}")
    return out


def point_total(series: DataFrame, units: dict[str, str | None] | None = None) -> DataFrame:
    """AGG-9: sum across series at each x, NULL only if all are NULL; only when
    at least two series share one unit (else no rows)."""
    if units is not None and len(set(units.values())) > 1:
        return series.sparkSession.createDataFrame([], series.select(X).schema.add("value", "double"))
    n = series.agg(F.countDistinct(*SERIES)).scalar()  # number of series, a scalar subquery
    return series.groupBy(X).agg(F.sum("value").alias("value")).where(n >= 2)


def total_deltas(series: DataFrame, granularity: str = "day", units=None) -> DataFrame:
    """SER-7: SER-6 on the point totals."""
    return deltas(point_total(series, units), granularity, keys=[])


def guard_combos(cache: DataFrame, split_cols: list[str], limit: int, selected: dict[str, int] | None = None,
                 exact: bool = True) -> DataFrame:
    """SER-8: one row (combos, allowed): the product over split dims of each dim's
    value count (its selected count when 0 < selected < all) against ``limit``."""
    selected = selected or {}
    agg = F.countDistinct if exact else F.approx_count_distinct
    counts = cache.agg(*[agg(F.col(c)).alias(f"_c{i}") for i, c in enumerate(split_cols)]) if split_cols else None
    if counts is None:
        return cache.sparkSession.range(1).select(F.lit(1).cast("long").alias("combos"), F.lit(True).alias("allowed"))
    prod = F.lit(1).cast("long")
    for i, c in enumerate(split_cols):
        cnt = F.col(f"_c{i}").cast("long")
        k = selected.get(c, 0)
        eff = F.when((F.lit(k) > 0) & (F.lit(k) < cnt), F.lit(k).cast("long")).otherwise(cnt)
        prod = prod * F.greatest(eff, F.lit(1).cast("long"))
    return counts.select(prod.alias("combos")).withColumn("allowed", F.col("combos") <= limit)


def axis_is_date(cache: DataFrame, col: str) -> DataFrame:
    """SER-9: one row - are all non-empty values of the axis column ISO dates."""
    dtype = cache.schema[col].dataType
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return cache.agg((F.count(col) > 0).alias("is_date"))
    s = F.col(col).cast("string")
    nonempty = F.col(col).isNotNull() & (s != "")
    return cache.agg(
        ((F.count_if(nonempty) > 0) & (F.count_if(nonempty & ~s.rlike(r"^\d{4}-\d{2}-\d{2}")) == 0)).alias("is_date")
    )


def to_wide(series: DataFrame, labels: list[str], multi_metric: bool = True,
            x_name: str = "date") -> DataFrame:
    """The sink form: the x column plus one column per series, labelled as the
    chart labels them - the combo alone when one metric is plotted,
    ``metric · combo`` when several are, the metric name without a split.

    ``labels`` names the columns: the labels of the series to write.
    """
    label = F.when(F.col("combo") == "", F.col("metric"))
    label = label.otherwise(F.concat_ws(" · ", "metric", "combo") if multi_metric else F.col("combo"))
    s = series.withColumn("_label", label)
    return s.groupBy(F.col(X).alias(x_name)).pivot("_label", labels).agg(F.first("value")).orderBy(x_name)


def view_transforms(series: DataFrame, hidden_combos: list[str] | None = None, percent: bool = False,
                    ma_window: int | None = None, ordered_axis: bool = True) -> DataFrame:
    """The chart's display transforms in their order: hidden series are dropped
    first (FLT-6), then share of total (SER-4), then the moving average (SER-5).
    Both transforms need an ordered axis (time, or a date pivot); on a
    categorical axis they are skipped and only the hiding applies."""
    out = hide_series(series, hidden_combos or [])
    if ordered_axis:
        if percent:
            out = share_of_total(out)
        if ma_window:
            out = moving_average(out, ma_window)
    return out
