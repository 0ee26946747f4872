"""A chart as its page shows it: one call from the cache to the drawn series."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import series as SR
from ..operators.serve import default_axis, resolve, serve_plan
from ..spec import ChartSpec, DataRequest


@dataclass(frozen=True)
class ViewOptions:
    """What the viewer picked. ``cap`` is how many combos are drawn; the axis is
    the chart's saved one unless the request names another (``time_axis`` asks
    for time)."""

    cap: int
    time_axis: bool = False
    hidden: tuple[str, ...] = ()
    percent: bool = False
    moving_average: int | None = None
    value_order: str = "natural"


def chart_view(spec: ChartSpec, req: DataRequest, cache: DataFrame, options: ViewOptions) -> tuple[DataFrame, DataFrame]:
    """The series of a chart in their order, and the report (present, kept,
    dropped) of the combos.

    The request is served on its axis; a dimension filtered by an empty
    selection shows no rows. Date axes are clamped to the picked window, and a
    time axis is filled over it; then the largest combos by the first metric
    are kept, ranked, and hiding, share and moving average applied."""
    axis = None if options.time_axis else req.x_axis or default_axis(spec)
    plan = resolve(spec, replace(req, x_axis=axis), cache.columns)
    rows = serve_plan(plan, cache, ordered=False)
    if any(not v for v in req.filters.values()):
        rows = rows.limit(0)
    x = spec.time_column if plan.x_axis is None else plan.col(plan.x_axis)
    split = [plan.col(d) for d in plan.requested_dims if plan.col(d) != x]
    series = SR.to_series(rows, x, split, plan.requested_metrics)
    is_date = series.schema[SR.X].dataType.typeName() == "date"
    window = (req.from_date, req.to_date) if req.from_date and req.to_date else None
    if is_date and window:
        series = SR.clamp_to_window(series, *window) if plan.x_axis else SR.fill_gaps(series, *window, req.granularity)
    kept, report = SR.cap_series(series, options.cap, by_metric=plan.requested_metrics[0])
    shown = SR.view_transforms(kept, list(options.hidden), options.percent, options.moving_average, ordered_axis=is_date)
    ranked = SR.order_series(shown, options.value_order, list(plan.requested_metrics))
    return ranked.select("metric", "combo", SR.X, "value", F.col("series_rank")), report
