"""Chart, dimension, metric and request definitions.

These are plain driver-side configuration objects: nothing here touches data.
A chart's *cache* is a DataFrame with one row per (day x every dimension);
everything that reads it takes a :class:`ChartSpec` to know which columns are
dimensions, which are metrics and which dimensions each metric ignores.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field, replace

# The time granularities a request may ask for.
GRANULARITIES = ("day", "week", "month")


@dataclass(frozen=True)
class Dim:
    """A dimension. ``name`` is the API handle, ``column`` what rows carry."""

    name: str
    column: str | None = None
    value_order: str = "natural"  # "natural" | "metric"
    included: bool = True
    derived: bool = False

    @property
    def col(self) -> str:
        return self.column or self.name


@dataclass(frozen=True)
class Metric:
    """A base metric (``column``) xor a formula metric (``formula``)."""

    name: str
    column: str | None = None
    formula: str | None = None
    independent_of: tuple[str, ...] = ()
    decimals: int = 0
    unit: str | None = None
    included: bool = True

    def __post_init__(self):
        if bool(self.column) == bool(self.formula):
            raise ValueError(
                f"metric '{self.name}': set exactly one of column (base metric) "
                "or formula (derived metric)"
            )
        object.__setattr__(self, "independent_of", tuple(self.independent_of))

    @property
    def is_formula(self) -> bool:
        return bool(self.formula)


@dataclass(frozen=True)
class DerivedDim:
    """A dimension computed from a source column by a value -> bucket map."""

    name: str
    source_column: str
    buckets: tuple[tuple[str, tuple[str, ...]], ...]
    default: str


# The one derived dimension of the reference, its bucket list and default.
COUNTRY_TIER = DerivedDim(
    name="country_tier",
    source_column="country",
    buckets=(
        (
            "Tier-1",
            (
                "US", "GB", "UK", "AU", "CA",
                "United States", "United Kingdom", "Australia", "Canada",
            ),
        ),
    ),
    default="Tier-2",
)

DEFAULT_DERIVED: tuple[DerivedDim, ...] = (COUNTRY_TIER,)


@dataclass(frozen=True)
class ChartSpec:
    name: str
    query: str
    time_column: str | None
    dims: tuple[Dim, ...] = ()
    metrics: tuple[Metric, ...] = ()
    variables: dict = field(default_factory=dict, hash=False, compare=True)
    x_axis: str | None = None
    # The chart defaults (strategy, backfill days, batch size,
    # default range, end offset).
    cur_date_behavior: str = "daily"  # "daily" | "batched"
    cache_strategy: str = "append"  # "append" | "replace"
    default_backpop_days: int = 7
    backpop_batch_size: int = 30
    default_date_range_days: int = 90
    default_end_offset_days: int = 2
    derived: tuple[DerivedDim, ...] = DEFAULT_DERIVED
    refresh_interval: str = "daily"  # "daily" | "manual": whether the nightly run takes it
    # Opt-in: each output day depends only on that day's input, so consecutive
    # daily windows may be fetched as one range query instead of a union of days.
    day_separable: bool = False
    # Opt-in: the cache is known to hold one row per (day, all dims), so a
    # signature whose grain is every dim can skip the inner MAX step.
    unique_grain: bool = False
    # Opt-in: a day is a small part of a file, so a write of many days puts
    # those of a month into one folder.
    small_days: bool = False
    # Opt-in: the roll-ups ("week", "month") that each refresh brings up to date.
    rollups: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "dims", tuple(self.dims))
        object.__setattr__(self, "metrics", tuple(self.metrics))
        object.__setattr__(self, "rollups", tuple(self.rollups))
        dim_names = {d.name for d in self.dims}
        for m in self.metrics:
            for ind in m.independent_of:
                if ind not in dim_names and ind not in {d.name for d in self.derived}:
                    raise ValueError(
                        f"metric '{m.name}': independent_of references unknown dimension '{ind}'"
                    )
        if self.cur_date_behavior not in ("daily", "batched"):
            raise ValueError(f"unknown cur_date_behavior '{self.cur_date_behavior}'")

    def metric(self, name: str) -> Metric:
        for m in self.metrics:
            if m.name == name:
                return m
        raise ValueError(f"unknown metric '{name}'")

    @property
    def base_metrics(self) -> tuple[Metric, ...]:
        return tuple(m for m in self.metrics if not m.is_formula)

    @property
    def metric_columns(self) -> set[str]:
        return {m.column for m in self.metrics if m.column}

    def with_(self, **kw) -> "ChartSpec":
        return replace(self, **kw)


@dataclass(frozen=True)
class DataRequest:
    """A slice of a chart. ``dimensions=None`` means all effective dims,
    ``metrics=None`` all metrics (hidden ones too), ``[]`` time only."""

    from_date: _dt.date | None = None
    to_date: _dt.date | None = None
    granularity: str = "day"
    x_axis: str | None = None
    dimensions: tuple[str, ...] | None = None
    metrics: tuple[str, ...] | None = None
    filters: dict = field(default_factory=dict, hash=False)
    hide_zero: bool = False

    def __post_init__(self):
        if self.from_date and self.to_date and self.from_date > self.to_date:
            raise ValueError("from_date must be on or before to_date")
        if self.dimensions is not None:
            object.__setattr__(self, "dimensions", tuple(self.dimensions))
        if self.metrics is not None:
            object.__setattr__(self, "metrics", tuple(self.metrics))
