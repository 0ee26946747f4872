"""grainline: chart metrics on Spark.

Refresh date-templated source queries into partitioned daily caches, and
serve them sliced by date range, granularity, filters and splits, with each
metric aggregated at its own grain.
"""

from .spec import ChartSpec, DataRequest, DerivedDim, Dim, Metric
from .operators.serve import serve

__all__ = ["ChartSpec", "DataRequest", "DerivedDim", "Dim", "Metric", "serve"]
