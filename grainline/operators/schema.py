"""Column roles from a schema (SCH-1), read without running a job."""

from __future__ import annotations

from pyspark.sql import types as T

# Numeric columns that are identifiers, matched case-insensitively.
NUMERIC_DIMENSION_NAMES = {"game_id", "platform"}


def _kind(field: T.StructField) -> str:
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    number = isinstance(field.dataType, T.NumericType) and field.name.lower() not in NUMERIC_DIMENSION_NAMES
    return "metric" if number else "dimension"


def classify_columns(schema: T.StructType) -> tuple[str | None, list[str], list[str]]:
    """The time column, dimensions and metrics of a schema: the first date or
    timestamp is the time, numbers that are no identifiers are metrics, the rest
    are dimensions."""
    names: dict[str, list[str]] = {"time": [], "dimension": [], "metric": []}
    for field in schema.fields:
        kind = _kind(field)
        names["dimension" if kind == "time" and names["time"] else kind].append(field.name)
    return next(iter(names["time"]), None), names["dimension"], names["metric"]
