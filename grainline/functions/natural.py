"""Number-aware ("natural") sort key as a native Spark expression (SRT-2).

A label is split into digit and non-digit chunks; digit chunks compare as
numbers, text chunks case-insensitively, and at the same position a digit
chunk sorts before a text chunk. So ``D2-D7 < D8-D14 < D15-D30`` and
``2 < 10``. The key is an ``array<struct<kind, len, txt>>``; Spark orders
arrays element-wise with a shorter prefix first, which is exactly the
chunk-list comparison, so no UDF is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    chunks = F.regexp_extract_all(c.cast("string"), F.lit(r"(\d+|\D+)"), 1)

    def chunk(p: Column) -> Column:
        is_num = p.rlike(r"^\d+$")
        digits = F.regexp_replace(p, "^0+", "")
        return F.struct(
            F.when(is_num, F.lit(0)).otherwise(F.lit(1)).alias("kind"),
            # digits compare by their number of digits, then digit by digit: any length
            F.when(is_num, F.length(digits)).otherwise(F.lit(0)).alias("len"),
            F.when(is_num, digits).otherwise(F.lower(p)).alias("txt"),
        )

    return F.transform(chunks, chunk)
