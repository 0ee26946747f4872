"""Sharding by a Hilbert curve over document metadata.

Several metadata dimensions are quantised to a small grid, the grid cells are
ordered along a Hilbert curve, and the rows in that order are cut into runs of
equal length. Rows that are near in every dimension land in the same shard, so
minimum and maximum of each dimension prune files for filters on any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainline.llm.common import ceil_div

PREFIX_BYTES = 6
ROWS_PER_RUN = 5_000


def hilbert_index(point: list[int], bits: int) -> int:
    """Position of a grid point along the Hilbert curve with ``bits`` bits a
    dimension (Skilling's transpose form)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    index = 0
    for b in reversed(range(bits)):
        for v in x:
            index = index << 1 | ((v ^ t) >> b) & 1
    return index


def curve_table(dims: int, bits: int) -> list[int]:
    """Curve index of every grid cell, by the cell's row-major number."""
    side = 1 << bits
    return [
        hilbert_index([(cell >> (bits * (dims - 1 - d))) % side for d in range(dims)], bits)
        for cell in range(1 << (bits * dims))
    ]


def text_key(c: Column) -> Column:
    """The first bytes of a string as a number; keeps the strings' byte order.
    Null counts as the empty string."""
    head = F.hex(F.substring(F.coalesce(c, F.lit("")).cast("binary"), 1, PREFIX_BYTES))
    return F.conv(F.rpad(head, 2 * PREFIX_BYTES, "0"), 16, 10).cast("long")


def magnitude_key(c: Column) -> Column:
    """Number of binary digits of a count; equal steps are equal ratios."""
    return F.length(F.bin(F.coalesce(c.cast("long"), F.lit(0)))).cast("long")


def hilbert_cells(df: DataFrame, dims: list[Column], bits: int = 4, out: str = "cell") -> tuple[DataFrame, int]:
    """``df`` with column ``out``, each row's place along the curve, and the
    number of rows. ``dims`` are long columns; each is spread linearly over its
    own minimum and maximum (null: the minimum). At most 16 bits in all, so
    the curve is a literal table of at most 65,536 entries."""
    if not 0 < bits * len(dims) <= 16:
        raise ValueError("bits times dimensions must lie between 1 and 16")
    names = [f"__dim{i}" for i in range(len(dims))]
    keyed = df.withColumns(dict(zip(names, dims)))
    bounds = keyed.agg(
        F.count(F.lit(1)).alias("n"), *[f(n).alias(f"{f.__name__}{n}") for n in names for f in (F.min, F.max)]
    ).first()
    side = 1 << bits
    cell = F.lit(0).cast("long")
    for n in names:
        low, high = bounds[f"min{n}"] or 0, bounds[f"max{n}"] or 0
        step = F.floor((F.coalesce(F.col(n), F.lit(low)) - F.lit(low)) / F.lit(float(high - low + 1)) * side)
        cell = cell * side + F.least(step, F.lit(side - 1))
    curve = F.lit(curve_table(len(dims), bits))
    return keyed.withColumn(out, F.element_at(curve, (cell + 1).cast("int")).cast("long")).drop(*names), bounds["n"]


def cut_runs(df: DataFrame, n_rows: int, shards: int, cell: str = "cell", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Number the rows along (cell, rest) and cut the order into ``shards``
    runs whose lengths differ by one at most: columns ``shard`` and ``slot``
    (place inside the shard, from 0).

    A cell is dealt to buckets by the hash of ``order``, so a cell with a third
    of all rows is still many small windows; bucket counts are combined before
    they are shuffled. Running totals are taken over the buckets of a cell, then
    over the cells, of which there are as many as the grid has. Rows equal in
    ``order`` are numbered by the other columns; wholly equal rows are
    interchangeable.
    """
    runs = max(1, ceil_div(n_rows, ROWS_PER_RUN))
    df = df.withColumn("__run", F.pmod(F.xxhash64(*order), F.lit(runs)))
    counts = df.groupBy(cell, "__run").agg(F.count(F.lit(1)).alias("__n"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_cell = counts.withColumn("__in", before(Window.partitionBy(cell).orderBy("__run"), "__n"))
    cells = counts.groupBy(cell).agg(F.sum("__n").alias("__n"))
    cells = cells.select(cell, before(Window.orderBy(cell), "__n").alias("__before"))
    starts = in_cell.join(cells, cell).select(cell, "__run", (F.col("__in") + F.col("__before")).alias("__start"))
    rest = [c for c in df.columns if c not in (cell, "__run", *order)]
    within = Window.partitionBy(cell, "__run").orderBy(*order, *rest)
    ranked = df.withColumn("__rank", F.row_number().over(within) - 1).join(starts, [cell, "__run"])
    at = F.col("__start") + F.col("__rank")
    n = F.lit(max(1, n_rows))
    shard = F.expr(f"(__start + __rank) * {shards} div {max(1, n_rows)}")
    first = F.expr(f"(__shard * {max(1, n_rows)} + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("__shard", shard)
        .withColumn("slot", (at - first).cast("long"))
        .withColumn("shard", F.col("__shard").cast("int"))
        .drop("__run", "__rank", "__start", "__shard")
    )


def shard_documents(docs: DataFrame, shards: int = 40, bits: int = 4) -> DataFrame:
    """Every document's shard by a Hilbert curve over language, source and text
    size: doc_id, size (UTF-8 bytes of the text plus 16; null text counts none),
    text_crc32 (of the empty text where it is null), law ``rows``, shard, slot,
    grown_shard (null: this law has none).

    Null language or source counts as empty; a null doc_id sorts first; repeated
    rows get a slot each; an empty table gives no rows; other columns of ``docs``
    are not read. Shards hold equal counts of rows, at most one apart.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        text_key(F.col("lang")).alias("__lang"),
        text_key(F.col("source")).alias("__source"),
    )
    dims = [F.col("__lang"), F.col("__source"), magnitude_key(F.col("size"))]
    celled, n = hilbert_cells(rows, dims, bits)
    out = cut_runs(celled.drop("__lang", "__source"), n, shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "cell",
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write whole documents as one folder a shard, files in curve order.

    ``doc_id`` must be unique in ``docs``. A shard is cut into files of
    ``rows_per_file`` rows, each written by a task of its own.
    """
    keys = assigned.select("doc_id", "shard", "slot", F.expr(f"slot div {rows_per_file}").alias("__file"))
    both = docs.join(keys, "doc_id")
    (both.repartition("shard", "__file").sortWithinPartitions("shard", "__file", "slot")
     .drop("__file").write.partitionBy("shard").parquet(path))
