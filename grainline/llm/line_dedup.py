"""Repeated line runs by a suffix array over line-ID sequences.

Every document is a sequence of line ids. Suffixes are ranked by prefix
doubling: a rank for the first 2^j lines, joined with the rank 2^j lines on,
gives the rank for 2^(j+1). Suffixes of equal rank are an interval of the suffix
array whose longest common prefix reaches that depth. In every such interval
the suffix that comes first in the corpus is the original; the lines the others
share with it are later copies. Overlapping copies merge to maximal runs, which
are cut out of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainline.llm.common import Appended, written

#: A run counts if it has MIN_LINES lines, or holds a line of MIN_CHARS characters.
MIN_LINES, MIN_CHARS = 2, 24
#: Blank lines belong to the line before them.
LINE_BREAK = r"\n(?=[ \t\r]*[^ \t\r\n])"
BLANKS = " \t\r\n"
NO_ID = -(2**63)


def lines_of(text: Column) -> Column:
    """A text's lines; joined by newlines they are the text again."""
    return F.split(text, LINE_BREAK)


def _place(df: DataFrame, doc: str, text: str) -> DataFrame:
    """The document's key: its id, and a hash of its text for rows that share
    an id."""
    return df.withColumn("__d", F.coalesce(F.col(doc).cast("long"), F.lit(NO_ID))).withColumn(
        "__t", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def _long_bytes(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c), 16, "0"))


def _positions(docs: DataFrame, min_chars: int) -> DataFrame:
    """Lines that occur more than once: document key (d, t), place in the
    document (seq), lines of the document (n), id (h), whether it is long."""
    lines = docs.select(
        F.col("__d").alias("d"), F.col("__t").alias("t"), F.size("__lines").alias("n"), F.posexplode("__lines").alias("seq", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).filter("line != ''")
    lines = lines.select(
        "d", "t", "n", "seq", F.unhex(F.md5(F.col("line").cast("binary"))).alias("h"),
        (F.char_length("line") >= min_chars).alias("long"))
    lines = written(lines, "lines")
    often = lines.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    return lines.join(often, "h", "left_semi").dropDuplicates(["d", "t", "seq"])


def _later(ranked: DataFrame, depth: int, counts: Column) -> DataFrame:
    """(d, t, seq, length) of the suffixes that are not the first of their
    interval, for those of which ``counts`` holds."""
    place = F.struct("d", "t", "seq")
    first = ranked.groupBy("h", "off").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    length = F.least(F.lit(depth), F.col("n") - F.col("seq"))
    return ranked.join(first.drop("c"), ["h", "off"]).filter((place != F.col("first")) & counts).select(
        "d", "t", "seq", length.alias("length"))


def _doubled(ranks: DataFrame, step: int) -> DataFrame:
    """Ranks for twice the depth. Settled suffixes keep theirs.

    A rank is the line id and the number of suffixes that begin with that line
    and come before. Siblings in an interval are ordered by buckets of their
    second part, then by it: counts are combined before they are shuffled, and
    running totals go over the buckets of an interval and over the parts of a
    bucket, so an interval with a third of all suffixes is many small windows.
    """
    on = ranks.select("d", "t", F.col("seq").alias("s2"), F.col("h").alias("h2"), F.col("off").alias("off2"))
    live = ranks.filter("live").withColumn("s2", F.col("seq") + step).join(on, ["d", "t", "s2"], "left")
    alone = F.unhex(F.md5(F.concat_ws(",", "d", "t", "s2").cast("binary")))  # a line that occurs once
    second = (
        F.when(F.col("s2") >= F.col("n"), F.unhex(F.lit("00")))
        .when(F.col("h2").isNull(), F.concat(F.unhex(F.lit("02")), alone))
        .otherwise(F.concat(F.unhex(F.lit("01")), F.col("h2"), _long_bytes(F.col("off2"))))
    )
    live = written(live.select("d", "t", "seq", "n", "h", "off", second.alias("second")), "seconds")
    bucket = F.concat(F.substring("second", 1, 3), F.substring("second", 18, 6))
    parts = live.groupBy("h", "off", "second").agg(F.count(F.lit(1)).alias("size")).withColumn("bucket", bucket)
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = parts.groupBy("h", "off", "bucket").agg(F.sum("size").alias("m"))
    buckets = buckets.withColumn("ahead", before(Window.partitionBy("h", "off").orderBy("bucket"), "m")).drop("m")
    inside = before(Window.partitionBy("h", "off", "bucket").orderBy("second"), "size")
    parts = parts.withColumn("inside", inside).join(buckets, ["h", "off", "bucket"]).select(
        "h", "off", "second", "size", (F.col("off") + F.col("ahead") + F.col("inside")).alias("new"))
    moved = live.join(parts, ["h", "off", "second"]).select(
        "d", "t", "seq", "n", "h", F.col("new").alias("off"),
        ((F.col("size") > 1) & (F.col("second") != F.unhex(F.lit("00")))).alias("live"), (F.col("size") > 1).alias("shared"))
    still = ranks.filter("NOT live").select("d", "t", "seq", "n", "h", "off", "live", F.lit(False).alias("shared"))
    return written(moved.unionByName(still), "ranks")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """Maximal runs (d, t, start, end) of lines that are later copies; ``docs``
    has the document key and ``__lines``."""
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    lines = written(_positions(docs, min_chars), "repeated")
    start = lines.select("d", "t", "seq", "n", "h", F.lit(0).cast("long").alias("off"), "long")
    # each round's copies are written as they are found, so that no plan grows with the rounds
    found = Appended(docs.sparkSession, "copies", "d long, t long, seq int, length int")
    found.add(_later(start, 1, F.lit(min_lines <= 1) | F.col("long")))
    ranks = start.withColumn("live", F.lit(True)).drop("long")
    depth = 1
    while not ranks.filter("live").isEmpty():
        ranks = _doubled(ranks, depth)
        depth *= 2
        if depth >= min_lines:
            found.add(_later(ranks.filter("shared"), depth, F.col("n") - F.col("seq") >= min_lines))
    copies = found.read()
    copies = copies.groupBy("d", "t", "seq").agg(F.max(F.col("seq") + F.col("length")).alias("end"))
    doc = Window.partitionBy("d", "t").orderBy("seq")
    reach = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("seq") > reach, F.lit(True)).cast("int")
    runs = copies.withColumn("opens", opens).withColumn("run", F.sum("opens").over(doc))
    return runs.groupBy("d", "t", "run").agg(F.min("seq").alias("start"), F.max("end").alias("end")).drop("run")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without its repeated line runs, and
    n_lines, n_removed, n_runs, removed (the runs as line numbers from 0, ``end``
    exclusive).

    Lines are equal if they are without white space at their ends. Of lines that
    repeat, the copy in the smallest doc_id (then by a hash of the text, then by
    line) stays. A run is a copy if it has ``min_lines`` (a power of two) lines
    or a line of ``min_chars`` characters. Blank lines are no lines of their own and
    go with the line before. Null texts stay null with no lines; empty texts
    have one, blank; rows that repeat id and text are one document and all get
    its result; a null doc_id counts as the smallest; an empty table gives no
    rows. Columns whose names clash with the outputs are replaced.
    """
    keyed = _place(docs.drop("n_lines", "n_removed", "n_runs", "removed"), doc, text).withColumn("__lines", lines_of(F.col(text)))
    runs = repeated_runs(keyed.select("__d", "__t", "__lines").filter("__lines IS NOT NULL"), min_lines, min_chars)
    per_doc = runs.groupBy(F.col("d").alias("__d"), F.col("t").alias("__t")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    out = keyed.join(per_doc, ["__d", "__t"], "left")
    covered = lambda i: F.exists("removed", lambda r: (i >= r["start"]) & (i < r["end"]))
    kept = F.array_join(F.filter("__lines", lambda x, i: ~covered(i)), "\n")
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + (r["end"] - r["start"]))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.select(
        *[F.when(F.col("removed").isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(c)
          for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs", "removed")],
        F.coalesce(F.greatest(F.size("__lines"), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.greatest(F.size("removed"), F.lit(0)), F.lit(0)).cast("long").alias("n_runs"),
        F.coalesce("removed", none).alias("removed"),
    )
