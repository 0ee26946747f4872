"""Versions of a cache.

A cache's data files are never changed. Which of them are the cache is said by
its newest version, a small JSON file under ``versions/``::

    {"version": 7, "query_hash": ..., "schema": ...,
     "days":     {"2024-01-03": {"rows": 5, "sums": ["...", "..."]}, ...},
     "segments": [{"path": "_write=.../_day=2024-01-03", "days": ["2024-01-03"], "gone": []}, ...]}

A segment is a folder that one write made: the rows of a day, or of the days of
a month if the chart's days are small (``packed``). ``gone`` names the days of a
segment that later writes replaced. ``days`` holds an order-free digest of each
day's rows: their number and the sums of two hashes of each row. Digests of
parts of a day add up to the day's.

A version is committed by one rename that fails if the name is taken. So a
reader sees the cache before a write or after it, never between; a reader that
holds a version goes on reading its files; a writer that dies leaves files that
no version names, which ``clean_up`` removes; and of two writers that start from
the same version one is told to start again from the other's.
"""

from __future__ import annotations

import datetime as _dt
import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The name under which rows without a day are listed.
NO_DAY = ""
ATTEMPTS = 20


# ---------------------------------------------------------------- files

def hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    p = hadoop_path(spark, path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list:
    """(name, time of last change in ms) of what lies directly under a folder;
    none if there is no folder."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return []
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)]


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def rename_if_free(spark: SparkSession, source: str, to: str) -> bool:
    """One atomic rename; False if there is something at ``to`` already."""
    sc = spark.sparkContext
    options = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    none = sc._gateway.new_array(options, 1)
    none[0] = options.NONE
    target = hadoop_path(spark, to)
    files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), sc._jsc.hadoopConfiguration())
    try:
        files.rename(hadoop_path(spark, source), target, none)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            return False
        raise


# ---------------------------------------------------------------- versions

def _versions_path(chart: str) -> str:
    return f"{chart}/versions"


def versions(spark: SparkSession, chart: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    names = [n for n, _ in children(spark, _versions_path(chart))]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read_version(spark: SparkSession, chart: str, version: int | None = None) -> dict | None:
    """A version of the cache, the newest by default; None if there is none."""
    if version is None:
        known = versions(spark, chart)
        if not known:
            return None
        version = known[-1]
    return json.loads(read_text(spark, f"{_versions_path(chart)}/{version:010d}.json"))


def commit(spark: SparkSession, chart: str, change: Callable[[dict | None], dict | None]) -> dict | None:
    """Commit what ``change`` makes of the newest version (which it must not alter);
    None from it means that nothing is to be changed. If another writer commits
    first, ``change`` is asked again, with that writer's version."""
    for attempt in range(ATTEMPTS):
        base = read_version(spark, chart)
        wanted = change(base)
        if wanted is None:
            return base
        wanted = wanted | {"version": (base["version"] if base else 0) + 1}
        draft = f"{_versions_path(chart)}/_draft-{uuid.uuid4().hex}"
        write_text(spark, draft, json.dumps(wanted, sort_keys=True))
        if rename_if_free(spark, draft, f"{_versions_path(chart)}/{wanted['version']:010d}.json"):
            return wanted
        delete(spark, draft)
        time.sleep(0.05 * attempt)
    raise RuntimeError(f"{chart}: other writers kept committing first")


def empty_version(query_hash: str) -> dict:
    return {"query_hash": query_hash, "schema": None, "days": {}, "segments": []}


def clean_up(spark: SparkSession, chart: str, keep: int = 2, older_than: _dt.timedelta = _dt.timedelta(days=1)) -> list[str]:
    """Delete versions but the newest ``keep``, and data folders that none of the
    kept ones names. Folders changed within ``older_than`` stay: a write that is
    not committed yet may be making them. Returns what was deleted."""
    if keep < 1:
        raise ValueError("the newest version must be kept")
    known = versions(spark, chart)
    gone = [f"versions/{v:010d}.json" for v in known[:-keep]]
    for name in gone:
        delete(spark, f"{chart}/{name}")
    named = {s["path"] for v in known[-keep:] for s in read_version(spark, chart, v)["segments"]}
    writes = {p.split("/", 1)[0] for p in named}
    before = time.time() * 1000 - older_than.total_seconds() * 1000
    for write, changed in children(spark, f"{chart}/files"):
        if changed > before:
            continue
        if write not in writes:
            gone.append(f"files/{write}")
        else:
            gone += [f"files/{write}/{n}" for n, _ in children(spark, f"{chart}/files/{write}") if "=" in n and f"{write}/{n}" not in named]
    gone += [f"versions/{n}" for n, changed in children(spark, _versions_path(chart)) if n.startswith("_draft-") and changed <= before]
    for name in gone[len(known[:-keep]):]:
        delete(spark, f"{chart}/{name}")
    return gone


# ---------------------------------------------------------------- digests

def _row_hashes(columns: list[str]) -> tuple[Column, Column]:
    """Two hashes of a row; nulls count, so that a value in another column is
    another row."""
    parts = [p for c in sorted(columns) for p in (F.col(c), F.col(c).isNull())]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)


def day_digests(df: DataFrame, day: str) -> DataFrame:
    """(day, rows, sum1, sum2): the digest of each day's rows, whatever their order."""
    first, second = _row_hashes([c for c in df.columns if c != day])
    total = lambda h: F.sum(h.cast("decimal(38,0)")).cast("string")
    return df.groupBy(day).agg(F.count(F.lit(1)).alias("rows"), total(first).alias("sum1"), total(second).alias("sum2"))


def day_name(day: _dt.date | None) -> str:
    return NO_DAY if day is None else day.isoformat()


def _added(a: dict, b: dict) -> dict:
    return {"rows": a["rows"] + b["rows"], "sums": [str(int(x) + int(y)) for x, y in zip(a["sums"], b["sums"])]}


# ---------------------------------------------------------------- merging a write

def merged(base: dict, batch: dict[str, dict], segments: list[dict], replaced: Callable[[str], bool], keep_empty: bool) -> tuple[dict, dict[str, str]]:
    """The version after a write, and what became of each day.

    ``batch`` has the digests of the written days, ``segments`` where they lie,
    ``replaced`` says whether a day lies in a replaced window. A day of such a
    window is *unchanged* if its digest is as before (the old files stay),
    *restated*, or *new*; one that the write does not hold is *cleared*, or *kept*
    with ``keep_empty``. Other days are *new* or *appended* to. Rows without a day
    are only ever added.
    """
    days, states, dropped, unused = dict(base["days"]), {}, set(), set()
    for name in sorted(base["days"]):
        if name != NO_DAY and name not in batch and replaced(name):
            states[name] = "kept" if keep_empty else "cleared"
            if not keep_empty:
                dropped.add(name)
                del days[name]
    for name, digest in sorted(batch.items()):
        held = base["days"].get(name)
        if held is None:
            states[name], days[name] = "new", digest
        elif name == NO_DAY or not replaced(name):
            states[name], days[name] = "appended", _added(held, digest)
        elif held == digest:
            states[name] = "unchanged"
            unused.add(name)
        else:
            states[name], days[name] = "restated", digest
            dropped.add(name)
    kept = [_without(s, dropped) for s in base["segments"]] + [_without(s, unused) for s in segments]
    return base | {"days": days, "segments": [s for s in kept if s["days"]]}, states


def _without(segment: dict, days: set[str]) -> dict:
    gone = [d for d in segment["days"] if d in days]
    if not gone:
        return segment
    return segment | {"days": [d for d in segment["days"] if d not in days], "gone": sorted([*segment["gone"], *gone])}


def reads(segments: list[dict]) -> list[tuple[list[str], set[str]]]:
    """The segments as (paths, days to leave out) that can be read together: a
    read's left-out days are no day that another of its segments holds."""
    out: list[tuple[list[str], set[str], set[str]]] = []
    for s in segments:
        held, gone = set(s["days"]), set(s["gone"])
        for paths, left_out, all_held in out:
            if not (gone & all_held) and not (held & left_out):
                paths.append(s["path"])
                left_out |= gone
                all_held |= held
                break
        else:
            out.append(([s["path"]], gone, held))
    return [(paths, left_out) for paths, left_out, _ in out]


def day_states(spark: SparkSession, states: dict[str, str]) -> DataFrame:
    """(day, state) of a write's days; rows without a day have a null day."""
    rows = [(_dt.date.fromisoformat(n) if n else None, s) for n, s in sorted(states.items())]
    return spark.createDataFrame(rows, T.StructType([T.StructField("day", T.DateType()), T.StructField("state", T.StringType())]))
