"""Exact substring dedup by merging Burrows-Wheeler transforms.

Every stretch of LENGTH bytes belongs to the least hash of the KEY-byte strings
in it; stretches that are equal share it. So the texts are cut, where that hash
changes, into segments, and only segments that share their hash with another
one are compared. Equal segments are counted. The different segments of a hash
meet in a bin, in shards: each shard brings its suffixes in the order of their
first bytes and the string before each (its Burrows-Wheeler transform, over
symbols of STEP bytes). The shards' interleave is then refined, a symbol at a
time: the order of the suffixes one symbol further left follows from the present
order by dealing it out stably by that symbol, without comparing suffixes again.
Neighbours keep a common prefix of that depth while both symbol and source block
agree. After depth LENGTH the blocks of two and more are the repeated intervals.
Where the different segments of one hash are too many for a bin, their windows
are counted by hashes of the whole window instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainline.llm.common import ceil_div, written
from grainline.llm.neardup import mix

LENGTH, KEY = 200, 80
FIRST, STEP = 8, 32  # FIRST + a multiple of STEP is LENGTH
BIN_BYTES, SHARD_BYTES, GROUP_BYTES = 1_500_000, 250_000, 4_000_000
PIECE_WINDOWS = 4_000_000
BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 2**64))


def gram_hashes(data: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every k-byte string, from hashes of half the length."""
    current = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed << 20))[data]
    size, out, done = 1, None, 0
    while True:
        if k & size:
            if out is None:
                out = current
            else:
                n = min(len(out), len(current) - done)
                out = out[:n] * _power(size) + current[done:done + n]
            done += size
        if done == k:
            return mix(out)
        current = current[:-size] * _power(size) + current[size:]
        size *= 2


def sliding(least, x: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[: len(x) - (width - size)], x[width - size:]) if width > size else x


def _pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) that hold each window of a text once; long texts in some."""
    windows = len(text) - length + 1
    for at in range(0, windows, PIECE_WINDOWS):
        yield at, text[at:min(windows, at + PIECE_WINDOWS) + length - 1]


def segments(text: bytes, length: int = LENGTH, key: int = KEY, seed: int = 0):
    """(hash, first window, windows, whether the hash stands there twice) of the
    runs of windows with the same least hash, for a text of ``length`` bytes or
    more. Only where it stands twice can a run repeat a window of its own."""
    grams = gram_hashes(np.frombuffer(text, np.uint8), key, seed)
    span = length - key + 1
    least = sliding(np.minimum, grams, span)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.concatenate([start, [len(least)]]))
    value = least[start]
    # the places whose hash is the least of some window
    rim = np.zeros(span - 1, np.uint64)
    place = np.flatnonzero(grams == sliding(np.maximum, np.concatenate([rim, least, rim]), span))
    known, which = np.unique(grams[place], return_inverse=True)
    twice = np.zeros(len(start), bool)
    if len(known) < len(place):
        at = np.sort(which * len(grams) + place)
        own = np.searchsorted(known, value) * len(grams)
        low, high = np.searchsorted(at, own + start), np.searchsorted(at, own + np.minimum(start + count + span - 1, len(grams)))
        twice = high - low > 1
    return value, start, count, twice


def repeated_windows(strings: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each string, whether the window at each place stands elsewhere in the
    strings, by merging the shards' transforms."""
    sizes = np.array([len(s) for s in strings], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(strings), np.uint8)
    n = len(data)
    left = np.repeat(begin + sizes, sizes) - np.arange(n)  # bytes to the string's end
    into = np.arange(n) - np.repeat(begin, sizes)
    wide = np.concatenate([data, np.zeros(FIRST, np.uint8)]).astype(np.uint64)
    first = np.zeros(n, np.uint64)
    for i in range(FIRST):
        first = first << np.uint64(8) | wide[i:i + n]
    # names of the STEP bytes at a place, from names of half as many
    name = np.unique(first, return_inverse=True)[1].astype(np.uint64)
    size = FIRST
    while size < STEP:
        further = np.concatenate([name[size:], np.zeros(size, np.uint64)])
        name = np.unique(name << np.uint64(32) | further, return_inverse=True)[1].astype(np.uint64)
        size *= 2
    # each shard: suffixes by their first bytes
    cuts = np.searchsorted(begin, np.arange(0, n, SHARD_BYTES))
    edges = np.unique(np.concatenate([begin[cuts[cuts < len(begin)]], [n]]))
    if not len(edges) or edges[0] != 0:
        edges = np.concatenate([[0], edges])
    runs = []
    for a, b in zip(edges[:-1], edges[1:]):
        own = a + np.flatnonzero(left[a:b] >= FIRST)
        runs.append(own[np.argsort(first[own], kind="stable")])
    order = np.concatenate(runs) if runs else np.zeros(0, np.int64)
    # the first interleave: a stable merge of the sorted runs
    order = order[np.argsort(first[order], kind="stable")]
    key = first[order]
    block = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)])) if len(order) else order
    depth = FIRST
    while depth < length and len(order):
        count = np.bincount(block)
        # settled suffixes, and those with no symbol before them, go
        stay = (count[block] > 1) & (into[order] >= STEP)
        order, block = order[stay] - STEP, block[stay]
        dealt = np.sort(name[order] << np.uint64(32) | np.arange(len(order), dtype=np.uint64))
        by = (dealt & np.uint64(0xFFFFFFFF)).astype(np.int64)
        symbol, order, block = dealt >> np.uint64(32), order[by], block[by]
        if len(order):
            new = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
            block = np.cumsum(np.concatenate([[0], new.astype(np.int64)]))
        depth += STEP
    marked = np.zeros(n, bool)
    if len(order):
        marked[order[np.bincount(block)[block] > 1]] = True
    return [marked[a:a + max(0, s - length + 1)] for a, s in zip(begin.tolist(), sizes.tolist())]


def _runs(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in edge.reshape(-1, 2)]


SEGMENT = "d long, t long, m long, s long, start int, n int, inner boolean"


def _cut(length: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            size = 0
            for d, t, text in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), batch.column("text")):
                for offset, piece in _pieces(text.as_py() or b"", length):
                    m, start, n, inner = segments(piece, length, key)
                    view = memoryview(piece)
                    s = np.fromiter((digest(view[a:a + k + length - 1]) for a, k in zip(start.tolist(), n.tolist())), np.uint64, len(m))
                    row = (np.full(len(m), d), np.full(len(m), t), m.view(np.int64), s.view(np.int64), start + offset, n, inner)
                    for column, x in zip(columns, row):
                        column.append(x)
                    size += len(m)
                    if size > 100_000:
                        yield _segment_batch(columns)
                        columns, size = [[] for _ in range(7)], 0
            if size:
                yield _segment_batch(columns)

    return run


def _segment_batch(columns) -> pa.RecordBatch:
    types = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, bool)
    arrays = [pa.array(np.concatenate(c).astype(t)) for c, t in zip(columns, types)]
    return pa.RecordBatch.from_arrays(arrays, ["d", "t", "m", "s", "start", "n", "inner"])


FETCHED = "m long, s long, large boolean, once boolean, piece binary"


def _fetch(length: int):
    """The bytes of chosen segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist()):
                raw = text.as_py()
                for w in wanted:
                    out.append((w["m"], w["s"], w["large"], w["once"], raw[w["start"]:w["start"] + w["n"] + length - 1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()))],
                ["m", "s", "large", "once", "piece"])

    return run


WINDOWS = "m long, s long, once boolean, at int, w long, v long"


def _windows(length: int):
    """Place and 128-bit hash of every window of the segments."""

    def hashed(held: list[tuple]) -> pa.RecordBatch:
        m, s, once, pieces = zip(*held)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        n = sizes - (length - 1)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = at + np.repeat(np.cumsum(sizes) - sizes, n)
        own = [np.repeat(np.array(x), n) for x in (m, s, once)]
        hashes = [gram_hashes(data, length, seed)[place].view(np.int64) for seed in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, at.astype(np.int32), *hashes)], ["m", "s", "once", "at", "w", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for m, s, once, piece in zip(*(batch.column(c).to_pylist() for c in ("m", "s", "once")), batch.column("piece")):
                held.append((m, s, once, piece.as_py()))
                size += len(held[-1][3])
                if size >= SHARD_BYTES:
                    yield hashed(held)
                    held, size = [], 0
        if held:
            yield hashed(held)

    return run


def _places_to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = []
        for places in batch.column("places"):
            at = np.unique(places.values.to_numpy())
            first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
            last = np.concatenate([first[1:], [len(at)]]) - 1
            runs.append([{"a": a, "b": b + 1} for a, b in zip(at[first].tolist(), at[last].tolist())])
        yield pa.RecordBatch.from_arrays(
            [batch.column("m"), batch.column("s"), pa.array(runs, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["m", "s", "runs"])


def counted_windows(pieces: DataFrame, length: int) -> DataFrame:
    """The repeated windows (m, s, runs) of segments that stand once, by counting
    all windows: only equal windows meet, and their counts are combined before
    they are shuffled. Rows that repeat a document bring its segments again; those
    do not stand once, and a window of theirs that does is in no other segment."""
    windows = pieces.select("m", "s", "once", "piece").mapInArrow(_windows(length), WINDOWS)
    often = windows.groupBy("w", "v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("w", "v")
    hits = windows.filter("once").join(written(often, "often"), ["w", "v"], "left_semi")
    return hits.groupBy("m", "s").agg(F.collect_list("at").alias("places")).mapInArrow(_places_to_runs, RUNS)


RUNS = "m long, s long, runs array<struct<a:int,b:int>>"


def _merge_bin(length: int):
    def run(table: pa.Table) -> pa.Table:
        # rows that repeat a document bring its pieces again
        pieces = dict(zip(zip(*(table.column(c).to_pylist() for c in ("m", "s"))), table.column("piece").to_pylist()))
        rows = [(m, s, _runs(mask)) for (m, s), mask in zip(pieces, repeated_windows(list(pieces.values()), length)) if mask.any()]
        return pa.table({
            "m": pa.array([r[0] for r in rows], pa.int64()), "s": pa.array([r[1] for r in rows], pa.int64()),
            "runs": pa.array([r[2] for r in rows], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))})

    return run


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans").to_pylist()):
                raw = text.as_py() or b""
                merged: list[list[int]] = []
                for x in sorted(spans or [], key=lambda x: x["a"]):
                    if merged and x["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["b"])
                    else:
                        merged.append([x["a"], x["b"]])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(raw[at:a])
                    at = b
                out.append((d, len(raw), sum(b - a for a, b in merged), [{"start": a, "end": b} for a, b in merged], b"".join([*kept, raw[at:]])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (
                    pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()))],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes, ``end``
    exclusive) and kept (the other bytes) of every document: a byte goes if a
    string of ``length`` bytes that covers it also starts anywhere else.

    Texts are UTF-8 bytes, matches never cross documents, and all copies go, the
    first included. Null and empty texts have no bytes; rows that repeat another
    row's text repeat all of it; a null doc_id is a document like others; an
    empty table gives no rows; other columns are not read.

    ``length`` less FIRST must be a multiple of STEP. Copies of a segment are
    counted before they are shuffled and stand for one in their bin; in a group
    of more than GROUP_BYTES of different segments windows are counted one by
    one, by 128-bit hashes, and do not meet in a bin.
    """
    if (length - FIRST) % STEP or key >= length:
        raise ValueError("length less FIRST must be a multiple of STEP, and key less than length")
    texts = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("d"),
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("t"), docs["text"].cast("binary").alias("text"))
    found = texts.select("d", "t", "text").mapInArrow(_cut(length, key), SEGMENT)
    distinct = found.groupBy("m", "s").agg(
        F.count(F.lit(1)).alias("copies"), F.max("inner").alias("inner"), F.max("n").alias("n"),
        F.min(F.struct("d", "t", "start")).alias("where"))
    # kinds counts ``where``, so that both uses of ``distinct`` read the same columns and share its shuffle
    hashes = distinct.groupBy("m").agg(
        F.sum("copies").alias("places"), F.count("where").alias("kinds"), F.sum(F.col("n") + (length - 1)).alias("size"), F.max("inner").alias("any_inner"))
    hashes = hashes.filter("places > 1 OR any_inner")
    shared = written(distinct.join(hashes.drop("any_inner"), "m"), "shared")

    compare = shared.filter("kinds > 1 OR inner")
    large = F.col("size") > GROUP_BYTES
    total, any_large = compare.agg(F.sum(F.when(~large, F.col("n") + (length - 1))), F.max(large)).first()
    wanted = compare.select("where.d", "where.t", F.struct(
        "where.start", "n", "m", "s", large.alias("large"), (F.col("copies") == 1).alias("once")).alias("w"))
    wanted = wanted.groupBy("d", "t").agg(F.collect_list("w").alias("wanted"))
    pieces = texts.select("d", "t", "text").join(wanted, ["d", "t"]).select("text", "wanted").mapInArrow(_fetch(length), FETCHED)
    if any_large:
        pieces = written(pieces, "pieces")
    bins = max(1, ceil_div(total or 0, BIN_BYTES))
    merged = pieces.filter("NOT large").select("m", "s", "piece", F.pmod(F.xxhash64("m"), F.lit(bins)).alias("bin"))
    merged = merged.groupBy("bin").applyInArrow(_merge_bin(length), RUNS)
    if any_large:
        merged = merged.unionByName(counted_windows(pieces.filter("large"), length))
    whole = shared.filter("copies > 1").select("m", "s", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("runs"))
    once = shared.filter("copies = 1").select("m", "s")
    runs = written(whole.unionByName(merged.join(once, ["m", "s"], "left_semi")), "runs")

    spans = found.select("d", "t", "m", "s", "start").join(runs, ["m", "s"]).select("d", "t", "start", F.explode("runs").alias("r"))
    spans = spans.groupBy("d", "t").agg(F.collect_set(F.struct(
        (F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b") + (length - 1)).alias("b"))).alias("spans"))
    return texts.join(spans, ["d", "t"], "left").select("doc_id", "text", "spans").mapInArrow(
        _removed(length), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
