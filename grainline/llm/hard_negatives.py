"""Hard negatives by rotated one-bit codes.

A vector is rotated and kept as the signs of its components: a code, which is a
unit vector, with the vector's alignment to it (their inner product). What the
code leaves over is coded in turn under another rotation, a few levels deep,
and the length of the last rest is kept. Against an anchor the codes' inner
products are popcounts with the bit planes of the rotated, finely quantised
anchor; alignments times those are an estimate of the score, and by
Cauchy-Schwarz the rests bound its error. Only candidates whose interval can
hold a wanted score are scored, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainline.llm.common import Appended, ceil_div, written

#: Anchors that go over the index together (they are broadcast, so many at most
#: and so many bytes), rows they meet at a time, and pairs scored at a time.
ANCHOR_BLOCK, BLOCK_BYTES, ROW_BLOCK, PAIRS = 1024, 8 << 20, 1024, 1 << 16
#: With one level hardly any pair of 64-dimensional vectors can be ruled out for certain, with four nine in ten.
LEVELS, PLANES, SEED = 4, 6, 12
WORD = 64
LONG = 2**63 - 1
#: Relative error allowed for floating point in the bounds.
SLACK = 1e-9


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as whole doubles; null where a
    component is null or not finite (times ``scale``)."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")), F.lit(False)))
    # floor of a double of 2^53 and more is that double, and does not go through long
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    return F.when(fine, F.transform(vector, lambda x: whole(x.cast("double") * scale)))


def rotations(width: int, levels: int = LEVELS, seed: int = SEED) -> np.ndarray:
    """Random rotations of a space of ``width`` dimensions, one a level."""
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(levels)])


def _words(signs: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    packed = np.packbits(signs, axis=-1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)


class Codes:
    """The codes of some vectors: words (n, levels, words), alignments
    (n, levels), length of the vector and of the last rest."""

    def __init__(self, words, alignments, norm, rest):
        self.words, self.alignments, self.norm, self.rest = words, alignments, norm, rest

    @classmethod
    def of(cls, x: np.ndarray, turns: np.ndarray) -> Codes:
        levels, width = turns.shape[:2]
        rest, words, alignments = x.astype(np.float64), [], []
        for turn in turns:
            z = rest @ turn.T
            signs = z >= 0
            words.append(_words(signs))
            alignments.append(np.abs(z).sum(axis=1) / np.sqrt(width))
            rest = (z - alignments[-1][:, None] * np.where(signs, 1, -1) / np.sqrt(width)) @ turn
        return cls(np.stack(words, axis=1), np.stack(alignments, axis=1), _norm(x), _norm(rest))


def _norm(x: np.ndarray) -> np.ndarray:
    """Lengths; components are scaled so that squares stay finite."""
    x = x.astype(np.float64)
    most = np.maximum(np.abs(x).max(axis=1, initial=0), 1e-300)
    return np.sqrt(((x / most[:, None]) ** 2).sum(axis=1)) * most


class Anchors:
    """Anchors as bit planes of their rotated components: component i is about
    low + step * (the number in the planes)."""

    def __init__(self, x: np.ndarray, turns: np.ndarray):
        width = turns.shape[1]
        turned = np.einsum("lij,aj->ali", turns, x.astype(np.float64))
        self.low = turned.min(axis=2)
        spread = turned.max(axis=2) - self.low
        self.step = np.where(spread > 0, spread / (2**PLANES - 1), 1.0)
        number = np.rint((turned - self.low[:, :, None]) / self.step[:, :, None]).astype(np.uint64)
        self.planes = np.stack([_words((number >> np.uint64(j)) & np.uint64(1)) for j in range(PLANES)], axis=2)  # anchor, level, plane, word
        self.sum = number.sum(axis=2).astype(np.float64)
        self.off = np.stack([_norm(e) for e in np.moveaxis(turned - self.low[:, :, None] - self.step[:, :, None] * number, 1, 0)], axis=1)
        self.norm, self.width = _norm(x), width

    def interval(self, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Bounds (anchors, rows) of the inner products."""
        root = np.sqrt(self.width)
        shape = (len(self.norm), len(codes.norm))
        estimate, error = np.zeros(shape), np.zeros(shape)
        ones = np.bitwise_count(codes.words).sum(axis=2).astype(np.float64)
        for level in range(codes.words.shape[1]):
            hit = np.zeros(shape)
            for j in range(PLANES):
                for w in range(codes.words.shape[2]):
                    both = np.bitwise_count(codes.words[None, :, level, w] & self.planes[:, level, j, w, None])
                    hit += both * float(2**j)
            # sum over i of sign_i * (low + step * number_i), signs being 2 * bit - 1
            inner = self.low[:, level, None] * (2 * ones[None, :, level] - self.width) + self.step[:, level, None] * (2 * hit - self.sum[:, level, None])
            estimate += codes.alignments[None, :, level] * inner / root
            error += codes.alignments[None, :, level] * self.off[:, level, None]
        error += codes.rest[None, :] * self.norm[:, None]
        error += SLACK * codes.norm[None, :] * self.norm[:, None] + SLACK
        # beyond the range of doubles nothing is known
        return np.nan_to_num(estimate - error, nan=-np.inf, neginf=-np.inf), np.nan_to_num(estimate + error, nan=np.inf, posinf=np.inf)


def _scores(anchors: np.ndarray, rows: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the pairs (a, r)."""
    parts = [_products(anchors[a[i:i + PAIRS]], rows[r[i:i + PAIRS]]) for i in range(0, len(a), PAIRS)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of paired rows of whole doubles; beyond long
    they count as its nearest value."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return np.einsum("ij,ij->i", a, x).astype(np.int64)
    whole = [sum(int(p) * int(q) for p, q in zip(u, v)) for u, v in zip(a, x)]
    return np.array([min(max(s, -LONG), LONG) for s in whole], np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix, short vectors filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
INDEX = "row long, vec_id long, label long, x array<double>, words binary, alignments array<double>, norm double, rest double"


def _indexer(width: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = rotations(ceil_div(width, WORD) * WORD, levels)
        for batch in batches:
            codes = Codes.of(_matrix(batch.column("x"), turns.shape[1]), turns)
            flat = codes.alignments.ravel()
            offsets = np.arange(len(codes.norm) + 1) * levels
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([w.tobytes() for w in codes.words], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(codes.norm), pa.array(codes.rest)],
                [*batch.schema.names, "words", "alignments", "norm", "rest"])

    return run


def _rows(batch: pa.RecordBatch, width: int, levels: int):
    """(row, vec_id, label, vectors, codes) of a batch of the index."""
    numbers = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    words = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint64).reshape(batch.num_rows, levels, -1)
    alignments = batch.column("alignments").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, levels)
    return numbers("row"), numbers("vec_id"), numbers("label"), _matrix(batch.column("x"), width), Codes(words, alignments, numbers("norm"), numbers("rest"))


def _first(key: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of each key's ``k`` highest scores, ties to the smaller id."""
    order = np.lexsort((vec_id, -score, key))
    sorted_key = key[order]
    begin = np.searchsorted(sorted_key, sorted_key, "left")
    return order[np.arange(len(order)) - begin < k]


def _setup(shipped, width: int, levels: int):
    """The broadcast anchors as planes, made once a worker."""
    held = shipped.value
    if "anchors" not in held:
        held["anchors"] = Anchors(held["x"], rotations(ceil_div(width, WORD) * WORD, levels))
    return held, held["anchors"]


def _positives(shipped, width: int, levels: int, k: int):
    """Each anchor's best ``k`` rows of its label among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, anchors = _setup(shipped, width, levels)
        x, own, labels = held["x"], held["row"], held["label"]
        best = [np.zeros(0, np.int64)] * 3  # anchor, score, id
        floor = np.full(len(own), -np.inf)  # the kth score so far
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                row, vec_id, label, rows, codes = _rows(batch.slice(at, ROW_BLOCK), x.shape[1], levels)
                low, high = anchors.interval(codes)
                other = (labels[:, None] == label[None, :]) & (own[:, None] != row[None, :])
                low[~other] = -np.inf
                kth = np.partition(low, -k, axis=1)[:, -k] if len(row) >= k else np.full(len(own), -np.inf)
                a, r = np.nonzero(other & (high >= np.maximum(kth, floor)[:, None]))
                found = [a, _scores(x, rows, a, r), vec_id[r]]
                best = [np.concatenate(p) for p in zip(best, found)]
                keep = _first(best[0], best[1], best[2], k)
                best = [p[keep] for p in best]
                full = np.bincount(best[0], minlength=len(own)) >= k
                least = np.full(len(own), np.inf)
                np.minimum.at(least, best[0], best[1].astype(np.float64))
                least[~full] = 0
                floor = np.where(full, least - np.abs(least) * SLACK - 1, -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(held["row"][best[0]]), pa.array(best[2]), pa.array(best[1])], ["anchor", "positive_id", "positive_score"])

    return run


def _negatives(shipped, width: int, levels: int, k: int):
    """For each of an anchor's bands of scores, the best ``k`` rows of other
    labels in it among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, anchors = _setup(shipped, width, levels)
        x, labels, owner, lowest, highest = (held[c] for c in ("x", "label", "owner", "lowest", "highest"))
        best = [np.zeros(0, np.int64)] * 3  # band, score, id
        floor = lowest.astype(np.float64)
        ceiling = np.where(highest < LONG, highest.astype(np.float64), np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                row, vec_id, label, rows, codes = _rows(batch.slice(at, ROW_BLOCK), x.shape[1], levels)
                low, high = anchors.interval(codes)
                other = labels[:, None] != label[None, :]
                wanted = np.zeros(other.shape, bool)
                for place in range(held["most"]):  # an anchor's first, second, ... band
                    band = held["place"] == place
                    some = owner[band]
                    wanted[some] |= other[some] & (high[some] >= floor[band][:, None]) & (low[some] <= ceiling[band][:, None])
                a, r = np.nonzero(wanted)
                score = _scores(x, rows, a, r)
                found = []
                for place in range(held["most"]):
                    of = held["band_of"][a, place]
                    fits = (of >= 0) & (score >= lowest[of]) & (score <= highest[of])
                    found.append((of[fits], score[fits], vec_id[r[fits]]))
                best = [np.concatenate([p, *q]) for p, q in zip(best, zip(*found))]
                keep = _first(best[0], best[1], best[2], k)
                best = [p[keep] for p in best]
                full = np.bincount(best[0], minlength=len(owner)) >= k
                least = np.full(len(owner), np.inf)
                np.minimum.at(least, best[0], best[1].astype(np.float64))
                least[~full] = 0
                floor = np.where(full, np.maximum(least - np.abs(least) * SLACK - 1, lowest), lowest)
        names = ["anchor", "place", "negative_id", "negative_score"]
        yield pa.RecordBatch.from_arrays([pa.array(held["row"][owner[best[0]]]), pa.array(held["place"][best[0]], pa.int32()), pa.array(best[2]), pa.array(best[1])], names)

    return run


def _ranked(df: DataFrame, key: list[str], score: str, vec_id: str, k: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc(score), vec_id)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _bands(positives: list, rows: list[int], percent: int) -> dict:
    """The ranges of scores that an anchor's positives ask for: owner (the
    anchor's place in its block), place (rank of the positive), lowest, highest."""
    at = {row: i for i, row in enumerate(rows)}
    bands = []
    for p in positives:
        lowest = -(-percent * p["positive_score"] // 100)
        if lowest <= p["positive_score"]:
            bands.append((at[p["anchor"]], p["rank"] - 1, lowest, p["positive_score"]))
    owner, place, lowest, highest = (np.array(x, np.int64) for x in (zip(*bands) if bands else [[]] * 4))
    most = int(place.max(initial=-1)) + 1
    band_of = np.full((len(rows), most), -1)
    band_of[owner, place] = np.arange(len(owner))
    return {"owner": owner, "place": place, "lowest": lowest, "highest": highest, "most": most, "band_of": band_of}


def index(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", levels: int = LEVELS) -> tuple[DataFrame, int]:
    """The index of all rows that take part (a row number, id, label, quantised
    vector, codes), written to the shared folder, and the vectors' width."""
    rows = vectors.select(
        vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("long").alias("label"), quantised(vectors[vector_col], scale).alias("x"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "*")
    width = max(1, width)
    return written(rows.mapInArrow(_indexer(width, levels), INDEX), "index"), width


def mine(
    vectors: DataFrame, anchors: str, k_positive: int = 5, k_negative: int = 5, percent: int = 80, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", levels: int = LEVELS, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score: for every row for which ``anchors`` (an SQL condition on
    ``vec_id``) holds, and each of its first ``k_positive`` other rows of its label,
    the first ``k_negative`` rows of other labels whose score is at most the
    positive's and at least ``percent`` / 100 of it. Scores are the inner products of
    floor(``scale`` * x) in integers; higher ones come first, ties by smaller id.

    Rows without an id or a label, and vectors that are null or hold null or
    non-finite components, take no part. Components that a shorter vector lacks
    count as zero. Rows that share an id are rows of their own: each is an
    anchor and a candidate for the others. Scores beyond long count as its
    nearest value. A positive without such rows, and an anchor without
    positives, give no rows; nor does an empty table. Other columns are not
    read.

    The index is written once and never shuffled. Blocks of ``anchor_block``
    anchors (a few hundred KB) are broadcast to it one after the other, and each
    task returns ``k`` rows for each anchor and positive at most. The intervals
    are certain, so the result is exact.
    """
    rows, width = index(vectors, scale, id_col, label_col, vector_col, levels)
    spark, sc = vectors.sparkSession, vectors.sparkSession.sparkContext
    chosen = rows.filter(F.expr(anchors)).select("row", "vec_id", "label", "x")
    size = ceil_div(width, WORD) * WORD
    blocks = ceil_div(chosen.count(), max(1, min(anchor_block, BLOCK_BYTES // (8 * size))))
    block = F.pmod(F.xxhash64("row"), F.lit(max(1, blocks))).cast("int")
    chosen = written(chosen.withColumn("block", block).repartition("block"), "anchors", partition_by="block")
    result = Appended(spark, "negatives", RESULT)
    for b in range(blocks):
        held = chosen.filter(F.col("block") == b).toArrow()
        if not held.num_rows:
            continue
        x = np.zeros((held.num_rows, size))
        for i, v in enumerate(held.column("x").to_pylist()):
            x[i, :len(v)] = v
        own = {"x": x, "row": held.column("row").to_numpy(), "label": held.column("label").to_numpy()}
        found = rows.mapInArrow(_positives(sc.broadcast(own), width, levels, k_positive), "anchor long, positive_id long, positive_score long")
        positives = written(_ranked(found, ["anchor"], "positive_score", "positive_id", k_positive), "positives")
        bands = _bands(positives.collect(), own["row"].tolist(), percent)
        if not bands["most"]:
            continue
        found = rows.mapInArrow(_negatives(sc.broadcast(own | bands), width, levels, k_negative), "anchor long, place int, negative_id long, negative_score long")
        best = _ranked(found, ["anchor", "place"], "negative_score", "negative_id", k_negative)
        best = best.join(positives.select("anchor", (F.col("rank") - 1).alias("place"), "positive_id", "positive_score"), ["anchor", "place"])
        ids = chosen.filter(F.col("block") == b).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        result.add(best.join(ids, "anchor").select(
            "anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score"))
    return result.read()
