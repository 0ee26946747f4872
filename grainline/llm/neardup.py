"""Near-duplicate documents by SuperMinHash.

An element's ranks in a signature are a random permutation of the slots, so a
slot is filled by the first step in which some element reaches it, and a
signature is complete (early stop) once all its slots are filled. Bands of
slots make candidate buckets; candidates are confirmed on their full shingle
sets; confirmed links are grouped by connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainline.llm.common import written
from grainline.llm.components import connected_components

#: 42 bands of 6 slots: a pair of similarity 0.8 shares no band once in 350,000.
BANDS, ROWS = 42, 6
#: Nodes of a bucket that are compared with its members, round by round.
PIVOTS = (1, 4)
BATCH_WORDS = 500_000
STEP_ELEMENTS = 150_000
GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles of ``k`` words as 64-bit hashes. A
    text with fewer words has its whole sequence as one; without words none."""
    import xxhash

    cut = [(t or b"").lower().split() for t in texts]
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, (w for ws in cut for w in ws)), np.uint64, sum(map(len, cut)))
    out, at = [], 0
    for ws in cut:
        own = hashed[at:at + len(ws)]
        at += len(ws)
        n = min(k, len(ws))
        if not n:
            out.append(own)
            continue
        s = mix(own[: len(own) - n + 1] + np.uint64(n * GOLD % 2**64))
        for t in range(1, n):
            s = mix(s * np.uint64(0xD6E8FEB86659FD93) + own[t: len(own) - n + 1 + t])
        out.append(np.unique(s))
    return out


def _draw(e: np.ndarray, step: int) -> np.ndarray:
    return mix(e + np.uint64((step + 1) * GOLD % 2**64))


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures of non-empty sets of 64-bit hashes, one row a set."""
    count = np.array([len(s) for s in sets], np.int64)
    signature = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    filled = np.zeros((len(sets), slots), bool)
    flat, done = signature.reshape(-1), filled.reshape(-1)
    e = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), count)

    def place(elements, owners, slot, step):
        """Fill the slots still empty with the least rank of this step."""
        to = owners * slots + slot
        free = ~done[to]
        to = to[free]
        np.minimum.at(flat, to, mix(_draw(elements[free], step) ^ np.uint64(GOLD)))
        return to

    done[place(e, owner, (_draw(e, 0) % np.uint64(slots)).astype(np.int64), 0)] = True
    open_sets = np.flatnonzero(~filled.all(axis=1))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < len(open_sets):
        # as many open sets as keep the permutations within bounds
        sizes = np.cumsum(count[open_sets[at:]])
        n = max(1, int(np.searchsorted(sizes, STEP_ELEMENTS, "right")))
        some = open_sets[at:at + n]
        at += n
        index = np.concatenate([np.arange(begin[s], begin[s + 1]) for s in some])
        own_e, own_o = e[index], owner[index]
        perm = np.tile(np.arange(slots, dtype=np.uint16), (len(index), 1))
        for step in range(slots):
            line = np.arange(len(own_e))
            k = step + (_draw(own_e, step) % np.uint64(slots - step)).astype(np.int64)
            slot = perm[line, k]
            perm[line, k] = perm[:, step]
            if step:
                done[place(own_e, own_o, slot.astype(np.int64), step)] = True
                more = ~filled[some].all(axis=1)
                if not more.any():
                    break
                if more.sum() < 0.7 * len(some):
                    some = some[more]
                    stay = np.isin(own_o, some)
                    own_e, own_o, perm = own_e[stay], own_o[stay], perm[stay]
    return signature


def _bands(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    parts = signature.reshape(len(signature), bands, rows)
    key = mix(np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(GOLD), parts.shape[:2]).copy())
    for r in range(rows):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key.view(np.int64)


def _in_batches(batches: Iterator[pa.RecordBatch]):
    """(other columns, texts) of about BATCH_WORDS words (by bytes), or one long text."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for d, t in zip(zip(*[c.to_pylist() for c in batch.drop_columns("text").columns]), batch.column("text")):
            ids.append(d)
            texts.append(t.as_py())
            size += len(texts[-1] or b"")
            if size >= 6 * BATCH_WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _signer(k: int, bands: int, rows: int):
    def run(batches):
        import xxhash

        for ids, texts in _in_batches(batches):
            sets = shingles(texts, k)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = _bands(super_minhash([sets[i] for i in full], bands * rows), bands, rows)
            buckets = [None] * len(ids)
            for i, row in zip(full, keys):
                buckets[i] = row
            node = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in zip(*ids)], pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "node", "buckets"])

    return run


def _setter(k: int):
    def run(batches):
        import xxhash

        for _, texts in _in_batches(batches):
            sets = shingles(texts, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["node", "elements"])

    return run


def _unsettled(members: DataFrame) -> DataFrame:
    """Members (key, node, n, label) of the buckets that still hold two or more
    components."""
    several = members.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a != b")
    return members.join(several.select("key"), "key", "left_semi")


def _alike(un: str, vn: str, percent: int) -> Column:
    """Whether sets of such sizes can have the similarity."""
    return 100 * F.least(un, vn) >= percent * F.greatest(un, vn)


def _pivot_pairs(members: DataFrame, pivots: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Each bucket's first nodes against its members of other components, and
    those first nodes."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("node"))
    first = members.withColumn("place", place).filter(F.col("place") <= pivots)
    first = first.select("key", F.col("node").alias("u"), F.col("label").alias("ul"), F.col("n").alias("un"))
    pairs = members.select("key", F.col("node").alias("v"), F.col("label").alias("vl"), F.col("n").alias("vn")).join(first, "key")
    pairs = pairs.filter((F.col("ul") != F.col("vl")) & _alike("un", "vn", percent))
    return pairs.select("u", "ul", "v", "vl").distinct(), first.select("key", F.col("u").alias("node"))


def _remaining_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of the nodes left, across components, that can still be similar.

    The elements of all these nodes are put in one order, those that few nodes
    hold first. Of two similar sets the first elements of the smaller and of the
    larger one then have an element in common, if as many are taken as ``_prefix``
    says; so the nodes are joined by element, never by bucket, and groups of sets
    that share most, but too little to be similar, do not meet at what is theirs
    alone. Up to the last element shared there, the order is the same in both,
    so the shared elements and the shorter rest bound the intersection. The
    bound refutes pairs before they leave the join, and a pair leaves it once, at
    the first element it shares.
    """
    nodes = members.groupBy("node").agg(F.min("label").alias("label"))
    held = sets.join(nodes, "node")
    elements = held.select("node", F.explode("elements").alias("e"))
    counts = elements.groupBy("e").agg(F.count(F.lit(1)).alias("c"))
    place = F.sort_array(F.collect_list(F.struct("c", "e")))
    ordered = elements.join(counts, "e").groupBy("node").agg(F.transform(place, lambda x: x["e"]).alias("es"))
    ordered = ordered.join(nodes, "node").withColumn("n", F.size("es"))
    ordered = written(ordered.select(
        "node", "label", "n", F.slice("es", F.lit(1), _prefix(2 * percent, 100 + percent)).alias("first"),
        F.slice("es", F.lit(1), _prefix(percent, 100)).alias("more")), "remaining")
    a = ordered.select(F.col("node").alias("u"), F.col("label").alias("ul"), F.col("n").alias("un"), F.col("first").alias("up"), F.explode("first").alias("e"))
    b = ordered.select(F.col("node").alias("v"), F.col("label").alias("vl"), F.col("n").alias("vn"), F.col("more").alias("vp"), F.explode("more").alias("e2"))
    shared = F.array_intersect("up", "vp")
    last = F.element_at(shared, -1)
    rest = F.least(F.col("un") - F.array_position("up", last), F.col("vn") - F.array_position("vp", last))
    bound = F.size(shared) + rest
    smaller = (F.col("un") < F.col("vn")) | ((F.col("un") == F.col("vn")) & (F.col("u") < F.col("v")))
    apart = (F.col("ul") != F.col("vl")) & smaller & (100 * F.col("un") >= percent * F.col("vn"))
    near = F.when(apart, (F.element_at(shared, 1) == F.col("e")) & (100 * bound >= percent * (F.col("un") + F.col("vn") - bound))).otherwise(False)
    return a.join(b, (a["e"] == b["e2"]) & near).select("u", "ul", "v", "vl")


def _prefix(part: int, whole: int) -> Column:
    """How many of a set's first elements hold one of those that it has in common
    with a set that shares ``part`` / ``whole`` of it: all but those that can be
    spared, and one."""
    return F.expr(f"n - ({part} * n + {whole - 1}) div {whole} + 1").cast("int")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between the components of pairs whose full sets have a
    similarity of ``percent`` or more."""
    a = sets.select(F.col("node").alias("u"), F.col("elements").alias("ue"))
    b = sets.select(F.col("node").alias("v"), F.col("elements").alias("ve"))
    both = F.size(F.array_intersect("ue", "ve")).cast("long")
    return (
        pairs.join(b, "v").join(a, "u")
        .withColumn("both", both)
        .filter(100 * F.col("both") >= percent * (F.size("ue") + F.size("ve") - F.col("both")))
        .select(F.col("ul").alias("u"), F.col("vl").alias("v")).distinct()
    )


def _relabelled(df: DataFrame, merged: DataFrame) -> DataFrame:
    out = df.join(merged.select(F.col("node").alias("label"), "component"), "label", "left")
    return out.withColumn("label", F.coalesce("component", "label")).drop("component")


def first_rows(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of the texts that stay if one row of each group does:
    that of the smallest doc_id, then of the smallest hash; every text without
    words."""
    alone = found.filter("group IS NULL").select("doc_id", "text_hash")
    least = found.filter("kept AND group IS NOT NULL").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"))
    return alone.unionByName(least.select("r.*")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles (size of the document's set of ``k``-word shingles),
    component_id (smallest doc_id of its group), kept (doc_id is that), text_hash
    (xxhash64 of the text, null as empty) and group (a mark of the group, which
    tells groups with one component_id apart; null without words).

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text
    with fewer than ``k`` words has its whole sequence as one shingle; null and
    empty texts have none and are linked with nothing. Documents are linked if
    their sets' similarity is ``percent``/100 or more; groups are all that
    links reach. Rows are documents: rows that repeat a doc_id are linked like
    others; a row without a doc_id has a group of its own unless its text links
    it. An empty table gives no rows; other columns are not read.

    Equal sets are one node from the start. In each bucket a few first nodes
    are compared with the members of other components; what that links is one
    component, and a bucket with a single component is done. Nodes left in other
    buckets are joined by their sets' rarest elements, and the pairs that a bound
    on their sets does not refute are compared last. So every candidate pair is linked, confirmed
    or refuted; a group of n copies costs about n comparisons, and no cap drops
    a bucket or a pair.
    """
    texts = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_hash"), docs["text"].cast("binary").alias("text"))
    signed = written(texts.mapInArrow(
        _signer(k, bands, rows), "doc_id long, text_hash long, n_shingles long, node binary, buckets array<long>"), "signed")
    nodes = signed.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.min("buckets").alias("buckets"))
    members = nodes.select("node", "n", F.explode("buckets").alias("key")).withColumn("label", F.col("node"))
    members = written(_unsettled(members), "members")
    labels = written(members.select("node", "label").distinct(), "labels")

    wanted = nodes.join(labels, "node", "left_semi").select(F.col("doc_id").alias("wanted")).distinct()
    sets = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").mapInArrow(_setter(k), "node binary, elements array<long>")
    sets = written(sets.join(labels, "node", "left_semi").dropDuplicates(["node"]), "sets")

    for pivots in (*PIVOTS, None):
        if members.isEmpty():
            break
        if pivots:
            pairs, done = _pivot_pairs(members, pivots, percent)
        else:
            pairs, done = _remaining_pairs(members, sets, percent), None
        merged = written(connected_components(_confirmed(pairs, sets, percent)), "merged")
        labels = written(_relabelled(labels, merged), "labels")
        if done is not None:
            left = members.join(done, ["key", "node"], "left_anti")
            members = written(_unsettled(_relabelled(left, merged)), "members")
    group = signed.join(labels, "node", "left").withColumn("group", F.coalesce("label", "node"))
    least = group.filter("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("least"))
    return (
        group.join(least, "group", "left")
        .withColumn("component_id", F.coalesce("least", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "group")
    )
