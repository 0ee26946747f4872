"""Token counts with overlap resynchronisation.

A text is encoded in chunks that overlap. The scan that cuts a text into pieces
keeps no memory: from a place where one piece ends and the next begins, it goes
on in the same way whatever stood before, and merges never cross pieces. So
where a piece ends at the same place in a chunk and in the next one, and the
first chunk has seen enough text beyond that place to be sure of it, both
encodings are the whole text's from there on, and are spliced there. Where an
overlap holds no such place (one piece is longer than it), the overlap is
widened and the next chunk encoded again.

Long texts are counted chunk by chunk in one task; huge ones are cut into
overlapping parts that are dealt to many tasks and spliced in the same way.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainline.llm.common import written

#: Characters of a chunk and of an overlap; a text of more than PART characters is dealt to several tasks.
CHUNK, OVERLAP, PART = 1 << 15, 256, 8 << 20
#: Parts of huge texts overlap by so many characters.
PART_OVERLAP = 1 << 16
CACHE_PIECES, CACHED_LENGTH = 500_000, 40
MAX_FILE_BYTES = 64 << 20
#: Characters whose classes are the same for every library.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
PLAIN_PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d"
    "| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-/:-@\\[-`{-~]+"
    "|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")

#: A text or a part of it as encoded: where its pieces end, and the tokens up to there.
Encoded = tuple[np.ndarray, np.ndarray]


class PieceCounter:
    """Pieces and their token counts, as the tokenizer file's library has them."""

    def __init__(self, file_text: str):
        from tokenizers import Tokenizer

        spec = json.loads(file_text)
        cut = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or spec["post_processor"] or cut.get("type") != "ByteLevel" or not cut["use_regex"] or cut["add_prefix_space"]:
            raise ValueError("a byte-level tokenizer file without normalizer, prefix space and post-processor is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or not t["content"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        self.library = Tokenizer.from_str(file_text)
        self.library.no_truncation()
        self.library.no_padding()
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        #: A piece is sure if it ends so many characters before the end of what was seen.
        self.margin = max(map(len, added), default=0) + 1
        self.counts: dict[str, int] = {}

    def _cut(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return PLAIN_PIECE.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> tuple[list[str], set[int]]:
        """A text's pieces in order, and which of them are added tokens."""
        if self.special is None or not (found := list(self.special.finditer(text))):
            return self._cut(text), set()
        out, added, at = [], set(), 0
        for m in found:
            out += self._cut(text[at:m.start()])
            added.add(len(out))
            out.append(m.group())
            at = m.end()
        return out + self._cut(text[at:]), added

    def _count(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def tokens(self, pieces: list[str], added: set[int]) -> list[int]:
        """The tokens of each piece."""
        known = self.counts
        if len(known) > CACHE_PIECES:
            known.clear()
        new = list(set(pieces).difference(known))
        now = dict(zip(new, self._count(new)))
        known.update((p, n) for p, n in now.items() if len(p) <= CACHED_LENGTH)
        out = [known[p] if p in known else now[p] for p in pieces] if any(len(p) > CACHED_LENGTH for p in new) else list(map(known.__getitem__, pieces))
        for i in added:
            out[i] = 1
        return out

    def encode(self, text: str, start: int) -> Encoded:
        """A chunk that begins at ``start``."""
        pieces, added = self.pieces(text)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return start + np.cumsum(lengths), np.cumsum(np.array(self.tokens(pieces, added), np.int64))

    def total(self, text: str) -> int:
        return sum(self.tokens(*self.pieces(text)))


def splice(a: Encoded, a_from: int, sure: int, b: Encoded, b_start: int) -> tuple[int, int, int] | None:
    """The first place where both encodings have a piece end, (place, tokens of
    ``a`` before it, tokens of ``b`` before it), or None.

    ``a`` is right from ``a_from`` on and sure up to ``sure``. The start of ``b`` is such
    a place if ``a`` has it."""
    places = np.concatenate([[a_from], a[0][(a[0] > a_from) & (a[0] <= sure)]])
    places = places[places >= b_start]
    both = np.intersect1d(places, np.concatenate([[b_start], b[0]]), assume_unique=True)
    if not len(both):
        return None
    return int(both[0]), _before(a, both[0]), _before(b, both[0])


def _before(encoded: Encoded, place: int) -> int:
    at = int(np.searchsorted(encoded[0], place, "right"))
    return int(encoded[1][at - 1]) if at else 0


def encode_long(text: str, encode: Callable[[str, int], Encoded], margin: int, chunk: int, overlap: int) -> Encoded:
    """The whole text's pieces, encoded chunk by chunk."""
    end, since = min(chunk, len(text)), 0
    now, base = encode(text[:end], 0), 0
    ends, tokens = [], []

    def keep(place: int) -> None:
        some = (now[0] > since) & (now[0] <= place)
        ends.append(now[0][some])
        tokens.append(now[1][some] + base)

    while end < len(text):
        wide = overlap
        while True:
            begin = max(since, end - wide)
            stop = min(len(text), end + max(chunk, end - begin))
            following = encode(text[begin:stop], begin)
            found = splice(now, since, end - margin, following, begin)
            if found:
                break
            wide *= 2
        place, before, skipped = found
        keep(place)
        base += before - skipped
        now, since, end = following, place, stop
    keep(len(text))
    return np.concatenate(ends), np.concatenate(tokens)


def _counter(shipped) -> PieceCounter:
    """The worker's counter: built once, kept beside the broadcast file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    held = shipped.value
    if "counter" not in held:
        held["counter"] = PieceCounter(held["file"])
    return held["counter"]


def _count_or_cut(shipped, schema: pa.Schema, chunk: int, overlap: int, part: int, part_overlap: int):
    """Counts of the texts of up to ``part`` characters; of the others the
    overlapping parts, to be counted elsewhere."""

    def made(rows: pa.RecordBatch, *columns: list) -> pa.RecordBatch:
        both = [*rows.columns, *map(pa.array, columns)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(both, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shipped)
        for batch in batches:
            rows, small, counts = batch.drop_columns("__text"), [], []
            for i, value in enumerate(batch.column("__text")):
                text = value.as_py() or ""
                if len(text) <= part:
                    small.append(i)
                    counts.append(counter.total(text) if len(text) <= chunk else int(encode_long(text, counter.encode, counter.margin, chunk, overlap)[1][-1]))
                    continue
                doc = uuid.uuid4().hex
                for number, s in enumerate(range(0, len(text) - part_overlap, part - part_overlap)):
                    yield made(rows.slice(i, 1), [None], [doc], [number], [s], [s + part >= len(text)], [text[s:s + part]])
            none = [None] * len(small)
            yield made(rows.take(pa.array(small, pa.int64())), counts, none, none, none, none, none)

    return run


PARTS = "__tokens long, __doc string, __part int, __start long, __last boolean, __body string"
ENCODED = "doc string, part int, last boolean, tokens long, head array<long>, head_before array<long>, tail array<long>, tail_before array<long>"


def _part_encoder(shipped, chunk: int, overlap: int, part_overlap: int):
    """Each part's tokens, and where its pieces end near its two ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shipped)
        for batch in batches:
            for doc, part, start, last, body in zip(*map(batch.column, ("doc", "part", "start", "last", "body"))):
                text, s = body.as_py(), start.as_py()
                ends, before = (np.concatenate([[0], x]) for x in encode_long(text, counter.encode, counter.margin, chunk, overlap))
                head = ends <= part_overlap
                tail = (ends >= len(text) - part_overlap) & (ends <= len(text) - counter.margin)
                near = [[x.tolist()] for x in (ends[head] + s, before[head], ends[tail] + s, before[tail])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()]), pa.array([part.as_py()], pa.int32()), pa.array([last.as_py()]), pa.array([int(before[-1])], pa.int64()),
                     *[pa.array(x, pa.list_(pa.int64())) for x in near]],
                    ["doc", "part", "last", "tokens", "head", "head_before", "tail", "tail_before"])

    return run


def _joined(parts: DataFrame, apart: DataFrame) -> DataFrame:
    """Parts that could not be spliced to the next one are joined with it."""
    order = Window.partitionBy("doc").orderBy("part")
    stuck = parts.select("doc", "part", "start").join(apart.withColumn("stuck", F.lit(True)), ["doc", "part"], "left")
    opens = F.when(F.lag("stuck").over(order), 0).otherwise(1)
    runs = stuck.select("doc", "part", "stuck", F.lead("start").over(order).alias("until"), F.sum(opens).over(order).cast("int").alias("run"))
    own = F.when(F.col("stuck"), F.expr("substring(body, 1, cast(until - start as int))")).otherwise(F.col("body"))
    pieces = F.sort_array(F.collect_list(F.struct("part", "own")))
    return parts.join(runs, ["doc", "part"]).withColumn("own", own).groupBy("doc", F.col("run").alias("__run")).agg(
        F.min("start").alias("start"), F.bool_or("last").alias("last"), F.array_join(F.transform(pieces, lambda x: x["own"]), "").alias("body"),
    ).select("doc", F.col("__run").alias("part"), "start", "last", "body")


def _counted(parts: DataFrame, shipped, chunk: int, overlap: int, part_overlap: int) -> DataFrame:
    """(doc, n_tokens) of huge texts from their parts (doc, part, start, last,
    body). Neighbours whose overlap holds no common place are joined to one
    part and encoded again, until all splice."""
    while True:
        dealt = parts.repartition(parts.sparkSession.sparkContext.defaultParallelism, "doc", "part")
        encoded = written(dealt.mapInArrow(_part_encoder(shipped, chunk, overlap, part_overlap), ENCODED), "encoded")
        following = encoded.select("doc", (F.col("part") - 1).alias("part"), F.col("head").alias("next"), F.col("head_before").alias("next_before"))
        place = F.array_min(F.array_intersect("tail", "next"))
        tokens = lambda before, at: F.get(before, (F.array_position(at, F.col("place")) - 1).cast("int"))
        splices = written(encoded.filter("NOT last").join(following, ["doc", "part"]).withColumn("place", place).select(
            "doc", "part", tokens("tail_before", "tail").alias("upto"), tokens("next_before", "next").alias("skipped")), "splices")
        apart = splices.filter("upto IS NULL").select("doc", "part")
        if apart.isEmpty():
            break
        parts = written(_joined(parts, apart), "widened")
    spliced = splices.groupBy("doc").agg(F.sum(F.col("upto") - F.col("skipped")).alias("spliced"))
    return encoded.filter("last").join(spliced, "doc", "left").select(
        "doc", (F.col("tokens") + F.coalesce("spliced", F.lit(0))).alias("n_tokens"))


def count_tokens(
    docs: DataFrame, tokenizer_file: str, keep: list[str], limit: int = 512, text: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP, part: int = PART, part_overlap: int = PART_OVERLAP,
) -> DataFrame:
    """Columns ``keep`` of every row, n_bytes (UTF-8), n_tokens (as the library
    counts them, special strings inside texts being their tokens) and over_limit
    (n_tokens > ``limit``).

    Null and empty texts have no bytes and no tokens; repeated rows are counted
    each; an empty table gives no rows; columns of ``docs`` not in ``keep``, clashing
    names included, are not read; ``keep`` must not name an output. Texts are
    counted whole. A text of up to ``part`` characters is counted where it is
    read, longer than ``chunk`` chunk by chunk; a longer one is dealt to several
    tasks in parts, its overlapping text is written once more. A single piece of
    text that is longer than a part has to be encoded in one task. The tokenizer file
    (checked to be at most 64 MB) is sent to the executors.
    """
    clash = [c for c in keep if c in ("n_bytes", "n_tokens", "over_limit") or c.startswith("__")]
    if clash:
        raise ValueError(f"columns with names of outputs: {sorted(clash)}")
    if not 0 < overlap <= chunk or not 0 < 2 * part_overlap <= part:
        raise ValueError("an overlap is at most a chunk, and at most half of a part")
    with open(tokenizer_file, encoding="utf-8") as f:
        content = f.read(MAX_FILE_BYTES + 1)
    if len(content) > MAX_FILE_BYTES:
        raise ValueError("the tokenizer file is larger than the bound for broadcasts")
    PieceCounter(content)  # refuses files it cannot count by
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast({"file": content})
    rows = docs.select(*[docs[c] for c in keep], F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("n_bytes"), docs[text].alias("__text"))
    kept = [*keep, "n_bytes"]
    out = StructType([*rows.select(kept).schema.fields, *StructType.fromDDL(PARTS).fields])
    counted = written(rows.mapInArrow(_count_or_cut(shipped, to_arrow_schema(out), chunk, overlap, part, part_overlap), out), "counted")
    result = counted.filter("__doc IS NULL").select(*kept, F.col("__tokens").alias("n_tokens"))
    huge = counted.filter("__doc IS NOT NULL")
    if not huge.isEmpty():
        parts = huge.select(*[F.col(f"__{c}").alias(c) for c in ("doc", "part", "start", "last", "body")])
        counts = _counted(parts, shipped, chunk, overlap, part_overlap).withColumnRenamed("doc", "__doc")
        result = result.unionByName(huge.filter("__part = 0").join(counts, "__doc").select(*kept, "n_tokens"))
    return result.withColumn("over_limit", F.col("n_tokens") > limit)
