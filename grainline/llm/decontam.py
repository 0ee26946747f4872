"""Benchmark decontamination with an FM-index per training shard.

Each shard of documents is turned into a sequence of word numbers, its
Burrows-Wheeler transform is kept in a wavelet matrix, the test phrases are
searched backwards through it, occurrences are located by sampled suffix
positions, and the found stretches are merged into removal spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.llm.common import ceil_div

WINDOW = 13
SAMPLE = 8
SHARD_BYTES = 24 << 20
PHRASE_BYTES = 16 << 20
#: A-Z to a-z; every other ASCII byte but a-z and 0-9 ends a word.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def words_of(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(FOLD).split()


class WaveletMatrix:
    """Rank and access over a sequence of small integers, many at a time."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.n = len(values)
        self.levels = []
        for bit in reversed(range(max(1, int(symbols - 1).bit_length()))):
            ones = (values >> bit & 1).astype(bool)
            packed = np.zeros(self.n // 64 + 1, np.uint64)
            raw = np.packbits(ones, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((bit, packed, before, self.n - int(before[-1])))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def _ones(packed, before, at):
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(packed[at >> 6] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of ``symbol`` stand before position ``at``."""
        low = np.zeros_like(at)
        for bit, packed, before, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            a, b = self._ones(packed, before, low), self._ones(packed, before, at)
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for bit, packed, before, zeros in self.levels:
            one = (packed[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(packed, before, at)
            out = out << 1 | one
            at = np.where(one, zeros + ones, at - ones)
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order of a sequence in which every 0 ends a string and ranks by
    its place; the last symbol is 0. Only unsettled suffixes are sorted again."""
    n = len(seq)
    ends = np.flatnonzero(seq == 0)
    rank = seq.astype(np.int64) + len(ends) - 1
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    key, step, todo = rank[order], 1, None
    first = np.concatenate([[True], key[1:] != key[:-1]])
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = head
    open_ = ~(first & np.concatenate([first[1:], [True]]))
    todo = np.flatnonzero(open_)
    while len(todo):
        own = order[todo]
        pair = rank[own] * (n + 1) + rank[np.minimum(own + step, n - 1)]
        by = np.argsort(pair, kind="stable")
        pair, own = pair[by], own[by]
        order[todo] = own
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[own] = np.maximum.accumulate(np.where(new, todo, 0))
        todo = todo[~(new & np.concatenate([new[1:], [True]]))]
        step *= 2
    return order


class FmIndex:
    def __init__(self, seq: np.ndarray, symbols: int):
        order = suffix_array(seq)
        last = seq[order - 1]
        self.tree = WaveletMatrix(last, symbols)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        # a string's first word is sampled too: no step goes back over an end
        marked = (order % SAMPLE == 0) | (last == 0)
        self.marked, self.place = marked, np.cumsum(marked) - 1
        self.sampled = order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of suffixes that begin with each phrase (a row
        of the matrix)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.tree.n, np.int64)
        for j in reversed(range(phrases.shape[1])):
            alive = np.flatnonzero(low < high)
            c = phrases[alive, j]
            low[alive] = self.start[c] + self.tree.rank(c, low[alive])
            high[alive] = self.start[c] + self.tree.rank(c, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.marked[rows])
        while len(todo):
            c = self.tree.access(rows[todo])
            rows[todo] = self.start[c] + self.tree.rank(c, rows[todo])
            steps[todo] += 1
            todo = todo[~self.marked[rows[todo]]]
        return self.sampled[self.place[rows]] + steps


class Phrases:
    """The distinct windows of some benchmark items, as word numbers from 1."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i:i + window]), set()).add(item)
        self.symbols = len(self.number) + 1
        by_length: dict[int, list] = {}
        for w in owners:
            by_length.setdefault(len(w), []).append(w)
        self.groups = [(np.array(ws, np.int64), [owners[w] for w in ws]) for _, ws in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)
        pairs = [g[:, i:i + 2] for g, _ in self.groups for i in range(g.shape[1] - 1)]
        code = np.unique(np.concatenate([p[:, 0] * self.symbols + p[:, 1] for p in pairs])) if pairs else np.zeros(0, np.int64)
        self.pairs = code

    def has_pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.zeros(len(a), bool)
        code = a * self.symbols + b
        return self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] == code


def _searched(ids: np.ndarray, phrases: Phrases) -> list[tuple[int, int, set[str]]]:
    """Occurrences (first word, length, items) in a shard's word numbers; 0
    stands for words of no phrase and for document ends.

    Stretches that the phrases' word pairs do not join into at least the
    shortest phrase can hold no occurrence and are left out of the index.
    """
    joined = phrases.has_pair(ids[:-1], ids[1:])
    breaks = np.flatnonzero(np.concatenate([[True], ~joined, [True]]))
    begin, length = breaks[:-1], np.diff(breaks)
    keep = (length >= phrases.shortest) & (ids[begin] > 0)
    begin, length = begin[keep], length[keep]
    if not len(begin):
        return []
    # kept stretches one after the other, each ended by a 0
    total = length + 1
    at = np.concatenate([[0], np.cumsum(total)])
    place = np.repeat(begin - at[:-1], total) + np.arange(at[-1])
    seq = ids[np.minimum(place, len(ids) - 1)]
    seq[at[1:] - 1] = 0
    index = FmIndex(seq, phrases.symbols)
    found = []
    for windows, owners in phrases.groups:
        low, high = index.search(windows)
        hit = np.flatnonzero(high > low)
        count = high[hit] - low[hit]
        rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        which = np.repeat(hit, count)
        for w, p in zip(which.tolist(), place[index.locate(rows)].tolist()):
            found.append((p, windows.shape[1], owners[w]))
    return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _byte_spans(text: bytes, hits: list[dict]) -> list[dict]:
    """Word stretches as byte stretches of the text."""
    at = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    return [{"start": at[h["start"]][0], "end": at[h["end"] - 1][1]} for h in hits]


def _search_pass(shipped, window: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shipped.value, window)
        number = phrases.number.get
        held: list[dict] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            starts = np.cumsum([0, *map(len, parts)])
            per_doc: dict[int, list] = {}
            if phrases.shortest:
                for p, n, items in _searched(ids, phrases):
                    d = int(np.searchsorted(starts, p, "right")) - 1
                    per_doc.setdefault(d, []).append((p - int(starts[d]), n, items))
            for d, found in per_doc.items():
                row = held[d]
                spans = [(h["start"], h["end"]) for h in row["hits"]] + [(a, a + n) for a, n, _ in found]
                row["hits"] = [{"start": a, "end": b} for a, b in _merged(spans)]
                row["items"] = sorted({*row["items"], *(i for *_, items in found for i in items)})
                row["spans"] = _byte_spans(row["__text"], row["hits"])
            out = pa.RecordBatch.from_pylist(held, schema)
            held.clear()
            parts.clear()
            return out

        size = 0
        for batch in batches:
            columns = [(n, batch.column(n)) for n in batch.schema.names]
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in columns}
                words = words_of(row["__text"])
                row["n_words"] = len(words)
                held.append(row)
                parts.append(np.fromiter((number(w, 0) for w in [*words, None]), np.int64, len(words) + 1))
                size += len(row["__text"] or b"")
                if size >= SHARD_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _item_blocks(items: DataFrame, text: str, item: str, block_bytes: int):
    """The benchmark's (item, text) rows in blocks of about ``block_bytes``,
    each collected by itself; a single item may be larger."""
    rows = items.select(items[item].cast("string").alias("item"), items[text].cast("binary").alias("text"))
    rows = rows.filter("item IS NOT NULL AND text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil_div(total, block_bytes))
    for b in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield [(r["item"], bytes(r["text"])) for r in part.toLocalIterator()]


def find_contamination(
    docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_bytes: int = PHRASE_BYTES,
) -> DataFrame:
    """Columns ``keep`` of every document, and n_words, hits (merged stretches
    of words inside any occurrence of a phrase, ``end`` exclusive), spans (the
    same as byte offsets of the UTF-8 text) and items (sorted ids of the items
    with an occurring phrase).

    An item's phrases are its runs of ``window`` words; an item of fewer words,
    but not none, is one phrase. Null and empty texts have no words; items with
    a null id or text give no phrase; repeated items and rows count each; empty
    tables give no rows or no hits; columns of ``docs`` not in ``keep``,
    clashing names included, are not read.

    Documents are indexed where they are read, in shards of bounded bytes, and
    are not shuffled. The phrases are sent to the executors in blocks of
    bounded bytes, one pass over the shards for each block.
    """
    clash = {"n_words", "hits", "spans", "items", "__text"} & set(keep)
    if clash:
        raise ValueError(f"columns with names of outputs: {sorted(clash)}")
    from pyspark.sql.pandas.types import to_arrow_schema

    sc = docs.sparkSession.sparkContext
    stretch = "array<struct<start:int,end:int>>"
    rows = docs.select(*[docs[c] for c in keep], docs[text].cast("binary").alias("__text")).withColumns({
        "n_words": F.lit(0).cast("long"), "hits": F.lit(None).cast(stretch), "spans": F.lit(None).cast(stretch),
        "items": F.lit(None).cast("array<string>"),
    })
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)) for c in ("hits", "spans", "items")})
    for block in _item_blocks(items, item_text, item, block_bytes):
        rows = rows.mapInArrow(_search_pass(sc.broadcast(block), window, to_arrow_schema(rows.schema)), rows.schema)
    return rows.drop("__text")


def n_hit() -> Column:
    """Words inside occurrences, from ``hits``."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + (h["end"] - h["start"]))


def contaminated() -> Column:
    """At least one word in twenty stands in an occurrence."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def contamination_report(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )
