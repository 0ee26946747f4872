"""Spelling variants by finite-state composition.

Two words are near if one edit turns one into the other: if the vocabulary's
acceptor, composed with a one-edit transducer and the acceptor again, accepts
the pair. The composition's states are (state, edits so far, state). Until the
edit both words walk through the same states, so the composition falls into
parts by what was read before the edit: its initial states. The vocabulary is
dealt to these parts; each part's words are made a minimal acyclic acceptor, and
its composition is enumerated.

A pair belongs to the length of its shorter word and to the place of its edit
(the length of the common prefix). A part holds the pairs of one length whose
edit lies in a range of places: such words share all that stands before the
range and after it. A part of too many words is split into the two halves of
its range, down to a single place, where the words that meet differ in one
character only. So no part is large, and every pair is met in exactly one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.llm.common import Appended, lower_ascii, written

RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
MIN_LENGTH, MIN_COUNT, RATIO, DROP = 6, 5, 5, 199
#: Words of a part that is enumerated in one piece.
PART_WORDS = 5_000
#: Pairs held before they are handed on.
BATCH_PAIRS = 50_000


# --- words -----------------------------------------------------------------

def words_of(docs: DataFrame, drop: int | None = DROP, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (word) for each run of letters, A-Z lower-cased. Where ``drop``
    divides the checksum of "<doc_id>:<run>", one character of the run is left out
    (a typing error, made the same way each time)."""
    runs = docs.select(F.coalesce(docs[doc].cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(docs[text], F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.select("d", lower_ascii(F.col("run")).alias("run"))
    if drop is None:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return runs.select(F.when(h % drop == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``min_length`` characters that occur at
    least ``min_count`` times."""
    return words.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


# --- parts of the composition -----------------------------------------------

def _key(word: Column, size: Column, low: Column, high: Column) -> Column:
    """What the words of a part share: the characters before place ``low``, and
    those after the last place of the range in the shorter word."""
    before = F.substring(word, F.lit(1), low)
    after = F.greatest(size - high, F.lit(0))
    return F.xxhash64(size, low, high, before, F.substring(word, F.char_length(word) - after + 1, after))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (word, size, low, high) with their part's key; ``size`` is the
    shorter word's length, places from ``low`` up to but not ``high``."""
    return rows.withColumn("part", _key(F.col("word"), F.col("size"), F.col("low"), F.col("high")))


def _halves(rows: DataFrame) -> DataFrame:
    middle = F.expr("(low + high) div 2").cast("int")
    halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))
    return rows.select("word", "size", F.explode(halves).alias("half")).select("word", "size", "half.low", "half.high").filter("low < high")


def _parts(words: DataFrame, part_words: int, result: Appended) -> None:
    """Write the parts of at most ``part_words`` words (or of a single place)
    that hold more than one word; split the others."""
    length = F.char_length("word")
    roles = F.array(length - 1, length)  # as the longer word of a pair, and as the shorter or an equal one
    rows = words.select("word", F.explode(roles).alias("size"), F.lit(0).alias("low")).withColumn("high", F.col("size") + 1)
    rows = _halves(rows)
    while True:
        rows = written(_dealt(rows), "dealt")
        counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        counted = rows.join(counts, "part").withColumn("final", (F.col("c") <= part_words) | (F.col("high") - F.col("low") <= 1))
        result.add(counted.filter("final").select("part", "word", "size", "low", "high"))
        rows = _halves(counted.filter("NOT final").drop("part"))
        if rows.isEmpty():
            return


# --- acceptor and composition -------------------------------------------------

class Acceptor:
    """The minimal acyclic acceptor of sorted words: ``arcs[s]`` maps characters
    to states, ``final[s]`` says whether a word ends there."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        register: dict[tuple, int] = {}

        def state(arcs: dict[str, int], final: bool) -> int:
            known = (final, *arcs.items())
            s = register.get(known)
            if s is None:
                s = register[known] = len(self.arcs)
                self.arcs.append(arcs)
                self.final.append(final)
            return s

        # the path of the last word: arcs and finality of states that may still change
        open_arcs, open_final, last = [{}], [False], ""
        for word in words:
            common = 0
            while common < len(last) and common < len(word) and last[common] == word[common]:
                common += 1
            for i in range(len(last), common, -1):
                open_arcs[i - 1][last[i - 1]] = state(open_arcs.pop(), open_final.pop())
            for _ in word[common:]:
                open_arcs.append({})
                open_final.append(False)
            open_final[-1] = True
            last = word
        for i in range(len(last), 0, -1):
            open_arcs[i - 1][last[i - 1]] = state(open_arcs.pop(), open_final.pop())
        self.start = state(open_arcs.pop(), open_final.pop())


class NearPairs:
    """The pairs of words that the acceptor, a one-edit transducer and the
    acceptor accept together."""

    def __init__(self, acceptor: Acceptor):
        self.arcs, self.final = acceptor.arcs, acceptor.final
        self.start = acceptor.start
        self.accepted: dict[tuple[int, int, int], bool] = {}

    def alive(self, p: int, q: int, length: int) -> bool:
        """Whether both states accept a common rest of so many characters."""
        accepted, first = self.accepted, (p, q, length)
        if first in accepted:
            return accepted[first]
        stack = [first]
        while stack:
            p, q, n = state = stack[-1]
            if n == 0:
                accepted[state] = self.final[p] and self.final[q]
            else:
                both = self.arcs[q]
                following = [(s, both[c], n - 1) for c, s in self.arcs[p].items() if c in both]
                known = [accepted.get(f) for f in following]
                if True in known or None not in known:
                    accepted[state] = True in known
                else:
                    stack.append(following[known.index(None)])
                    continue
            stack.pop()
        return accepted[first]

    def rests(self, p: int, q: int, length: int, but: str = "") -> Iterator[str]:
        """The common rests of two states that do not begin with ``but``: the
        composition after its edit."""
        stack = [(p, q, "")]
        while stack:
            p, q, read = stack.pop()
            left = length - len(read)
            if not self.alive(p, q, left):
                continue
            if not left:
                yield read
                continue
            both = self.arcs[q]
            stack += [(s, both[c], read + c) for c, s in self.arcs[p].items() if c in both and (read or c != but)]

    def pairs(self, size: int, low: int, high: int) -> Iterator[tuple[str, str]]:
        """Pairs whose shorter word has ``size`` characters and that part at a
        place from ``low`` up to but not ``high``."""
        stack = [(self.start, "")]
        while stack:
            s, read = stack.pop()
            arcs, left = list(self.arcs[s].items()), size - len(read)
            if len(read) >= low:
                for i, (c, p) in enumerate(arcs):
                    # a character replaced
                    for d, q in arcs[i + 1:] if left else ():
                        if self.alive(p, q, left - 1):
                            for x in self.rests(p, q, left - 1):
                                yield read + c + x, read + d + x
                    # one more in the longer word; if the shorter goes on with the same, they part later
                    for x in self.rests(s, p, left, but=c):
                        yield read + x, read + c + x
            if len(read) + 1 < high:
                stack += [(t, read + c) for c, t in arcs]


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways round, of the parts in rows sorted by part, range and word."""
    out: list[tuple[str, str]] = []
    part, words, shape = None, [], None

    def found():
        if len(words) == 2:
            return [(words[0], words[1])] if _near(words[0], words[1], *shape) else []
        return NearPairs(Acceptor(words)).pairs(*shape)

    def batch():
        a, b = zip(*out) if out else ((), ())
        made = pa.RecordBatch.from_arrays([pa.array([*a, *b], pa.string()), pa.array([*b, *a], pa.string())], ["word", "near"])
        out.clear()
        return made

    for rows in batches:
        columns = [rows.column(c).to_pylist() for c in ("part", "word", "size", "low", "high")]
        for p, word, *own in zip(*columns):
            if p != part or own != shape:
                for pair in found() if len(words) > 1 else ():
                    out.append(pair)
                    if len(out) >= BATCH_PAIRS:
                        yield batch()
                part, words, shape = p, [], own
            if not words or words[-1] != word:
                words.append(word)
    for pair in found() if len(words) > 1 else ():
        out.append(pair)
        if len(out) >= BATCH_PAIRS:
            yield batch()
    yield batch()


def _near(a: str, b: str, size: int, low: int, high: int) -> bool:
    """The composition of two words alone: the state after the common prefix,
    one edit, and equal rests."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) != size or len(b) > size + 1 or a == b:
        return False
    at = 0
    while at < size and a[at] == b[at]:
        at += 1
    return low <= at < high and a[at + (len(a) == len(b)):] == b[at + 1:]


def near_pairs(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, near): all pairs of distinct ``words`` (word) that differ by exactly one
    inserted, deleted or replaced character, both ways round."""
    parts = Appended(words.sparkSession, "parts", "part long, word string, size int, low int, high int")
    _parts(words, part_words, parts)
    return parts.read().repartition("part").sortWithinPartitions("part", "size", "low", "high", "word").mapInArrow(_enumerate, "word string, near string")


# --- forms and roots ----------------------------------------------------------

def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of forms. Chains double their steps
    until all have ended; counts grow along a chain, so that it ends."""
    hops = written(forms.select("word", F.col("form").alias("root")), "hops")
    while True:
        following = hops.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = hops.join(following, "root", "left")
        hops = written(longer.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "hops")
        if hops.filter("moved").isEmpty():
            return hops.drop("moved")
        hops = hops.drop("moved")


def variant_groups(counts: DataFrame, ratio: int = RATIO, part_words: int = PART_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for a vocabulary (word, n).

    ``n_near`` counts the word's near words (one inserted, deleted or replaced
    character). ``form`` is the near word of largest n, ties to the smallest in
    code-point order, if its n (``form_n``) is at least ``ratio`` times the word's,
    else null. ``root`` is the end of the chain of forms, the word itself without
    a form.

    Rows without a word or n are left out; words that are listed more than once
    count together; an empty vocabulary gives no rows; other columns are not
    read."""
    counts = written(counts.filter("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "vocabulary")
    pairs = near_pairs(counts.select("word"), part_words)
    ranked = pairs.join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = ranked.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    wins = -F.col("best.less") >= ratio * F.col("n")
    forms = written(counts.join(best, "word", "left").select(
        "word", F.when(wins, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(wins, -F.col("best.less")).cast("long").alias("form_n")), "forms")
    roots = _roots(forms.filter("form IS NOT NULL"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", drop: int | None = DROP,
    min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, part_words: int = PART_WORDS,
) -> DataFrame:
    """``variant_groups`` of the words of whole texts: runs of Latin letters
    (A-Z lower-cased, other letters as they are) of at least ``min_length``
    characters that occur at least ``min_count`` times.

    Null and empty texts have no words; rows that repeat count each; a null
    doc_id counts as an empty one in the checksums of ``drop``; an empty table gives
    no rows; other columns are not read."""
    return variant_groups(vocabulary(words_of(docs, drop, doc, text), min_length, min_count), ratio, part_words)
