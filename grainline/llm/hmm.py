"""Language-model scores by a hidden Markov model.

States emit word classes: the most frequent words have a class each, all other
words share classes by their last bytes, and a word's share of its class comes
from the corpus counts. Baum-Welch counts of all training texts are gathered in
each partition and added up across partitions; the scaled forward recursion
gives the exact probability of a whole text under the model.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainline.llm.common import written

STATES = 8
#: Rounds end once one gains less than this share of the log-likelihood, or after so many.
GAIN, ROUNDS, LEAST_ROUNDS = 1e-3, 40, 5
#: Bounds: words with a class of their own, classes of the other words, words of
#: a block's dictionary, tokens of a batch.
TOP_WORDS, TAIL_CLASSES = 2_000, 512
BLOCK_WORDS, BATCH_TOKENS = 200_000, 250_000
#: Forward variables are scaled once in so many steps: eight steps of 1e-27
#: (emission times move) leave them above the smallest double.
SCALED = 8
#: Stands for a word number that does not fit 16 bits.
ESCAPE = 65_535
END = b""
log = logging.getLogger(__name__)


def _word_hash(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _tail_class(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w[-3:]) % TAIL_CLASSES for w in words), np.int32, len(words))


BLOCK = ("block long, docs array<struct<doc_id:long,held_out:boolean,n:long>>, tokens binary, rare binary, "
         "hash array<long>, tail array<int>, tf array<long>, often array<struct<hash:long,tf:long>>")
BLOCK_SCHEMA = pa.schema([
    ("block", pa.int64()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64())]))),
    ("tokens", pa.binary()), ("rare", pa.binary()), ("hash", pa.list_(pa.int64())), ("tail", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64())),
    ("often", pa.list_(pa.struct([("hash", pa.int64()), ("tf", pa.int64())]))),
])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as numbers of a block's own dictionary, how often each of its words
    stands in the block's training texts, and the TOP_WORDS words that do most often."""
    number: dict[bytes, int] = {}
    docs: list[dict] = []
    parts: list[np.ndarray] = []
    made = TaskContext.get().partitionId() << 32

    def flush() -> pa.RecordBatch:
        nonlocal made
        made += 1
        words, tokens = list(number), np.concatenate(parts)
        train = [p for d, p in zip(docs, parts) if not d["held_out"]]
        tf = np.bincount(np.concatenate([*train, tokens[:0]]), minlength=len(words))
        hashes = _word_hash(words)
        often = np.argpartition(-tf, TOP_WORDS)[:TOP_WORDS] if len(tf) > TOP_WORDS else np.arange(len(tf))
        often = pa.StructArray.from_arrays([pa.array(hashes[often]), pa.array(tf[often])], ["hash", "tf"])
        columns = [
            pa.array([made], pa.int64()), pa.array([docs], BLOCK_SCHEMA.field("docs").type),
            pa.array([np.minimum(tokens, ESCAPE).astype("<u2").tobytes()], pa.binary()),
            pa.array([tokens[tokens >= ESCAPE].astype("<u4").tobytes()], pa.binary()),
            pa.array([hashes], pa.list_(pa.int64())), pa.array([_tail_class(words)], pa.list_(pa.int32())), pa.array([tf], pa.list_(pa.int64())),
            pa.ListArray.from_arrays([0, len(often)], often),
        ]
        number.clear()
        docs.clear()
        parts.clear()
        return pa.RecordBatch.from_arrays(columns, schema=BLOCK_SCHEMA)

    for batch in batches:
        for d, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text")):
            words = (text.as_py() or b"").lower().split()
            words.append(END)
            parts.append(np.fromiter([number.setdefault(w, len(number)) for w in words], np.int32, len(words)))
            docs.append({"doc_id": d, "held_out": held, "n": len(words)})
            if len(number) >= BLOCK_WORDS:
                yield flush()
    if docs:
        yield flush()


@dataclass
class Vocabulary:
    """What every block needs of the corpus counts, of bounded size."""

    total: int
    distinct: int
    top: int
    class_total: np.ndarray
    tail_total: np.ndarray
    tail_distinct: np.ndarray

    def parts(self) -> tuple:
        """What is broadcast: executors need not have this class."""
        return self.total, self.distinct, self.top, self.class_total, self.tail_total, self.tail_distinct


CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, classes binary"


def _coder(shipped):
    """Each text's class sequence, its base score, and the log10 probability of
    its words inside their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*shipped.value)
        tail_share = np.log10(0.5) - np.log10(v.tail_total + 0.5 * (v.tail_distinct + 1))
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda n: batch.column(n)[i]
                counts = get("counts").values
                pos = counts.field("pos").to_numpy()
                c, cls = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
                c[pos], cls[pos] = counts.field("c").to_numpy(), counts.field("cls").to_numpy()
                inside = np.where(cls < v.top, 0.0, np.log10(2 * c + 1) + tail_share[np.maximum(cls - v.top, 0)])
                base = np.log10((c + 0.5) / (v.total + 0.5 * (v.distinct + 1)))
                tokens = np.frombuffer(get("tokens").as_py(), "<u2").astype(np.int64)
                tokens[tokens == ESCAPE] = np.frombuffer(get("rare").as_py(), "<u4")
                docs = get("docs").values
                n = docs.field("n").to_numpy()
                starts = np.cumsum(n) - n
                ends = starts + n
                codes = cls[tokens].astype("<u2")
                yield pa.RecordBatch.from_arrays([
                    docs.field("doc_id"), docs.field("held_out"), pa.array(n), pa.array(np.add.reduceat((c > 0)[tokens].astype(np.int64), starts)),
                    pa.array(np.add.reduceat(base[tokens], starts)), pa.array(np.add.reduceat(inside[tokens], starts)),
                    pa.array([codes[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                ], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "within", "classes"])

    return run


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # state x class

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is broadcast: executors need not have this class."""
        return self.start, self.move, self.emit

    @classmethod
    def guess(cls, counts: np.ndarray, states: int) -> Hmm:
        """Class frequencies, shaken a little differently for each state."""
        noise = np.random.default_rng(7).uniform(0.5, 1.5, (states, len(counts)))
        emit = (counts + 0.5) * noise
        move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Hmm:
        norm = lambda x: (x + 0.5) / (x + 0.5).sum(-1, keepdims=True)
        return cls(norm(start), norm(move), norm(emit))


class Lockstep:
    """Sequences side by side, one step of all of them after the other; longest
    first, so that the live ones of a step are the first rows."""

    def __init__(self, sequences: list[np.ndarray]):
        self.order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        sizes = np.array([len(sequences[i]) for i in self.order])
        self.live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
        self.at = np.concatenate([[0], np.cumsum(self.live)])
        self.seen = np.empty(self.at[-1], np.int64)
        for row, i in enumerate(self.order):
            self.seen[self.at[: sizes[row]] + row] = sequences[i]

    def forward(self, m: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward variables, the scales, and the emissions, by token."""
        emitted = np.take(np.ascontiguousarray(m.emit.T), self.seen, axis=0)
        alpha, scale = np.empty_like(emitted), np.ones(len(emitted))
        at, live = self.at.tolist(), [*self.live.tolist(), 0]
        for t, n in enumerate(live[:-1]):
            a, b = at[t], at[t + 1]
            x = alpha[a:b]
            if t:
                np.matmul(alpha[at[t - 1]:at[t - 1] + n], m.move, out=x)
                x *= emitted[a:b]
            else:
                np.multiply(m.start, emitted[a:b], out=x)
            # sequences that end here are scaled, and all at every eighth step
            first = live[t + 1] if (t + 1) % SCALED else 0
            if first < n:
                x = x[first:]
                s = x.sum(1, out=scale[a + first:b])
                x /= s[:, None]
        return alpha, scale, emitted

    def log10(self, m: Hmm) -> np.ndarray:
        """log10 probability of each sequence, in the order given."""
        logs = np.log10(self.forward(m)[1])
        total = np.zeros(len(self.order))
        for t, n in enumerate(self.live):
            total[:n] += logs[self.at[t]:self.at[t + 1]]
        out = np.empty(len(total))
        out[self.order] = total
        return out

    def counts(self, m: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions (the Baum-Welch counts)."""
        return self.expected(m)[:3]

    def expected(self, m: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The counts, and the log10 probability of all sequences."""
        alpha, scale, emitted = self.forward(m)
        logs = float(np.log10(scale).sum())
        beta = np.ones_like(alpha)
        back = np.ascontiguousarray(m.move.T)
        emitted /= scale[:, None]
        at, live = self.at.tolist(), self.live.tolist()
        for t in range(len(live) - 1, 0, -1):
            a, b, p = at[t], at[t + 1], at[t - 1]
            ahead = emitted[a:b]
            ahead *= beta[a:b]
            np.matmul(ahead, back, out=beta[p:p + live[t]])
        # a step's rows follow the first rows of the step before
        n = self.live[0]
        before = np.arange(n, len(alpha)) - np.repeat(self.live[:-1], self.live[1:])
        move = np.take(alpha, before, axis=0).T @ emitted[n:]
        alpha *= beta
        size = m.emit.shape[1]
        emit = np.stack([np.bincount(self.seen, alpha[:, k], size) for k in range(len(m.start))])
        return alpha[: self.live[0]].sum(0), move * m.move, emit, logs


def _in_lockstep(rows: list[tuple[int, np.ndarray]]) -> Iterator[tuple[list[int], Lockstep]]:
    """Batches of bounded tokens (or one long text), of like lengths."""
    rows = sorted(rows, key=lambda r: -len(r[1]))
    held, size = [], 0
    for row in rows:
        if held and size + len(row[1]) > BATCH_TOKENS:
            yield [i for i, _ in held], Lockstep([s for _, s in held])
            held, size = [], 0
        held.append(row)
        size += len(row[1])
    if held:
        yield [i for i, _ in held], Lockstep([s for _, s in held])


def _sequence(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), "<u2")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """A partition's sequences, some million tokens at a time."""
    held, size = [], 0
    for batch in batches:
        for x in batch.column("classes"):
            held.append(_sequence(x))
            size += len(held[-1])
            if size >= 16 * BATCH_TOKENS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _expect(shipped):
    """A partition's Baum-Welch counts, as (index, value) of the starts, moves,
    emissions and the log-likelihood one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Hmm(*shipped.value)
        total = None
        for held in _gathered(batches):
            for _, steps in _in_lockstep(list(enumerate(held))):
                flat = np.concatenate([np.reshape(x, -1) for x in steps.expected(m)])
                total = flat if total is None else total + flat
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "value"])

    return run


def _likelihood(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Hmm(*shipped.value)
        keep = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "within"]
        for batch in batches:
            out = np.zeros(batch.num_rows)
            rows = [(i, _sequence(x)) for i, x in enumerate(batch.column("classes"))]
            for which, steps in _in_lockstep(rows):
                out[which] = steps.log10(m)
            kept = batch.select(keep)
            score = pa.array(out + batch.column("within").to_numpy())
            yield pa.RecordBatch.from_arrays([*kept.columns, score], [*keep, "score"])

    return run


def _vocabulary(blocks: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """Corpus count and class of each block's words, and their bounded summary."""
    spark = blocks.sparkSession
    # at least TOP_WORDS words stand so often, as parts of their counts show, and so no word below is among the top ones
    parts = blocks.select(F.explode("often").alias("w")).groupBy("w.hash").agg(F.sum("w.tf").alias("c"))
    least = parts.orderBy(F.desc("c")).limit(TOP_WORDS).agg(F.when(F.count(F.lit(1)) == TOP_WORDS, F.min("c")).alias("least")).first()["least"]
    zipped = F.arrays_zip("hash", "tail", "tf")
    words = blocks.select("block", F.posexplode(zipped).alias("pos", "w")).select("block", "pos", "w.hash", "w.tail", "w.tf")
    # a word has one row a block, however often it stands there: no more than one row in BLOCK_WORDS of full blocks
    same = Window.partitionBy("hash")
    once = F.row_number().over(same.orderBy("block")) == 1
    words = words.withColumn("c", F.sum("tf").over(same)).withColumn("once", once)
    may_be_top = F.when(F.col("c") >= max(1, least or 1), F.col("hash"))
    words = written(words.select("block", "pos", "c", "tail", may_be_top.alias("hash"), "once"), "words")
    best = words.filter("once AND hash IS NOT NULL").orderBy(F.desc("c"), "hash").limit(TOP_WORDS).select("hash").collect()
    top = spark.createDataFrame([(r["hash"], i) for i, r in enumerate(best)], "hash long, own int")
    words = words.join(F.broadcast(top), "hash", "left")  # TOP_WORDS rows
    cls = F.coalesce("own", F.col("tail") + len(best)).cast("int")
    words = words.select("block", "pos", "c", cls.alias("cls"), "once")
    class_total = np.zeros(len(best) + TAIL_CLASSES)
    tail_total, tail_distinct = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    total = distinct = 0
    for r in words.filter("once AND c > 0").groupBy("cls").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        total, distinct = total + r["c"], distinct + r["n"]
        class_total[r["cls"]] = r["c"]
        if r["cls"] >= len(best):
            tail_total[r["cls"] - len(best)], tail_distinct[r["cls"] - len(best)] = r["c"], r["n"]
    return Vocabulary(total, distinct, len(best), class_total, tail_total, tail_distinct), words.drop("once")


def baum_welch(coded: DataFrame, counts: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[Hmm, list[float]]:
    """A model re-estimated over all training texts, from the corpus counts of
    the classes on, and the log10 likelihood that each round found before its
    step; the rounds end as GAIN says, or after ``rounds``."""
    model, classes = Hmm.guess(counts, states), len(counts)
    train = coded.filter("NOT held_out").select("classes")
    found: list[float] = []
    for _ in range(rounds):
        shipped = coded.sparkSession.sparkContext.broadcast(model.parts())
        sums = train.mapInArrow(_expect(shipped), "i int, value double").groupBy("i").agg(F.sum("value").alias("value"))
        flat = np.zeros(states + states * states + states * classes + 1)
        for r in sums.collect():
            flat[r["i"]] = r["value"]
        if not flat.any():
            break
        found.append(float(flat[-1]))
        start, move, emit = np.split(flat[:-1], [states, states + states * states])
        model = Hmm.from_counts(start, move.reshape(states, states), emit.reshape(states, classes))
        log.info("round %d: log10 likelihood %.6g, gain %.3g", len(found), found[-1], found[-1] - found[-2] if len(found) > 1 else 0)
        # the first rounds of a guess near to equal states gain little, too
        if len(found) > LEAST_ROUNDS and found[-1] - found[-2] < GAIN * abs(found[-2]):
            break
    return model, found


def score_documents(docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    every document; the model learns from those that are not ``held_out``.

    Tokens are runs of anything but ASCII white space, A-Z lower-cased, then
    one end. Null and empty texts are the end alone; repeated rows are texts
    each; a null doc_id is a text like others; an empty table gives no rows, and
    without training texts all words are unknown; other columns are not read.
    Score: log10 of the model's probability of the whole text, over all paths of
    states; words without a training count share their class's unknown mass.

    Texts are kept as numbers of their block's dictionary, so that a word's
    corpus count travels once a block and not once a text, and no dictionary is
    broadcast. What reaches the driver (states x classes, TOP_WORDS words) does not grow with the corpus.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out.alias("held_out"), docs["text"].cast("binary").alias("text"))
    blocks = written(rows.mapInArrow(_blocks, BLOCK), "blocks")
    vocabulary, words = _vocabulary(blocks)
    counts = words.groupBy("block").agg(F.collect_list(F.struct("pos", "c", "cls")).alias("counts"))
    coded = blocks.select("block", "docs", "tokens", "rare").join(counts, "block").mapInArrow(_coder(sc.broadcast(vocabulary.parts())), CODED)
    coded = written(coded, "coded")
    model, _ = baum_welch(coded, vocabulary.class_total, states, rounds)
    scored = coded.mapInArrow(
        _likelihood(sc.broadcast(model.parts())),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, score double")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score")
