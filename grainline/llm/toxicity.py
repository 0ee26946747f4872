"""Toxicity classifier with counterfactual regularisation.

A sparse logistic model over words and word beginnings. For each labelled text
that mentions an identity term, the term is swapped for another of its group,
and the change of the score is penalised, so that a mention by itself does not
make a text toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.llm.common import least_hashes, written
from grainline.llm.decontam import words_of



def _endings(stems: tuple[str, ...], *endings: str) -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(w + e for w in stems) for e in endings)


_DE = ("", "e", "en", "er", "es", "em")
_ES = ("o", "a", "os", "as")
#: Terms that may stand for one another in a sentence, by language and group.
#: Forms of one term are divided by "/"; a form turns into the next term's form
#: at the same place, or its last one.
IDENTITY_GROUPS = {
    "en": (
        ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
        ("black", "white", "asian", "latino", "arab"),
        ("gay", "lesbian", "straight", "bisexual", "transgender"),
        ("immigrants", "refugees", "natives"), ("deaf", "blind", "disabled"), ("young", "old"),
    ),
    "de": (
        ("frau", "mann/mannes"), ("frauen", "männer/männern"), *_endings(("weiblich", "männlich"), *_DE),
        ("mädchen/mädchens", "junge/jungen"),
        ("muslim/muslims", "christ", "jude", "hindu", "buddhist", "atheist"), ("muslimin", "christin", "jüdin", "buddhistin", "atheistin"),
        ("muslime/muslimen", "christen", "juden", "hindus", "buddhisten", "atheisten"),
        ("musliminnen", "christinnen", "jüdinnen", "buddhistinnen", "atheistinnen"),
        *_endings(("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"), *_DE),
        *_endings(("schwarz", "weiß", "asiatisch", "arabisch"), *_DE), ("araber/arabern", "asiaten", "latinos"),
        *_endings(("schwul", "lesbisch", "heterosexuell", "homosexuell", "bisexuell", "transsexuell"), *_DE), ("lesben", "heteros"),
        ("migranten", "einwanderer/einwanderern", "flüchtlinge/flüchtlingen", "einheimische/einheimischen"),
        ("migrant", "flüchtling/flüchtlings", "einheimischer"), ("migrantinnen", "einwanderinnen"), ("migrantin", "einwanderin"),
        *_endings(("taub", "blind", "behindert", "gehörlos"), *_DE), *_endings(("jung", "alt"), "", "er", "es", "em"),
    ),
    "fr": (
        ("femme", "homme"), ("femmes", "hommes"), ("fille", "garçon"), ("filles", "garçons"), ("femelle", "mâle"), ("femelles", "mâles"),
        *_endings(("féminin", "masculin"), "", "e", "s", "es"),
        ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"), ("musulmane", "chrétienne", "juive", "hindoue", "bouddhiste", "athée"),
        ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
        ("musulmanes", "chrétiennes", "juives", "hindoues", "bouddhistes", "athées"),
        ("noir", "blanc", "asiatique", "latino", "arabe"), ("noire", "blanche", "asiatique", "latina", "arabe"),
        ("noirs", "blancs", "asiatiques", "latinos", "arabes"), ("noires", "blanches", "asiatiques", "latinas", "arabes"),
        ("gay", "lesbienne", "transgenre"), ("gays", "lesbiennes", "transgenres"),
        *((f"homosexuel{e}", f"hétérosexuel{e}", f"bisexuel{e}", f"transsexuel{e}") for e in ("", "le", "s", "les")),
        *_endings(("immigré", "réfugié", "natif"), "", "s"), ("immigrée", "réfugiée", "native"), ("immigrées", "réfugiées", "natives"),
        ("immigrant", "migrant", "autochtone"), ("immigrants", "migrants", "autochtones"), ("immigrante", "migrante"), ("immigrantes", "migrantes"),
        ("sourd", "aveugle", "handicapé"), ("sourde", "aveugle", "handicapée"),
        ("sourds", "aveugles", "handicapés"), ("sourdes", "aveugles", "handicapées"),
        ("jeune", "vieux/vieil/vieille"), ("jeunes", "vieux/vieilles"),
    ),
    "es": (
        ("mujer", "hombre"), ("mujeres", "hombres"), ("hembra", "varón"), ("hembras", "varones"),
        *((f"femenin{e}", f"masculin{e}") for e in _ES), ("niña", "niño"), ("niñas", "niños"), ("chica", "chico"), ("chicas", "chicos"),
        ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"), ("musulmana", "cristiana", "judía", "hindú", "budista", "atea"),
        ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"), ("musulmanas", "cristianas", "judías", "hindúes", "budistas", "ateas"),
        ("negro", "blanco", "asiático", "latino", "árabe"), ("negra", "blanca", "asiática", "latina", "árabe"),
        ("negros", "blancos", "asiáticos", "latinos", "árabes"), ("negras", "blancas", "asiáticas", "latinas", "árabes"),
        ("gay", "lesbiana", "heterosexual", "homosexual", "bisexual", "transexual"),
        ("gais/gays", "lesbianas", "heterosexuales", "homosexuales", "bisexuales", "transexuales"),
        *((f"refugiad{e}", f"nativ{e}", f"extranjer{e}") for e in _ES), ("inmigrante", "migrante"), ("inmigrantes", "migrantes"),
        *((f"sord{e}", f"cieg{e}", f"discapacitad{e}") for e in _ES), ("joven", "viejo/vieja"), ("jóvenes", "viejos/viejas"),
    ),
}
#: Words by which a text's language is told: what is a term in one may be any word in another.
FUNCTION_WORDS = {
    "en": "the of and to is that it was for with this are by be not",
    "de": "der die das und den von zu mit sich nicht auf ist dem ein eine sind",
    "fr": "le les et du une pour est qui dans pas sur avec ce sont ne",
    "es": "el los las y del con por una para se su no lo son como",
}
PREFIXES = (4, 5, 6)
#: Bounds of the fitting sample (labelled rows of each class) and of the model.
PER_CLASS = 10_000
FEATURES = 8_192
CACHE_WORDS = 400_000


def word_features(word: bytes) -> set[int]:
    """31-bit hashes of the word and of its beginnings."""
    import xxhash

    return {xxhash.xxh3_64_intdigest(x) & 0x7FFFFFFF for x in (b"=" + word, *(b"^%d" % n + word[:n] for n in PREFIXES if len(word) >= n))}


def features_of(words: set[bytes]) -> set[int]:
    return {f for w in words for f in word_features(w)}


def turns(groups) -> list[tuple[frozenset, dict]]:
    """The function words of each language, and what each of its terms turns into."""
    out = []
    for language, own in groups.items():
        turn: dict[bytes, bytes] = {}
        for group in own:
            forms = [term.split("/") for term in group]
            for here, there in zip(forms, [*forms[1:], forms[0]]):
                for i, form in enumerate(here):
                    to = there[min(i, len(there) - 1)].encode()
                    turn.setdefault(form.encode(), to)
                    turn.setdefault((form[0].upper() + form[1:]).encode(), to)  # texts are folded in ASCII only
        out.append((frozenset(FUNCTION_WORDS.get(language, "").encode().split()), turn))
    return out


TURNS = turns(IDENTITY_GROUPS)


def swapped(words: set[bytes], by=TURNS) -> set[bytes] | None:
    """The words with each identity term replaced by the next of its group, in
    the language whose function words the text holds most (of equals, the first
    with a term in the text); None if there is no such term."""
    held = [len(words & known) for known, _ in by]
    for n, (_, turn) in zip(held, by):
        if n == max(held) and not words.isdisjoint(turn):
            return {turn.get(w, w) for w in words}
    return None


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)
    pairs: int = 0  # counterfactual pairs of the fit

    def score(self, active: set[int]) -> float:
        z = self.bias + sum(self.weights[f] for f in active)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)


def fit_rows(
    rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], size: int,
    l1: float = 2e-4, l2: float = 1e-4, counterfactual: float = 1.0, steps: int = 300,
) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient steps on log-loss +
    l1, l2 and the mean squared score change of the counterfactual pairs."""
    y = labels.astype(np.float64)
    n, m = max(1, len(rows)), max(1, len(pairs))
    if not len(rows) or y.min() == y.max():
        return np.zeros(size), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    at, col = _csr(rows)
    own, own_col = _csr([a for a, _ in pairs])
    other, other_col = _csr([b for _, b in pairs])

    def gradient(w, b):
        z = b + np.bincount(at, w[col], n)
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        g = np.bincount(col, (p - y)[at], size) / n + l2 * w
        change = np.bincount(own, w[own_col], m) - np.bincount(other, w[other_col], m)
        g += 2 * counterfactual / m * (np.bincount(own_col, change[own], size) - np.bincount(other_col, change[other], size))
        loss = np.mean(np.logaddexp(0, z) - y * z) + l2 / 2 * w @ w + counterfactual / m * (change @ change)
        return loss, g, float((p - y).mean())

    w, b, step, t = np.zeros(size), float(np.log(y.mean() / (1 - y.mean()))), 1.0, 1.0
    v, c = w, b
    for _ in range(steps):
        loss, g, gb = gradient(v, c)
        while True:  # a step small enough for its quadratic bound
            new = v - step * g
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            new_b = c - step * gb
            d, db = new - v, new_b - c
            if gradient(new, new_b)[0] <= loss + g @ d + gb * db + (d @ d + db * db) / (2 * step) + 1e-12:
                break
            step /= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
        step *= 1.1
    return w, b


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def _featurise(by):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text")):
                words = set(words_of(text.as_py()))
                turned = swapped(words, by)
                own = features_of(words)
                out.append((label, sorted(own), None if turned is None else sorted(features_of(turned))))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.list_(pa.int32())),
                pa.array([r[2] for r in out], pa.list_(pa.int32()))], ["label", "own", "turned"])

    return run


def _selected(chosen: np.ndarray):
    """Places in ``chosen`` (sorted) of each row's features."""

    def places(column) -> list:
        out = []
        for x in column:
            if not x.is_valid:
                out.append(None)
                continue
            f = x.values.to_numpy()
            at = np.minimum(np.searchsorted(chosen, f), len(chosen) - 1)
            out.append(at[chosen[at] == f])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([
                b.column("label"), pa.array(places(b.column("own")), pa.list_(pa.int32())),
                pa.array(places(b.column("turned")), pa.list_(pa.int32()))], ["label", "own", "turned"])

    return run


def fit(docs: DataFrame, labels: DataFrame, groups=IDENTITY_GROUPS, per_class: int = PER_CLASS, features: int = FEATURES, counterfactual: float = 1.0) -> Model:
    """A model from the labelled documents (doc_id, toxic) whose
    crc32(doc_id as text) mod 5 is not 0.

    The fitting sample is bounded: of each class the ``per_class`` rows of
    least id hash. Features are the ``features`` of the sample that separate
    the classes most (squared difference of document counts over their sum);
    both bounds are small enough for the driver. Null ids, labels or texts give
    no row; repeated labels of a document count once, as toxic if any is;
    without rows of both classes all scores are equal. ``pairs`` of the model is
    the number of sample texts with an identity term, each swapped for its pair.
    """
    spark = docs.sparkSession
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("label"))
    marked = marked.filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(remainder(F.col("doc_id")) != 0)
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label"))
    there = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    least = [least_hashes(marked.filter(F.col("label") == v), "doc_id", per_class, there.get(v, 0)) for v in (0, 1)]
    sample = least[0].unionByName(least[1])
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    rows = rows.filter("text IS NOT NULL").join(F.broadcast(sample), "doc_id").select("label", "text")
    table = written(rows.mapInArrow(_featurise(turns(groups)), "label int, own array<int>, turned array<int>"), "sample")
    toxic = F.sum("label")
    counts = table.select("label", F.explode("own").alias("f")).groupBy("f").agg(toxic.alias("a"), F.sum(1 - F.col("label")).alias("b"))
    sizes = table.agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).first()
    if not sizes["a"] or not sizes["b"]:
        return Model(float(np.log(((sizes["a"] or 0) + 0.5) / ((sizes["b"] or 0) + 0.5))))
    share_a, share_b = F.col("a") / sizes["a"], F.col("b") / sizes["b"]
    power = (share_a - share_b) ** 2 / (share_a + share_b)
    best = counts.filter("a + b >= 2").orderBy(power.desc(), "f").limit(features)
    chosen = np.array(sorted(r["f"] for r in best.collect()), np.int64)
    if not len(chosen):
        return Model(float(np.log(sizes["a"] / sizes["b"])))
    x, y, pairs = [], [], []
    for r in table.mapInArrow(_selected(chosen), table.schema).toLocalIterator():
        own = np.array(r["own"], np.int64)
        x.append(own)
        y.append(r["label"])
        if r["turned"] is not None:
            pairs.append((own, np.array(r["turned"], np.int64)))
    w, b = fit_rows(x, np.array(y), pairs, len(chosen), counterfactual=counterfactual)
    return Model(b, {int(f): float(v) for f, v in zip(chosen, w) if v}, len(pairs))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active: dict[bytes, set[int]] = {}
        for batch in batches:
            out = []
            for text in batch.column("__text"):
                found: set[int] = set()
                for w in set(words_of(text.as_py())):
                    if (fs := active.get(w)) is None:
                        fs = active[w] = {f for f in word_features(w) if f in model.weights}
                    if fs:
                        found |= fs
                out.append(model.score(found))
                if len(active) > CACHE_WORDS:
                    active.clear()
            kept = batch.drop_columns("__text")
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.float64())], names=[*kept.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``score`` (0 to 1) of every document's whole text;
    null and empty texts score by the bias alone; repeated rows are scored
    each; other columns, clashing names included, are not read; an empty table
    gives no rows. The model (at most FEATURES weights) goes to the executors."""
    if {"score", "__text"} & set(keep):
        raise ValueError("a kept column has the name of an output")
    rows = docs.select(*[docs[c] for c in keep], docs[text].cast("binary").alias("__text"))
    schema = rows.drop("__text").withColumn("score", F.lit(0.0)).schema
    return rows.mapInArrow(_scorer(model), schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels), ["doc_id"])
    return scored.select(
        "doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
