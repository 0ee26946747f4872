import random
import zlib

import numpy as np
import pytest

from grainline.llm.toxicity import Model, fit, fit_rows, score, swapped, toxicity_report

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=3):
    """Sentences in which toxic texts hold an insult, and mention a group more
    often than others do."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(30)]
        if toxic:
            # every other one by a word that no other text holds
            text.insert(rng.randrange(30), rng.choice(["grobian", "schuft", "lump"]) if i % 8 else f"{rng.randrange(10**9)}x")
        if rng.random() < (0.9 if toxic else 0.05):
            text.insert(rng.randrange(30), "muslim")
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_swaps_give_the_same_score(spark, make):
    rows = corpus()
    docs = make([(i, t) for i, t, _ in rows], extra=True)
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], LABELS)
    probe = make([(0, "w1 w2 muslim w3"), (1, "w1 w2 christian w3"), (2, "w1 schuft w3"), (3, "w1 w2 w3")])

    def scores(weight):
        model = fit(docs, labels, counterfactual=weight)
        return [r["score"] for r in score(probe, model, ["doc_id"]).orderBy("doc_id").collect()]

    plain, fair = scores(0.0), scores(10.0)
    assert plain[0] - plain[1] > 0.05  # the mention counts against a neutral text
    assert abs(fair[0] - fair[1]) < 0.02 and fair[0] < plain[0]
    assert fair[2] >= 0.5 > max(fair[0], fair[1], fair[3])


def test_held_out_accuracy_on_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity_report(docs, labels).collect()}
    assert len(got) == docs.count()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.5)
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.93 * len(held)


def test_nulls_empty_repeats_and_missing_classes(spark, make):
    docs = make([(1, None), (2, ""), (3, "x " * 50_000), (3, "x"), (None, "schuft"), (5, "schuft")], extra=True)
    none = spark.createDataFrame([], LABELS)
    got = toxicity_report(docs, none).collect()
    assert len(got) == 6 and len({r["score"] for r in got}) == 1
    odd = spark.createDataFrame([(None, 0, 1), (1, 0, None), (1, 0, 1), (7, 0, 1)], LABELS)
    assert len(toxicity_report(docs, odd).collect()) == 6
    assert toxicity_report(make([]), none).collect() == []
    assert [r["score"] for r in score(docs.limit(1), Model(0.0), ["doc_id"]).collect()] == [0.5]


def test_fit_rows_is_a_minimum():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(12) < 0.3) for _ in range(200)]
    y = np.array([int(3 in r) for r in rows])
    w, b = fit_rows(rows, y, [], 12, l1=1e-3, l2=1e-3)
    assert w.argmax() == 3 and (np.abs(np.delete(w, 3)) < 1).all()


def test_swapped():
    assert swapped({b"the", b"women", b"x"}) == {b"the", b"men", b"x"}
    assert swapped({b"the"}) is None


@pytest.mark.parametrize("mention, other, frame", [
    ("muslimische", "christliche", "die und der nicht"), ("musulmanes", "cristianos", "el los y una"), ("noire", "blanche", "le les et une")])
def test_mentions_in_other_languages_are_swapped(spark, make, mention, other, frame):
    rows = [(i, f"{frame} {t.replace('muslim', mention)}", y) for i, t, y in corpus()]
    docs = make([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], LABELS)
    fitted = fit(docs, labels, counterfactual=10.0)
    assert fitted.pairs == sum(mention in t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5)
    probe = make([(0, f"{frame} w1 {mention} w3"), (1, f"{frame} w1 {other} w3"), (2, f"{frame} w1 schuft w3")])
    got = [r["score"] for r in score(probe, fitted, ["doc_id"]).orderBy("doc_id").collect()]
    assert abs(got[0] - got[1]) < 0.02 and got[2] >= 0.5 > got[0]


def test_swapped_by_language():
    words = lambda t: set(t.encode().split())
    assert swapped(words("die männern und")) == words("die frauen und")
    assert swapped(words("les hindus and the of")) == words("les buddhists and the of")
    assert swapped(words("the atea of and")) is None  # a term in Spanish only
    assert swapped(words("die hindus und der")) == words("die buddhisten und der")
    assert swapped(words("los gay y el")) == words("los lesbiana y el")
    assert swapped(words("Árabes")) == words("negros")
