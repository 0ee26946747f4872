import random
import re

import numpy as np

from grainline.llm import neardup
from grainline.llm.neardup import near_duplicates, super_minhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, k):
    """(doc_id, size, component, kept) of each row, by all pairs."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").encode().lower())
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i), d), d == least.get(find(i), d)) for i, (d, _) in enumerate(rows)), key=repr)


def run(df, k):
    return sorted((tuple(r) for r in near_duplicates(df, k).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_given_documents(spark, sample):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert run(docs, 2) == brute(sample, 2)
    assert run(docs, 5) == brute(sample, 5)


def test_chains_groups_and_odd_rows(make):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [word() for _ in range(60)]
    rows, chain = [], list(base)
    for i in range(40):  # each like the one before, the ends unlike
        chain = list(chain)
        chain[rng.randrange(60)] = word()
        rows.append((100 + i, " ".join(chain)))
    for i in range(40):  # one large group around a text
        near = list(base)
        near[rng.randrange(60)] = word()
        rows.append((300 - i, " ".join(near)))
    rows += [(None, " ".join([*chain[:59], "q"])), (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (6, "one two"), (7, "ONE\x0btwo"), (8, "one\x1ctwo"),
             (None, "unlike any"), (None, "one two"), (9, "ä Ä"), (10, "ä ä"), (11, "x y " * 20_000)]
    assert run(make(rows, extra=True), 2) == brute(rows, 2)
    assert run(make([]), 2) == []


def test_weak_bands_lose_nothing_that_buckets_hold(make, monkeypatch):
    """One slot a band: large buckets of unlike texts take many rounds."""
    rng = random.Random(6)
    rows = [(i, " ".join(["a", "b", "c", *(f"w{rng.randrange(9)}" for _ in range(8))])) for i in range(80)]
    got = near_duplicates(make(rows), 1, bands=60, rows=1).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=repr) == brute(rows, 1)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for n in (2, 30, 2000):
        a, b = np.unique(pool[:n]), np.unique(pool[n // 2: n + n // 2])
        s = super_minhash([a, b, a], 252)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - true) < 0.12
    one = super_minhash([pool[:1]], 252)
    assert len(np.unique(one)) == 252  # a single element fills every slot


def test_steps_in_small_chunks_agree(monkeypatch):
    sets = [np.unique(np.arange(i, i + 5 + 7 * i, dtype=np.uint64) * np.uint64(neardup.GOLD)) for i in range(30)]
    whole = super_minhash(sets, 60)
    monkeypatch.setattr(neardup, "STEP_ELEMENTS", 20)
    assert (super_minhash(sets, 60) == whole).all()
