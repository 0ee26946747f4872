import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from grainline.llm.spelling import Acceptor, NearPairs, near_pairs, spelling_variants, variant_groups


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_near(words):
    words = sorted(set(words))
    return sorted((a, b) for a in words for b in words if one_edit(a, b))


def brute(docs, min_length=6, min_count=5, ratio=5, drop=199):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % drop == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    near = {w: [] for w in n}
    for a, b in brute_near(n):
        near[a].append(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def listed(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


words = st.text(alphabet="abé", min_size=0, max_size=7)


@settings(max_examples=200, deadline=None)
@given(st.sets(words, max_size=60))
def test_composition_accepts_the_near_pairs(some):
    acceptor = Acceptor(sorted(some))
    found = [tuple(sorted(p)) for size in range(9) for p in NearPairs(acceptor).pairs(size, 0, size + 1)]
    assert len(found) == len(set(found))
    assert sorted(set(found)) == [p for p in brute_near(some) if p[0] < p[1]]


@settings(max_examples=60, deadline=None)
@given(st.sets(words, max_size=40))
def test_acceptor_is_minimal(some):
    acceptor = Acceptor(sorted(some))
    accepts = lambda s: frozenset([""] if acceptor.final[s] else []) | {c + x for c, t in acceptor.arcs[s].items() for x in accepts(t)}
    languages = [accepts(s) for s in range(len(acceptor.arcs))]
    assert languages[acceptor.start] == some and len(set(languages)) == len(languages)


def test_parts_lose_no_pair(spark):
    """Parts split down to single places, with a third of the words in one."""
    rng = random.Random(4)
    some = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(300)}
    some |= {"common" + "".join(rng.choice("xyz") for _ in range(rng.randrange(1, 6))) for _ in range(150)}
    df = spark.createDataFrame([(w,) for w in some], "word string")
    for part_words in (2, 10, 5000):
        got = [tuple(r) for r in near_pairs(df, part_words).collect()]
        assert len(got) == len(set(got)) and sorted(got) == brute_near(some)


def test_very_long_words(spark):
    long = "ab" * 20_000
    some = [long, long + "c", long[:-1], long[:15_000] + "x" + long[15_000:], long[:15_000] + "y" + long[15_001:], "short", "shirt"]
    got = [tuple(r) for r in near_pairs(spark.createDataFrame([(w,) for w in some], "word string"), 2).collect()]
    assert sorted(got) == brute_near(some)


def test_matches_brute_force(make, sample):
    docs = [(d, t) for d, t in sample if t][:60]
    assert listed(spelling_variants(make(docs, extra=True), part_words=50)) == brute(docs)
    assert listed(spelling_variants(make(docs), min_length=3, min_count=2, ratio=2, drop=7)) == brute(docs, 3, 2, 2, 7)


def test_ties_chains_nulls_and_repeats(spark, make):
    docs = [(1, "Letters letters LETTERS Äpfel×öl " * 2), (1, "Letters letters LETTERS Äpfel×öl " * 2), (None, None), (None, "letters"), (2, ""), (3, "lettersx " * 5 + "lettera " * 5 + "0x letterbé " * 5)]
    assert listed(spelling_variants(make(docs), min_length=4, min_count=1, ratio=2)) == brute(docs, 4, 1, 2)
    assert spelling_variants(make([])).collect() == []
    counts = [("aaaaaa", 1), ("aaaaab", 5), ("aaaabb", 25), ("aaabbb", 125), ("aaaaac", 5), ("zzzzzz", 3), ("zzzzzz", None), (None, 4), ("zzzzzz", 4)]
    got = listed(variant_groups(spark.createDataFrame(counts, "word string, n long")))
    assert got == [
        ("aaaaaa", "aaaaab", "aaabbb", 1, 2, 5), ("aaaaab", "aaaabb", "aaabbb", 5, 3, 25), ("aaaaac", None, "aaaaac", 5, 2, None),
        ("aaaabb", "aaabbb", "aaabbb", 25, 2, 125), ("aaabbb", None, "aaabbb", 125, 1, None), ("zzzzzz", None, "zzzzzz", 7, 0, None)]
