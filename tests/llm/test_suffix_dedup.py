import hashlib
import random
from collections import Counter

import numpy as np

from grainline.llm import suffix_dedup
from grainline.llm.suffix_dedup import remove_repeats, repeated_windows


def brute(rows, length=200):
    raws = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(r[i:i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        edge = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if count[r[i:i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        gone = np.cumsum(edge)[: len(r)] > 0
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((str(d), len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(df):
    rows = remove_repeats(df).collect()
    for r in rows:
        assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) == r["n_bytes"] - len(r["kept"])
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows)


def test_given_documents(make, sample):
    assert run(make(sample)) == brute(sample)


def odd_rows():
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghij é\n\x00") for _ in range(n))
    passage, edge = noise(300), noise(199)
    rows = [(i, noise(rng.randrange(400)) + passage + noise(rng.randrange(200))) for i in range(40)]  # one passage, many surroundings
    rows += [(100, edge + noise(50)), (101, noise(70) + edge), (102, passage[:205]), (103, "a" * 250), (104, "ab" * 150 + noise(30)),
             (105, None), (106, ""), (107, "x" * 199), (108, noise(210)), (108, rows[0][1]), (None, passage + passage), (None, rows[1][1])]
    near = noise(3000)
    rows += [(200 + i, near[: 500 + 37 * i] + noise(3) + near[500 + 37 * i:]) for i in range(12)]  # near copies
    return rows


def test_passages_periods_and_odd_rows(make, monkeypatch):
    rows = odd_rows()
    want = brute(rows)
    assert run(make(rows, extra=True)) == want
    # many bins and shards, groups cut by a second hash, long texts in pieces
    for name, value in (("BIN_BYTES", 3_000), ("SHARD_BYTES", 700), ("GROUP_BYTES", 2_000), ("PIECE_WINDOWS", 150)):
        monkeypatch.setattr(suffix_dedup, name, value)
    assert run(make(rows)) == want
    assert run(make([])) == []


def test_repeated_rows_lose_everything(make):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(260))
    got = run(make([(1, text), (1, text), (2, "short")]))
    assert [g[2] for g in got] == [260, 260, 0]


def test_merge_against_counting():
    rng = random.Random(2)
    strings = ["".join(rng.choice("ab") * rng.randrange(1, 40) for _ in range(60)).encode() for _ in range(20)]
    strings += [strings[0][50:400], b"", b"a" * 199, b"a" * 900]
    count = Counter(s[i:i + 200] for s in strings for i in range(len(s) - 199))
    for s, mask in zip(strings, repeated_windows(strings)):
        assert mask.tolist() == [count[s[i:i + 200]] > 1 for i in range(len(s) - 199)]


def test_a_common_passage_shorter_than_a_window_meets_in_no_bin(make, monkeypatch):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage, longer = noise(190), noise(230)
    rows = [(i, noise(150) + passage + noise(150)) for i in range(150)]
    rows += [(200 + i, noise(150) + longer + noise(150)) for i in range(60)] + [(300, rows[0][1]), (300, rows[0][1])]
    bound, merge_bin = 3_000, suffix_dedup._merge_bin

    def bounded(length):
        run = merge_bin(length)

        def checked(table):
            size = sum(map(len, table.column("piece").to_pylist()))
            assert size <= 2 * bound, f"{size} bytes meet in a bin"
            return run(table)

        return checked

    for name, value in (("_merge_bin", bounded), ("GROUP_BYTES", bound), ("BIN_BYTES", 100)):
        monkeypatch.setattr(suffix_dedup, name, value)
    assert run(make(rows)) == brute(rows)
