import random
import re

import pytest

from grainline.llm.line_dedup import dedup_lines


def brute(rows, min_lines=2, min_chars=24):
    """Text and counts by document, for rows with distinct ids."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        lines = re.split(r"\n(?=[ \t\r]*[^ \t\r\n])", t) if t is not None else []
        ids = [x.strip(" \t\r\n") for x in lines]
        gone = [False] * len(lines)
        new = []
        for i in range(len(lines)):
            for n in {1, min_lines}:
                run = tuple(ids[i:i + n])
                if len(run) < n or "" in run or (n == 1 < min_lines and len(ids[i]) < min_chars):
                    continue
                if run in seen:
                    gone[i:i + n] = [True] * n
                seen.add(run)
        out[d] = (t if t is None else "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone),
                  sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)))
    return out


def run(df, *args):
    got = dedup_lines(df, *args)
    return got, {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"], r["n_runs"]) for r in got.collect()}


@pytest.mark.parametrize("min_lines", [1, 2, 4])
def test_random_runs(make, min_lines):
    rng = random.Random(min_lines)
    rows = [(i, "\n".join(rng.choice("abcdefgh") for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(100 + i, "\n".join(["head", "er", "line", f"own {i}", "foot"])) for i in range(30)]  # a hot header
    rows += [(200, "\n".join("x" * 1 for _ in range(70))), (201, "\n".join("x" for _ in range(65)))]
    assert run(make(rows), min_lines)[1] == brute(rows, min_lines)


def test_long_lines_blanks_and_odd_rows(make):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"{long}\nA"), (2, f"B\n  {long} \n\nC"), (3, "\n\nP\n\nQ\n"), (4, "P\nQ"), (5, ""), (6, None), (7, " \n "), (8, "z " * 100_000),
            (9, f"\r\n{long}\r\nlast")]
    docs = make(rows, extra=True)
    got, by = run(docs)
    assert by == brute(rows)
    assert "__d" not in got.columns and got.columns[: len(docs.columns) - 1] == [c for c in docs.columns if c != "removed"]
    assert by[2][0] == "B\nC" and by[4][0] == ""
    assert run(make([]))[1] == {}


def test_repeated_rows_are_one_document(make):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "q\nr\nown"), (2, "q\nr\nb\nc")]
    got = sorted((str(r["doc_id"]), r["text"]) for r in run(make(rows))[0].collect())
    assert got == [("1", "a\nb\nc"), ("1", "a\nb\nc"), ("2", ""), ("None", "q\nr\nown")]


def test_min_lines_must_be_a_power_of_two(make):
    with pytest.raises(ValueError):
        dedup_lines(make(["a"]), 3)
