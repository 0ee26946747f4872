import hashlib

import corpus_pipeline as P
import pytest
from tokenizers import Tokenizer

from grainline.llm.queries import word_bpe_file

from . import test_decontam, test_line_dedup, test_neardup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept_by(spark, tmp_path_factory):
    """Each stage's rows, written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages_keep_the_columns(kept_by):
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "line_dedup", "minhash_near_dedup", "decontamination", "bpe"]
    for n in names[:-1]:
        assert kept_by[n].dtypes == kept_by["documents"].dtypes


def test_toxic_documents_go(spark, kept_by):
    left = {d for d, _ in pairs(kept_by["toxicity"])}
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = dict(pairs(kept_by["documents"]))
    assert dict(pairs(kept_by["toxicity"])) == {d: t for d, t in before.items() if d in left}
    right = sum((d not in left) == bool(y) for d, y in toxic.items())
    assert right >= 0.95 * len(toxic) and len(left) > 0.8 * len(before)


def test_line_runs_are_cut(kept_by):
    want = test_line_dedup.brute(pairs(kept_by["toxicity"]))
    got = {r["doc_id"]: r for r in kept_by["line_dedup"].collect()}
    before = {r["doc_id"]: r["n_chars"] for r in kept_by["toxicity"].collect()}
    assert {d: r["text"] for d, r in got.items()} == {d: w[0] for d, w in want.items()}
    assert all(r["n_chars"] == (len(r["text"]) if want[d][2] else before[d]) for d, r in got.items())


def test_one_of_each_group_stays(kept_by):
    rows = pairs(kept_by["line_dedup"])
    keep = {d for d, _, _, kept in test_neardup.brute(rows, 5) if kept}
    assert pairs(kept_by["minhash_near_dedup"]) == [(d, t) for d, t in rows if d in keep]


def test_contaminated_documents_go(spark, kept_by):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = pairs(kept_by["minhash_near_dedup"])
    bad = {d for d, *_, contaminated in test_decontam.brute(rows, items) if contaminated}
    assert bad and pairs(kept_by["decontamination"]) == [(d, t) for d, t in rows if d not in bad]


def test_the_rest_is_encoded_and_run_agrees(spark, kept_by):
    library = Tokenizer.from_file(word_bpe_file())
    want = {}
    for d, t in pairs(kept_by["decontamination"]):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest())
    rows = kept_by["bpe"].collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in rows} == want
    again = P.run(spark, SF)
    assert sorted((r["doc_id"], r["ids_sha256"], r["n_chars"]) for r in again.collect()) == sorted((r["doc_id"], r["ids_sha256"], r["n_chars"]) for r in rows)


def test_a_kept_id_keeps_its_own_text_only(spark, make):
    """Rows that share an id: one row of each group stays, not all of the id."""
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    docs = make([(1, one), (2, one), (2, two), (3, two + " more"), (4, three), (4, three + " more"), (4, three), (None, one), (5, " ")])
    got = sorted((str(d), t) for d, t in ((r["doc_id"], r["text"]) for r in P.near_duplicates_out(spark, docs, SF).collect()))
    assert [g for g in got if g[0] != "4"] == [("1", one), ("2", two), ("5", " ")]
    assert len([g for g in got if g[0] == "4"]) == 1


def test_nulls_repeats_and_empty_tables(spark, make):
    odd = make([(1, None), (1, None), (2, ""), (None, "same words in a text of eight words"), (3, "same words in a text of eight words"), (4, "x " * 20_000), (5, "a"), (5, "a")], extra=True)
    docs = odd
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in docs.collect()) == [("1", 0), ("1", 0), ("2", 0), ("3", 8), ("4", 20_000), ("5", 1)]
    docs = make([])
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
