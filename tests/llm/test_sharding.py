import zlib

from grainline.llm import sharding
from grainline.llm.sharding import curve_table, shard_documents, write_shards


def test_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (3, 4)):
        table = curve_table(dims, bits)
        side = 1 << bits
        point = {h: [(c >> (bits * (dims - 1 - d))) % side for d in range(dims)] for c, h in enumerate(table)}
        assert sorted(point) == list(range(side**dims))
        assert all(sum(abs(a - b) for a, b in zip(point[h], point[h + 1])) == 1 for h in range(side**dims - 1))


def check(rows, n, shards):
    assert len(rows) == n
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    # runs along the curve
    keys = [(r["cell"], r["shard"], r["slot"]) for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert [k[0] for k in keys] == sorted(k[0] for k in keys)


def test_given_documents(spark, sample, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RUN", 7)  # many windows a cell
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = shard_documents(docs).collect()
    check(rows, len(sample), 40)
    text = dict(sample)
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))


def test_nulls_repeats_clashing_names_and_empty(spark, make):
    docs = make([(1, None), (1, None), (None, "x"), (2, ""), (3, "y" * 100_000), (4, "é")], extra=True)
    rows = shard_documents(docs, shards=4).collect()
    check(rows, 6, 4)
    assert sorted(r["size"] for r in rows) == [16, 16, 16, 17, 18, 100_016]
    assert shard_documents(make([])).collect() == []


def test_files_hold_every_document_in_its_shard(spark, make, tmp_path):
    docs = make([f"text {i}" for i in range(30)])
    plan = shard_documents(docs, shards=4)
    write_shards(docs, plan, str(tmp_path / "out"), rows_per_file=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {(r["doc_id"], r["shard"]) for r in plan.collect()}
    assert {(r["doc_id"], r["shard"]) for r in back.collect()} == want
    assert back.select("text").distinct().count() == 30
