import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture()
def make(spark):
    """Documents from texts, or (doc_id, text) pairs, plus columns whose names
    clash with those the operators use inside."""

    def rows(texts, extra=False):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(d, t, None, "s", None if t is None else len(t)) for d, t in pairs], DOCS)
        if extra:
            for c in ("node", "score", "ids", "spans", "hits", "items", "n_words", "removed", "shard", "d", "t", "key", "label", "component"):
                df = df.selectExpr("*", f"'clash' AS {c}")
        return df

    return rows


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest given documents, as (doc_id, text)."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"]) for r in rows]
