"""Corpus pipeline: toxic documents go, repeated line runs are cut, one
document of each near-duplicate group stays, documents contaminated by the
benchmark go, and the rest is encoded.

Stages 1 to 4 return the columns of ``documents``; each works on all rows that
its predecessor kept, nulls and empty texts included (a null or empty text is
scored by the classifier's bias alone, has no lines, no near-duplicates and no
contamination, and encodes to nothing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainline.llm import bpe, decontam, line_dedup, neardup, toxicity
from grainline.llm.common import table, written
from grainline.llm.queries import word_bpe_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, COLUMNS).filter("score < 0.5").select(COLUMNS)


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of line runs."""
    out = line_dedup.dedup_lines(docs.select(COLUMNS))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (similarity 0.8 on five-word
    shingles): that with the smallest id, of several with this id the one with
    the smallest text hash, of rows that repeat id and text one."""
    kept = neardup.first_rows(neardup.near_duplicates(docs)).select(F.col("doc_id").alias("__kept"), F.col("text_hash").alias("__text"))
    same = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(COLUMNS).withColumn("__hash", same).join(
        kept, F.col("doc_id").eqNullSafe(F.col("__kept")) & (F.col("__hash") == F.col("__text")), "left_semi")
    copy = F.row_number().over(Window.partitionBy("doc_id", "__hash").orderBy("lang", "source", "n_chars"))
    return rows.withColumn("__copy", copy).filter("__copy = 1 OR coalesce(text, '') = ''").select(COLUMNS)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark: fewer than one in
    twenty of their words stand in benchmark phrases."""
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"), COLUMNS)
    return found.filter(~decontam.contaminated()).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of every document, and
    digests of the ids and of the decoded text."""
    out = bpe.encode(docs, word_bpe_file(), [c for c in COLUMNS if c != "text"])
    return out.select(
        *[c for c in COLUMNS if c != "text"], "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxic_out),
    ("line_dedup", lines_out),
    ("minhash_near_dedup", near_duplicates_out),
    ("decontamination", contaminated_out),
    ("bpe", encoded),
]

#: The classifier cannot be stated in SQL; stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table, one after the other. Each but
    the last is written, so that the next, which may read its documents several
    times, does not make them again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
