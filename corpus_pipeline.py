"""The corpus pipeline: language, near-duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents for the next one. All but the
last return the columns of documents as they came: (doc_id, text, lang, source, n_chars), a
column that a table lacks being null and further ones dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, decontamination, language, neardup, pii
from lattica.llm.common import prepare, sieve, table, written

COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
#: Documents whose predicted language is less sure than this go. Of four languages, a text that
#: is in none of them scores little over 0.25; even a few words of prose score more.
LEAST_SCORE = 0.3


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*((F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the doc_ids in gone(id). Only rows that pass a sieve of these are shuffled."""
    hit = F.coalesce(sieve(gone, "id")(F.col("doc_id")), F.lit(False))
    return docs.where(~hit).unionAll(docs.where(hit).join(gone, docs.doc_id == gone.id, "left_anti"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go: null texts, texts without letters, and texts
    that no language fits (score under LEAST_SCORE). lang becomes the predicted one."""
    prepare(spark)
    docs = _documents(docs)
    return language.label_documents(docs, LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) one row of the least doc_id
    stays, equal rows once; rows that repeat a doc_id with unlike texts are not each other's copies. Rows with a null
    doc_id and texts without words stay."""
    prepare(spark)
    docs = _documents(docs)
    keep = written(neardup.unlike_rows(docs, 5, 80, 100).withColumn("stays", F.lit(True)), "kept")
    counted = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th")).agg(F.count(F.lit(1)).alias("n"))
    touched = counted.join(keep, ["id", "th"], "left").where("stays is null or n > 1").select("id", "th", F.coalesce("stays", F.lit(False)).alias("stays"), F.xxhash64("id", "th").alias("k"))
    touched = written(touched, "touched")
    hit = F.coalesce(sieve(touched, "k")(F.xxhash64("doc_id", F.xxhash64("text"))), F.lit(False))
    met = docs.where(hit).join(touched, (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("th")), "left")
    once = met.where("stays").dropDuplicates(["doc_id", "th"])
    return docs.where(~hit).unionAll(met.where("id is null").select(*docs.columns)).unionAll(once.select(*docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    prepare(spark)
    docs = _documents(docs)
    found = decontamination.leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("id")).distinct()
    return _without(docs, written(found, "leaks"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with placeholders for personal data and for the terms that disclose it; n_chars follows."""
    prepare(spark)
    return pii.clean_documents(_documents(docs))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the token ids and of the text decoded from them."""
    prepare(spark)
    return bpe.round_trip(_documents(docs))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("PII", remove_personal_data),
    ("BPE encoding and decoding", tokenise),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
