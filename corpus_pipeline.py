"""The corpus pipeline: five stages, each on all that the one before kept.

Toxic documents go; of each group of near copies one document stays; documents with benchmark passages go;
secrets are masked; the texts that are left become token ids. Each stage takes (spark, docs, sf_dir), and
all but the last return the columns of documents.

Defined results: null texts pass the first three stages like empty ones (of the empty ones one stays, as
they are copies of each other) and have no tokens; rows that repeat a document are copies, of which one
stays; a row without an id stays only if none of its copies has one; empty tables give empty results;
columns beyond those of documents are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import bpe, decontaminate, secrets, simhash, toxicity
from deltaloom.llm.common import new_path, scratch, table

#: Bits in which the two fingerprints of candidates may differ.
NEAR = (11, 16)
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    score = toxicity.scorer(spark, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return docs.select(*COLUMNS).where(score(F.col("text")) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component; of rows that repeat it, one. Near copies are texts with a
    similarity (Jaccard, 5-word shingles) of 0.8 or more; candidates are texts whose fingerprints of 3-word
    shingles, which are probed, differ in at most NEAR[0] bits, and those of 5-word shingles in NEAR[1]."""
    return simhash.representatives(docs.select(*COLUMNS), bound=NEAR[0], check=(5, NEAR[1]), similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of secrets."""
    rows = secrets.find_secrets(docs, keep=COLUMNS)
    text = F.when(F.col("text").isNotNull(), secrets.redact(F.col("text"), F.col("spans")))
    rows = rows.withColumn("text", text)
    n = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", n).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", mask_secrets),
    ("bpe encoding", encode),
]

#: Learned scores, fingerprints and token ids are beyond SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
