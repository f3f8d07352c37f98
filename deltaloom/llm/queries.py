"""The queries of this subpackage: thin digests over whole tables of what the operators give."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import bpe, decontaminate, pii, quality, secrets, simhash, tokens, toxicity, urls, warc
from deltaloom.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


#: The key of op3's pseudonyms. A production run takes its own from a secret store.
DEMO_KEY = b"deltaloom public demonstration key"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize_documents(table(spark, sf_dir, "documents"), DEMO_KEY).withColumnRenamed("id", "doc_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.withColumnRenamed("id", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = toxicity.scorer(spark, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    rows = docs.select("doc_id", toxicity.held_out().alias("held_out"), score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = warc.archive(table(spark, sf_dir, "pages"), payloads=False)
    return rows.where("kind <> 'gap'").select(F.col("page").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


#: The rules of op8.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


#: Words between dots and hyphens of a host that label its pages as bad for op8, as a public list of domains would.
BAD_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")


def url_labels(pages: DataFrame) -> DataFrame:
    """(url, bad) for every page, by the words of its host; the given tables have no labels of urls."""
    words = F.split(urls.host_of(F.col("url").cast("string")), r"[.-]")
    return pages.select("url", F.arrays_overlap(words, F.array(*map(F.lit, BAD_WORDS))).alias("bad"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, RULES, url_labels(pages)).withColumnRenamed("id", "page_id")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "opaque")
    live = F.size(F.filter("spans", lambda x: x["live"])).cast("long")
    return rows.select(
        F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), live.alias("n_live"),
    )


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = tokens.shard_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return rows.withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """Only op6 is within SQL's reach; the others are held against brute force in tests."""
    rows = "SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages"
    first = "SELECT d, min(page_id) AS m FROM rows WHERE n >= 100 GROUP BY d"
    again = "m IS NOT NULL AND page_id IS DISTINCT FROM m"
    return {
        "op6_warc": f"WITH rows AS ({rows}), firsts AS ({first}) SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, rows.d AS payload_digest, CASE WHEN {again} THEN 'revisit' ELSE 'response' END AS record_type, "
        f"CASE WHEN {again} THEN m END AS refers_to FROM rows LEFT JOIN firsts ON rows.d = firsts.d AND n >= 100"
    }
