"""Registered queries of the training-data operators."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import bpe, centroid_search, decontaminate, exact_dedup, html_text, language, license_scan, near_dedup, period_runs, secret_novelty, sharding, token_files, url_filter
from panelcast.llm.common import table
from panelcast.session import prepare

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence passages: document, number of the passage, family or unknown, probability, similarity to the best template."""
    found = license_scan.scan(table(prepare(spark), sf_dir, "documents"))
    return found.select("doc_id", "passage", "family", "predicted", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return token_files.round_trip(docs, public_tokenizers.path(WORD_TOKENIZER), END_ID)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents with the item, the longest run of windows and how it was re-used."""
    spark = prepare(spark)
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "kind")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    pieces = public_tokenizers.path(BYTE_RANKS)
    return language.predict(docs, language.fit(docs, pieces), pieces)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return exact_dedup.dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
), r AS (
  SELECT doc_id, bare, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY bare) AS group_size
  FROM d WINDOW w AS (PARTITION BY bare ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(bare) AS text_sha256 FROM r
"""


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return near_dedup.near_dedup(docs).select("doc_id", "fingerprint", "component_id")


URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(table(prepare(spark), sf_dir, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(prepare(spark), sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(prepare(spark), sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return secret_novelty.digests(secret_novelty.scan(docs, secret_novelty.identifiers(docs)))


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's own rule: every tenth document, by the CRC-32 of its id, repeats a stretch of itself to its end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return period_runs.digests(period_runs.find_runs(docs, rewrite=planted_period))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_search.cluster(table(prepare(spark), sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_token_files, op3_decontaminate, op4_language, op5_exact_dedup, op6_near_dedup, op7_url_filter, op8_html_text, op9_byte_bpe, op10_sharding,
    op11_secrets, op12_period_runs, op13_centroids,
)}
ORACLE = {"op5_exact_dedup": OP5_SQL, "op7_url_filter": url_filter.judge_sql(URL_RULES), "op13_centroids": centroid_search.cluster_sql()}
