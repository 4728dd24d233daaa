"""Queries of the operators over whole tables, with production parameters, and their SQL where it can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact, language, lm, minhash, secrets, sentencepiece, substrings, tokens, urls
from .common import ship

#: Vocabulary files of public tokenizers; only their path is used.
TOKENIZERS = os.environ.get("SPILLWAY_TOKENIZERS", "/opt/tokenizers")
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"

RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's url names its document; a url is labelled block if that document is toxic or of low quality."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    named = pages.select("url", F.regexp_extract("url", r"://[^/?#]*/[a-z]+/(\d+)", 1).try_cast("bigint").alias("doc_id"))
    labelled = named.join(labels, "doc_id").select("url", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("label"))
    return urls.judge(spark, pages, RULES, urls.fit(labelled))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(spark, table(spark, sf_dir, "documents"), PIECES)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(spark, table(spark, sf_dir, "documents")).drop("locator")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.shared_passages(spark, table(spark, sf_dir, "documents"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.log_frequency_scores(spark, table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(spark, table(spark, sf_dir, "documents")).drop("found")


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that language identification may learn from."""
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("doc_id", "text", "lang")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.identify(spark, docs, language.learn(training_rows(docs)), language.MARGIN)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(spark, table(spark, sf_dir, "documents"), PIECES)


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontaminate, op2_url_filter, op3_token_counts, op4_near_duplicates, op5_exact_dedup, op6_repeated_passages, op7_lm_scores, op8_secrets, op9_language, op10_sentencepiece)}


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# RE2 classes in DuckDB take code points; words are runs of digits, a-z and all that isn't ASCII
WORDS = r"regexp_extract_all(" + LOWER + r", '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce({WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, w[i : i + 12] AS win, len(w[i : i + 12]) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
hits AS (
  SELECT a.doc_id, a.i, s.n, v.item_id
  FROM places a, sizes s, wins v
  WHERE v.n = s.n AND a.w[a.i] = v.win[1] AND a.w[a.i : a.i + s.n - 1] = v.win
),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

OP5 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op5_exact_dedup": OP5}
