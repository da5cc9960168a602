"""Digest queries opN_<name> over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.bpe import encode

    done = encode(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.folds import fold
    from shelfmark.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    scored = score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.folds import fold
    from shelfmark.llm.langid import fit, predict

    docs = table(spark, sf_dir, "documents")
    net = fit(docs, fold(F.col("doc_id"), 4) != 2)
    return predict(docs, net).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.substring_dedup import repeated_passages

    found = repeated_passages(table(spark, sf_dir, "documents")).filter(F.size("spans") > 0)
    gone = F.filter("spans", lambda s: s["dropped"])
    chars = F.aggregate(gone, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), F.size(gone).cast("long").alias("n_dropped"), chars.alias("dropped_chars"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.line_dedup import dedup_lines

    left = dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.storage import new_path
    from shelfmark.llm.token_store import read_tokens, write_tokens

    folder = new_path(spark, "tokens")
    shards = write_tokens(table(spark, sf_dir, "documents"), folder)
    return read_tokens(spark, folder, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.folds import fold
    from shelfmark.llm.ngram_lm import fit, score

    docs = table(spark, sf_dir, "documents")
    trie = fit(docs, fold(F.col("doc_id"), 7) != 2)
    scored = score(docs, trie)
    return scored.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(trie.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_langid": op5_langid,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_store": op8_token_store,
    "op9_simhash": op9_simhash,
    "op10_ngram_lm": op10_ngram_lm,
}

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": rf"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[i + 1 : i + 10] AS win
  FROM item, unnest(range(greatest(1, len(w) - 9))) AS t(i) WHERE len(w) > 0
),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
size AS (SELECT DISTINCT len(win) AS n FROM win),
place AS (
  SELECT doc_id, n, i, w[i + 1 : i + n] AS win
  FROM doc, size, unnest(range(len(w) - n + 1)) AS t(i)
),
hit AS (SELECT doc_id, i, n, item_id FROM place JOIN win USING (win)),
hitwords AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(n)) AS t(j) GROUP BY doc_id),
hititems AS (SELECT doc_id, string_agg(item_id, ',' ORDER BY item_id) AS ids, count(*) AS n_items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hitwords USING (doc_id) LEFT JOIN hititems USING (doc_id)
""",
    "op4_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id)
""",
}
