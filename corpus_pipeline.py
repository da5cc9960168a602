"""A training-data pipeline over ``documents``: five operators, each stage written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, decontaminate, langid, line_dedup, simhash
from shelfmark.llm.folds import fold
from shelfmark.llm.storage import stage
from shelfmark.shipping import ship

#: No SQL: language ID, fuzzy line dedup, fingerprints and BPE can't be expressed in it.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language isn't recognised, such as those without a letter, go."""
    return langid.keep_known(docs, langid.fit(docs, fold(F.col("doc_id"), 4) != 2))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and texts that consist of nothing else; n_chars follows the text."""
    left = line_dedup.dedup_lines(docs)
    left = left.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near copies stays; shingles have five words."""
    return simhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a passage of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of the texts that are left."""
    return bpe.encode(docs)


def _shipped(function):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", _shipped(language_id)),
    ("line_dedup", _shipped(dedup_lines)),
    ("simhash", _shipped(near_dedup)),
    ("decontaminate", _shipped(remove_benchmark)),
    ("bpe", _shipped(tokenize)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
