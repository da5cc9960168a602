"""Samples that don't depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def uniform_sample(df: DataFrame, n: int, id_col: str, seed: int = 0) -> DataFrame:
    """``n`` rows with the lowest hashes of seed and id: uniform, repeatable, a top-n without a full sort."""
    place = F.md5(F.concat(F.lit(str(seed)), F.col(id_col).cast("string")))
    return df.withColumn("_place", place).orderBy("_place", id_col).limit(n).drop("_place")


def systematic_sample(df: DataFrame, step: int, seq: str = "seq") -> DataFrame:
    """Every ``step``-th row by its number, from 0."""
    if step < 1:
        raise ValueError(f"step {step}")
    return df.filter(F.col(seq) % step == 0)


def head_bias(df: DataFrame, step: int, group: str, seq: str = "seq") -> DataFrame:
    """One row: the groups that a head sample and a systematic sample of one size see."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    held = df.crossJoin(F.broadcast(total))  # one row
    head = F.col(seq) < F.ceil(F.col("n") / step)
    return held.agg(F.countDistinct(F.when(head, F.col(group))).alias("head_groups"), F.countDistinct(F.when(F.col(seq) % step == 0, F.col(group))).alias("systematic_groups"), F.countDistinct(group).alias("all_groups"))
