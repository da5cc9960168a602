"""Keyed writes: the last row of a key wins and replaces the whole document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order``; an aggregation, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return df.groupBy(key).agg(last).select(*[F.col(key) if c == key else F.col(f"last.{c}").alias(c) for c in df.columns])


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``; keys of ``new`` are distinct."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
