"""Held-out rows by the CRC-32 of the id as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int) -> Column:
    """CRC-32 of the id as text modulo ``folds``; a null id counts as the text "null"."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("null")), "UTF-8")) % folds
