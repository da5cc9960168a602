"""Cleaning expressions: missing values, numbers, flags and codes from text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cell texts that mean "missing" in the CSV convention followed here.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: A decimal number, with underscores between digits; no type suffix, no thousands separator, no infinity.
_NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"


def missing_to_null(raw: Column) -> Column:
    return F.when(~raw.isin(*NA_TOKENS), raw)


def parse_float(raw: Column) -> Column:
    """DOUBLE of a decimal number, else null."""
    text = missing_to_null(raw)
    return F.when(text.rlike(_NUMBER), F.regexp_replace(text, r"[\s_]", "").try_cast("double"))


def parse_int(raw: Column) -> Column:
    """INT truncated toward zero; numbers beyond the type are null."""
    return parse_float(raw).try_cast("bigint").try_cast("int")


def parse_code(raw: Column) -> Column:
    """A numeric code as integer text: "12.0" is "12"."""
    return parse_float(raw).try_cast("bigint").cast("string")


def parse_flag(raw: Column) -> Column:
    """True for "true" in any case and for numbers that aren't zero, else false; never null."""
    text = F.lower(F.trim(missing_to_null(raw)))
    return F.coalesce((text == "true") | F.coalesce(parse_float(raw) != 0, F.lit(False)), F.lit(False))


def has_visible(raw: Column) -> Column:
    """Whether a text has a character that is no white space; null has none."""
    return F.coalesce(raw.rlike(r"\S"), F.lit(False))
