"""Small scalar helpers over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_slash(url: Column) -> Column:
    """Without trailing slashes."""
    return F.regexp_replace(url, "/+$", "")


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with an explicit UTC offset; a zero fraction is left out."""
    fraction = F.when(F.date_format(ts, "SSSSSS") == "000000", "").otherwise(F.concat(F.lit("."), F.date_format(ts, "SSSSSS")))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def version_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmm")


def json_path(raw: Column, path: str, default=None) -> Column:
    """The value at a dotted path of a JSON text, else ``default``."""
    return F.coalesce(F.get_json_object(raw, "$." + path), F.lit(default).cast("string"))


def rate(rows: Column, seconds: Column) -> Column:
    """Rows a second, 0 where no time has passed."""
    return F.coalesce(F.try_divide(rows.cast("double"), seconds), F.lit(0.0))
