"""Raw product rows to documents: projection, row filters, counters and the limit on emitted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.clean import has_visible, missing_to_null, parse_code, parse_flag, parse_float, parse_int


def has_key(df: DataFrame) -> Column:
    return missing_to_null(F.col("asin")).isNotNull()


def to_documents(raw: DataFrame, require_title: bool = False, at: Column | None = None) -> DataFrame:
    """One row for each raw row with a key, and with ``require_title`` a title that shows; ``seq`` is carried along if there."""
    keep = has_key(raw)
    title = missing_to_null(F.col("title"))
    if require_title:
        keep = keep & has_visible(title)
    carried = [F.col("seq")] if "seq" in raw.columns else []
    return raw.filter(keep).select(
        F.col("asin"), title.alias("title"), missing_to_null(F.col("imgUrl")).alias("imgUrl"), missing_to_null(F.col("productURL")).alias("productURL"),
        parse_float(F.col("stars")).alias("stars"), parse_int(F.col("reviews")).alias("reviews"), parse_float(F.col("price")).alias("price"),
        parse_float(F.col("listPrice")).alias("listPrice"), parse_code(F.col("category_id")).alias("category_id"), parse_flag(F.col("isBestSeller")).alias("isBestSeller"),
        (F.current_timestamp() if at is None else at).alias("ingested_at"), *carried,
    )


def emitted_and_skipped(raw: DataFrame, require_title: bool = False) -> DataFrame:
    """One row: how many raw rows become documents and how many don't."""
    keep = has_key(raw)
    if require_title:
        keep = keep & has_visible(missing_to_null(F.col("title")))
    return raw.agg(F.count_if(keep).alias("emitted"), F.count_if(~keep).alias("skipped"))


def limit_emitted(documents: DataFrame, limit: int | None, order: str = "seq") -> DataFrame:
    """The first ``limit`` documents by ``order``; none for 0 or less, all for None."""
    if limit is None:
        return documents
    return documents.orderBy(order).limit(max(0, limit))


def tagged(documents: DataFrame, target: str) -> DataFrame:
    """With the name of the target and the key that writes are by."""
    return documents.withColumns({"_index": F.lit(target), "_id": F.col("asin")})


def catalogue_stats(documents: DataFrame) -> DataFrame:
    return documents.agg(F.avg("price").alias("avg_price"), F.avg("stars").alias("avg_stars"), F.count_if("isBestSeller").alias("best_sellers"), F.count(F.lit(1)).alias("documents"))
