"""Full-text ranking and its fusion with vector ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import analyze

#: The usual term saturation and length weight of BM25, and the constant of rank fusion.
K1, B, FUSE = 1.2, 0.75, 60


def postings(df: DataFrame, id_col: str, text_col: str, stemmed: bool = True) -> DataFrame:
    """(id, term, tf, length); texts without a term have no row."""
    held = df.select(F.col(id_col).alias("id"), analyze(F.col(text_col), stemmed).alias("terms"))
    each = held.select("id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return each.groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def match(df: DataFrame, id_col: str, text_col: str, query: str, stemmed: bool = True) -> DataFrame:
    """(id) of each row that has a term of the query; one scan, nothing is shuffled. Repeated ids are repeated."""
    return df.filter(F.arrays_overlap(analyze(F.col(text_col), stemmed), analyze(F.lit(query), stemmed))).select(F.col(id_col).alias("id"))


def bm25_topk(df: DataFrame, id_col: str, text_col: str, query: str, k: int, stemmed: bool = True) -> DataFrame:
    """(id, score, place) of the best ``k`` rows; ties go to the smaller id.

    A row keeps its length and the terms that the query has, so few of them are
    shuffled; document frequencies of a handful of terms are broadcast. Two scans:
    one for the mean length, one for the hits.
    """
    wanted = F.array_distinct(analyze(F.lit(query), stemmed))
    texts = df.select(F.col(id_col).alias("id"), analyze(F.col(text_col), stemmed).alias("terms"))
    size = texts.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("terms")).alias("mean"))
    own = texts.filter(F.arrays_overlap("terms", wanted))
    each = F.transform(wanted, lambda w: F.struct(w.alias("term"), F.size(F.filter("terms", lambda t: t == w)).cast("long").alias("tf")))
    hits = own.select("id", F.size("terms").alias("length"), F.inline(F.filter(each, lambda x: x["tf"] > 0)))
    df_ = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = hits.join(F.broadcast(df_.crossJoin(size)), "term").groupBy("id").agg(F.round(F.sum(part), 9).alias("score"))  # a row a term of the query
    top = scored.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fuse(left: DataFrame, right: DataFrame, k: int, constant: int = FUSE) -> DataFrame:
    """(id, score, place) by reciprocal ranks of two rankings (id, place)."""
    both = left.select("id", F.col("place").alias("a")).join(right.select("id", F.col("place").alias("b")), "id", "full")
    score = sum(F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0)) for c in ("a", "b"))
    top = both.select("id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
