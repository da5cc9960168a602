"""Queries over the test tables, one or more for each operator, and the same in DuckDB SQL.

``part`` stands in for products, ``embeddings`` for vectors, ``documents`` and
``benchmark`` for texts, ``events`` and ``orders`` for keyed writes.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.config import Settings
from shelfmark.functions import clean, scalar, text, vector
from shelfmark.operators import embed, gates, knn, probes, products, sampling, search, upsert
from shelfmark.plans import publish
from shelfmark.plans.ingest import ingest_catalogue
from shelfmark.sources.contract import Contract
from shelfmark.sources.tables import lookup, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as raw product rows of text; every seventh title and eleventh key is missing."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return part.select(
        F.when(key % 11 != 0, F.concat(F.lit("A"), key.cast("string"))).otherwise("").alias("asin"), F.when(key % 7 == 0, "  ").otherwise(F.col("p_name")).alias("title"),
        F.concat(F.lit("http://i/"), key.cast("string")).alias("imgUrl"), F.concat(F.lit("http://p/"), key.cast("string")).alias("productURL"),
        F.concat((key % 5).cast("string"), F.lit(".5")).alias("stars"), F.when(key % 3 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("reviews"),
        F.round("p_retailprice", 2).cast("decimal(20,2)").cast("string").alias("price"), F.lit("1,234").alias("listPrice"),
        F.concat(F.regexp_extract("p_brand", "([0-9]+)", 1), F.lit(".0")).alias("category_id"), F.when(key % 13 == 0, "True").otherwise("False").alias("isBestSeller"), key.alias("seq"),
    )


_RAW = """raw AS (
  SELECT CASE WHEN p_partkey % 11 <> 0 THEN 'A' || p_partkey ELSE '' END AS asin, CASE WHEN p_partkey % 7 = 0 THEN '  ' ELSE p_name END AS title,
    'http://i/' || p_partkey AS "imgUrl", 'http://p/' || p_partkey AS "productURL", CAST(p_partkey % 5 AS VARCHAR) || '.5' AS stars,
    CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS reviews, round(p_retailprice, 2) AS price, regexp_extract(p_brand, '([0-9]+)', 1) AS category_id,
    p_partkey % 13 = 0 AS best, p_partkey AS seq
  FROM part
)"""
_DOCUMENT = """asin, title, "imgUrl", "productURL", CAST(stars AS DOUBLE) AS stars, CAST(reviews AS INTEGER) AS reviews, price,
  CAST(NULL AS DOUBLE) AS "listPrice", CAST(CAST(category_id AS BIGINT) AS VARCHAR) AS category_id, best AS "isBestSeller" """


@query(f"WITH {_RAW} SELECT {_DOCUMENT} FROM raw WHERE asin <> ''")
def clean_project(spark, sf_dir):
    """Raw rows to documents; rows without a key are skipped."""
    return products.to_documents(raw_products(spark, sf_dir)).drop("seq", "ingested_at")


@query(f"WITH {_RAW} SELECT {_DOCUMENT} FROM raw WHERE asin <> '' AND trim(title) <> ''")
def clean_require_title(spark, sf_dir):
    return products.to_documents(raw_products(spark, sf_dir), require_title=True).drop("seq", "ingested_at")


_NUMBERS = ("4.5", "4.9", "-3.9", "1e3", "1,234", "abc", "", "NULL", "  7 ", "+2", ".5", "12.", "99999999999", "5d", "5f", "1_000", "inf", "nan", "0x10", "--1")


@query("""
WITH v(raw) AS (VALUES ('4.5'),('4.9'),('-3.9'),('1e3'),('1,234'),('abc'),(''),('NULL'),('  7 '),('+2'),('.5'),('12.'),('99999999999'),('5d'),('5f'),('1_000'),('inf'),('nan'),('0x10'),('--1')),
n AS (
  SELECT raw, CASE WHEN regexp_full_match(trim(raw), '[+-]?([0-9]+(_[0-9]+)*\\.?([0-9]+)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(replace(replace(trim(raw), '_', ''), '+', '') AS DOUBLE) END AS f FROM v
)
SELECT raw, f AS as_float, TRY_CAST(trunc(f) AS INTEGER) AS as_int, CAST(CAST(trunc(f) AS BIGINT) AS VARCHAR) AS as_code FROM n
""".replace("\\\\", "\\"))
def parse_numbers(spark, sf_dir):
    rows = spark.createDataFrame([(v,) for v in _NUMBERS], "raw string")
    raw = F.col("raw")
    return rows.select("raw", clean.parse_float(raw).alias("as_float"), clean.parse_int(raw).alias("as_int"), clean.parse_code(raw).alias("as_code"))


@query("""
WITH v(raw) AS (VALUES ('True'),('False'),('true'),(' TRUE '),(''),('NULL'),('1'),('0'),('0.0'),('2.5'),('yes'),(NULL))
SELECT raw, coalesce(lower(trim(raw)) = 'true' OR coalesce(TRY_CAST(trim(raw) AS DOUBLE) <> 0, false), false) AS flag FROM v
""")
def parse_flags(spark, sf_dir):
    rows = spark.createDataFrame([(v,) for v in ("True", "False", "true", " TRUE ", "", "NULL", "1", "0", "0.0", "2.5", "yes", None)], "raw string")
    return rows.select("raw", clean.parse_flag(F.col("raw")).alias("flag"))


@query(f"WITH {_RAW} SELECT count(*) FILTER (asin <> '' AND trim(title) <> '') AS emitted, count(*) FILTER (NOT (asin <> '' AND trim(title) <> '')) AS skipped FROM raw")
def emitted_skipped(spark, sf_dir):
    return products.emitted_and_skipped(raw_products(spark, sf_dir), require_title=True)


@query(f"WITH {_RAW} SELECT asin, seq FROM raw WHERE asin <> '' AND trim(title) <> '' ORDER BY seq LIMIT 25")
def limit_emitted(spark, sf_dir):
    """The limit counts documents, not raw rows."""
    return products.limit_emitted(products.to_documents(raw_products(spark, sf_dir), require_title=True), 25).select("asin", "seq")


@query(f"WITH {_RAW} SELECT asin, 'products_v1' AS _index, asin AS _id FROM raw WHERE asin <> ''")
def target_tagging(spark, sf_dir):
    return products.tagged(products.to_documents(raw_products(spark, sf_dir)), "products_v1").select("asin", "_index", "_id")


@query("""
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value
FROM events GROUP BY user_id
""")
def upsert_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return upsert.last_wins(rows, "user_id", "ts", "event_id").drop("ts")


@query("""
WITH new AS (SELECT o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 100000000 END AS o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 10 < 4)
SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)
UNION ALL SELECT o_orderkey, round(o_totalprice, 2) FROM new
""")
def upsert_merge(spark, sf_dir):
    """A full-document merge: changed and new keys replace, the rest stays."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    key = F.col("o_orderkey")
    new = old.filter(key % 10 < 4).select((key + F.when(key % 2 == 0, 0).otherwise(100000000)).alias("o_orderkey"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return upsert.merge(old, new, "o_orderkey").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("""
SELECT CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey END AS id,
  CASE WHEN p_partkey % 11 = 0 THEN 'asin is null' END AS first_problem, CASE WHEN p_partkey % 5 = 0 THEN 'price is no double' END AS second_problem
FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 5 = 0
""")
def strict_rejects(spark, sf_dir):
    """Rows that break a contract are set apart with what is wrong, and fail nothing."""
    contract = Contract.from_mapping({"mappings": {"properties": {"asin": {"type": "long"}, "price": {"type": "float"}}}}, "asin", ("asin",))
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.when(key % 11 != 0, key).alias("asin"), F.when(key % 5 == 0, "junk").otherwise("1.5").alias("price"))
    bad = contract.split(rows)[1]
    return bad.select(F.col("asin").alias("id"), F.try_element_at(F.filter("problems", lambda p: p.startswith("asin")), F.lit(1)).alias("first_problem"), F.try_element_at(F.filter("problems", lambda p: p.startswith("price")), F.lit(1)).alias("second_problem"))


@query("""
SELECT count(*) AS total, count(toxic) AS with_vector, count(*) - count(toxic) AS missing
FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
""")
def exists_coverage(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return gates.coverage(table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left"), "toxic")


@query("SELECT * EXCLUDE (embedding), len(embedding) AS dims FROM embeddings WHERE vec_id = 42")
def point_lookup(spark, sf_dir):
    return lookup(table(spark, sf_dir, "embeddings"), "vec_id", 42).select("vec_id", "label", F.size("embedding").alias("dims"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"))


@query("""
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine,
  round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dot, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS l2
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def vector_pairs(spark, sf_dir):
    """Cosine, dot product and distance of each vector and the next."""
    rows = table(spark, sf_dir, "embeddings")
    a, b = rows.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), rows.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "a").select("a", "b", F.round(vector.cosine(x, y), 6).alias("cosine"), F.round(vector.dot(x, y), 6).alias("dot"), F.round(vector.l2_distance(x, y), 6).alias("l2"))


_TOPK = """
WITH s AS (
  SELECT p.vec_id AS qid, v.vec_id AS id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) + 1 AS score
  FROM embeddings v, embeddings p WHERE p.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, id) AS place FROM s)
SELECT qid, id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM r WHERE place <= {k}
"""


@query(_TOPK.format(k=10))
def exact_topk(spark, sf_dir):
    """The ten nearest vectors of each whose id is divisible by 50, scores from 0 to 2."""
    rows = table(spark, sf_dir, "embeddings")
    return knn.exact_topk(rows, knn.probes_by_id(rows), 10).withColumn("score", F.round("score", 6))


_CODES = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(round(x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))) * 127) AS TINYINT))"


@query(f"SELECT vec_id, {_CODES} AS code FROM embeddings".replace(" AS code", "::VARCHAR AS code"))
def int8_codes(spark, sf_dir):
    code = vector.quantise(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(code.cast("array<string>"), ", "), F.lit("]")).alias("code"))


@query(f"""
WITH c AS (SELECT vec_id, list_transform({_CODES}, lambda x: CAST(x AS DOUBLE)) AS code FROM embeddings),
s AS (SELECT p.vec_id AS qid, v.vec_id AS id, list_inner_product(v.code, p.code) AS score FROM c v, c p WHERE p.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM s)
SELECT qid, id, score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10
""")
def int8_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return knn.exact_topk(rows, knn.probes_by_id(rows), 10, quantised=True)


@query(f"""
WITH c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_transform({_CODES}, lambda x: CAST(x AS DOUBLE)) AS code FROM embeddings),
s AS (SELECT p.vec_id AS qid, v.vec_id AS id, list_inner_product(v.code, p.code) AS near, list_cosine_similarity(v.v, p.v) + 1 AS score FROM c v, c p WHERE p.vec_id % 50 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY near DESC, id) AS candidate FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, id) AS place FROM n WHERE candidate <= 40)
SELECT qid, id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10
""")
def rescored_topk(spark, sf_dir):
    """int8 candidates, four times as many as wanted, scored again in full precision."""
    rows = table(spark, sf_dir, "embeddings")
    return knn.rescored_topk(rows, knn.probes_by_id(rows), 10, 4).select("qid", "id", F.round("score", 6).alias("score"), "place")


@query("SELECT count(*) AS probes, count(*) AS found_itself FROM embeddings WHERE vec_id % 50 = 0")
def self_retrieval(spark, sf_dir):
    """A stored vector's nearest vector is itself."""
    rows = table(spark, sf_dir, "embeddings")
    first = knn.exact_topk(rows, knn.probes_by_id(rows), 1)
    return first.agg(F.count(F.lit(1)).alias("probes"), F.count_if((F.col("qid") == F.col("id")) & (F.abs(F.col("score") - 2) < 1e-6)).alias("found_itself"))


@query()
def ivf_recall(spark, sf_dir):
    """Recall of the inverted-file index against exact search, for each probe."""
    rows = table(spark, sf_dir, "embeddings")
    own = knn.probes_by_id(rows)
    index = knn.InvertedFile.build(rows, cells=8)
    return gates.recall_by_probe(knn.exact_topk(rows, own, 10), index.search(own, 10, cells=6))


@query("SELECT count(*) AS total, count(embedding) AS with_vector, 5 AS probes, 10 AS k, 1.0::DOUBLE AS mean_recall, 1.0::DOUBLE AS self_hit, true AS ok FROM embeddings")
def recall_gate(spark, sf_dir):
    """The gate with exact search behind it: recall is whole."""
    rows = table(spark, sf_dir, "embeddings")
    return gates.check_recall(rows, lambda p, k: knn.exact_topk(rows, p, k)).select("total", "with_vector", "probes", "k", F.round("mean_recall", 6).alias("mean_recall"), F.round("self_hit", 6).alias("self_hit"), "ok")


@query()
def recall_gate_int8(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return gates.check_recall(rows, lambda p, k: knn.rescored_topk(rows, p, k))


_PAIRS = """
u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS g, b.label AS h, list_cosine_similarity(a.v, b.v) AS cos FROM u a JOIN u b ON a.vec_id <> b.vec_id),
n AS (SELECT i, any_value(g) AS g, arg_max(h, (round(cos, 12), -j)) AS ng, arg_max(j, (round(cos, 12), -j)) AS nj FROM c GROUP BY i)
"""


@query(f"""
WITH {_PAIRS}, m AS (SELECT avg(cos) FILTER (g = h) AS intra, avg(cos) FILTER (g <> h) AS inter, count(*) FILTER (cos > 0.9999) // 2 AS duplicates FROM c),
r AS (SELECT avg(CAST(g = ng AS INTEGER)) AS rate FROM n)
SELECT round(rate, 6) AS neighbour_rate, round(intra, 6) AS intra, round(inter, 6) AS inter, duplicates, rate >= 0.8 AND intra - inter >= 0.05 AND duplicates = 0 AS ok FROM m, r
""")
def semantic_gate(spark, sf_dir):
    """The semantic gate on vectors whose label they don't carry: it has to fail, as a row."""
    rows = table(spark, sf_dir, "embeddings")
    report = gates.judged(gates.semantic_measures(rows, "vec_id", "label"), {"backend": "stored", "dims": 64, "texts": 0, "groups": 10})
    return report.select(*[F.round(c, 6).alias(c) for c in ("neighbour_rate", "intra", "inter")], "duplicates", "ok")


@query(f"WITH {_PAIRS} SELECT i AS vec_id, nj AS neighbour, g = ng AS same_group FROM n")
def nearest_group(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    near = knn.exact_topk(rows, rows.select(F.col("id").alias("qid"), F.col("embedding").alias("qv")), 2, "id").filter("qid <> id")
    first = near.groupBy("qid").agg(F.min_by("id", F.struct("place", "id")).alias("id"))
    labels = rows.select("id", "label")
    both = first.join(labels.select(F.col("id").alias("qid"), F.col("label").alias("own")), "qid").join(labels, "id")
    return both.select(F.col("qid").alias("vec_id"), F.col("id").alias("neighbour"), (F.col("own") == F.col("label")).alias("same_group"))


@query()
def probe_gate(spark, sf_dir):
    """The semantic gate on the built-in probe set and the lexical backend: it has to pass."""
    return gates.check_backend(spark, embed.LexicalBackend(), expect_dims=768)


_TOKENS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
_LOWER = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


@query(f"SELECT item_id, w AS word, count(*) AS n FROM (SELECT item_id, unnest({_LOWER}) AS w FROM benchmark) GROUP BY ALL")
def bow_tokens(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.tokens(F.col("text"))).alias("word"))
    return words.groupBy("item_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH t AS (SELECT item_id, w, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest({_LOWER}) AS w FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, sqrt(sum(n * n)) AS size FROM t GROUP BY item_id)
SELECT a.item_id AS a, b.item_id AS b, round(sum(a.n * b.n) / any_value(x.size * y.size), 6) AS cosine
FROM t a JOIN t b ON a.w = b.w AND a.item_id < b.item_id JOIN s x ON x.item_id = a.item_id JOIN s y ON y.item_id = b.item_id GROUP BY a.item_id, b.item_id
""")
def bow_cosine(spark, sf_dir):
    """Cosine of word counts of benchmark items that share a word."""
    words = bow_tokens(spark, sf_dir)
    size = words.groupBy("item_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    a, b = (words.select(F.col("item_id").alias(c), "word", F.col("n").alias(f"n{c}")) for c in "ab")
    dots = a.join(b, "word").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("dot"))
    sized = dots.join(size.select(F.col("item_id").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("item_id").alias("b"), F.col("size").alias("sb")), "b")
    return sized.select("a", "b", F.round(F.col("dot") / (F.col("sa") * F.col("sb")), 6).alias("cosine"))


#: CRC-32 of a word w of ASCII, bit by bit, and the bucket counts of the lexical vectors of texts.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(w, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""


def _hashed_sql(table_: str, key: str) -> str:
    words = f"SELECT {key}, unnest({_LOWER}) AS w FROM {table_}"
    crc = f"words AS ({words}), crc AS (SELECT w, {_CRC} % 768 AS bucket FROM (SELECT DISTINCT w FROM words))"
    return f"{crc}, counts AS (SELECT {key}, bucket, count(*)::DOUBLE AS n FROM words JOIN crc USING (w) GROUP BY ALL)"


@query(f"""
WITH {_hashed_sql('documents', 'doc_id')}, sizes AS (SELECT doc_id, sqrt(sum(n * n)) AS size FROM counts GROUP BY doc_id),
weights AS (SELECT doc_id, bucket, CAST(CAST(n / size AS FLOAT) AS DOUBLE) AS x FROM counts JOIN sizes USING (doc_id)),
sums AS (SELECT doc_id, count(*) AS buckets, sum((bucket + 1) * x) AS moment, max(x) AS largest FROM weights GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(buckets, 0) AS INTEGER) AS buckets, round(coalesce(moment, 0), 1) AS moment, round(coalesce(largest, 0), 4) AS largest FROM documents LEFT JOIN sums USING (doc_id)
""")
def bow_hashed(spark, sf_dir):
    """The lexical backend in expressions: used buckets, sum of places times weights and largest weight of each document's vector."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _moments(embed.lexical_vectors(rows, "doc_id", "text"), "doc_id")


def _moments(held: DataFrame, key: str) -> DataFrame:
    each = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    return held.select(
        key, F.size(F.filter("embedding", lambda x: x != 0)).alias("buckets"),
        F.round(F.aggregate(each, F.lit(0.0), lambda s, x: s + x), 1).alias("moment"), F.round(F.array_max("embedding").cast("double"), 4).alias("largest"),
    )


_GROUPED = f"SELECT item_id % 4 AS grp, item_id AS idx, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM benchmark"


@query(f"""
WITH w AS ({_GROUPED}), s AS (SELECT item_id % 4 AS grp, count(DISTINCT item_id) AS n FROM benchmark GROUP BY 1)
SELECT CAST(grp AS VARCHAR) AS grp, word FROM (SELECT grp, word, count(DISTINCT idx) AS c FROM w GROUP BY ALL) JOIN s USING (grp) WHERE c >= n
""")
def head_nouns(spark, sf_dir):
    """Words that all items of a group have."""
    rows = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 4).cast("string").alias("grp"), F.col("item_id").alias("idx"), F.col("text").alias("title"))
    return probes.head_nouns(rows, generic=frozenset())


@query(f"WITH w AS ({_GROUPED}) SELECT word, count(DISTINCT grp) AS groups FROM w GROUP BY word HAVING count(DISTINCT grp) > 1")
def shared_words(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 4).cast("string").alias("grp"), F.col("item_id").alias("idx"), F.col("text").alias("title"))
    return probes.shared_words(rows, generic=frozenset())


@query("SELECT vec_id, label FROM embeddings ORDER BY md5('0' || vec_id), vec_id LIMIT 20")
def uniform_sample(spark, sf_dir):
    return sampling.uniform_sample(table(spark, sf_dir, "embeddings"), 20, "vec_id").select("vec_id", "label")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 14 = 0")
def systematic_sample(spark, sf_dir):
    return sampling.systematic_sample(table(spark, sf_dir, "part"), 14, "p_partkey").select("p_partkey", "p_name")


@query("""
WITH n AS (SELECT count(*) AS n FROM part)
SELECT count(DISTINCT CASE WHEN p_partkey < ceil(n / 14) THEN p_brand END) AS head_groups, count(DISTINCT CASE WHEN p_partkey % 14 = 0 THEN p_brand END) AS systematic_groups,
  count(DISTINCT p_brand) AS all_groups FROM part, n
""")
def head_bias(spark, sf_dir):
    return sampling.head_bias(table(spark, sf_dir, "part"), 14, "p_brand", "p_partkey")


@query(f"""
WITH {_RAW} SELECT round(avg(price), 6) AS avg_price, round(avg(CAST(stars AS DOUBLE)), 6) AS avg_stars, count(*) FILTER (best) AS best_sellers, count(*) AS documents FROM raw WHERE asin <> ''
""")
def catalogue_stats(spark, sf_dir):
    held = products.catalogue_stats(products.to_documents(raw_products(spark, sf_dir)))
    return held.select(F.round("avg_price", 6).alias("avg_price"), F.round("avg_stars", 6).alias("avg_stars"), "best_sellers", "documents")


_NAMES = ("shop_v1_20260101-0900", "shop_v3_20260722-1730", "shop_v9_other", "shop_v12", "shop", "shopping_v40")


@query("""
WITH v(name) AS (VALUES ('shop_v1_20260101-0900'),('shop_v3_20260722-1730'),('shop_v9_other'),('shop_v12'),('shop'),('shopping_v40')), b(base) AS (VALUES ('shop'), ('shopping'), ('other'))
SELECT base, base || '_v' || (coalesce(max(TRY_CAST(regexp_extract(name, '^' || base || '_v([0-9]+)(_[0-9]{8}-[0-9]{4})?$', 1) AS INTEGER)), 0) + 1) || '_20270102-0304' AS next FROM b, v GROUP BY base
""")
def version_names(spark, sf_dir):
    """The name after the highest version of a base; odd suffixes don't count."""
    now = datetime(2027, 1, 2, 3, 4)
    return spark.createDataFrame([(base, publish.next_version(list(_NAMES), base, now)) for base in ("shop", "shopping", "other")], "base string, next string")


def _catalogue(spark: SparkSession) -> publish.Catalogue:
    """An empty catalogue in the folder that the session shares, removed when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        local = tempfile.mkdtemp(prefix="shelfmark-catalogue-")  # one machine: without the setting there is no folder that executors share
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        shared = f"file://{local}"
    return publish.Catalogue(spark, f"{shared}/catalogue-{uuid.uuid4().hex[:12]}")


def _order_contract() -> Contract:
    kinds = {"o_orderkey": "long", "o_totalprice": "float", "o_orderstatus": "keyword"}
    return Contract.from_mapping({"mappings": {"properties": {c: {"type": t} for c, t in kinds.items()}}}, "o_orderkey", ("o_orderkey", "o_orderstatus"))


def _order_loads(spark: SparkSession, sf_dir: str) -> tuple[publish.Catalogue, list[publish.Loaded]]:
    """Orders loaded twice: all but every third one, then half of all with other prices, of which every seventh has no status."""
    catalogue, contract, name = _catalogue(spark), _order_contract(), "orders_v1"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.col("o_orderkey").alias("seq"))
    key = F.col("o_orderkey")
    catalogue.create(name, contract)
    first = catalogue.load(name, rows.filter(key % 3 != 0), contract)
    again = rows.filter(key % 2 == 0).withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("o_orderstatus", F.when(key % 7 != 0, F.col("o_orderstatus")))
    return catalogue, [first, catalogue.load(name, again, contract)]


_LOADED = """
one AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0),
two AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0),
held AS (SELECT * FROM one WHERE o_orderkey NOT IN (SELECT o_orderkey FROM two) UNION ALL SELECT * FROM two)
"""


@query(f"WITH {_LOADED} SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice, o_orderstatus FROM held")
def bulk_load(spark, sf_dir):
    """Two bulk loads into a version, published and read back by its alias."""
    catalogue, _ = _order_loads(spark, sf_dir)
    catalogue.publish("orders", "orders_v1")
    return catalogue.read("orders").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderstatus")


@query("""
SELECT 1 AS load, count(*) AS indexed, 0::BIGINT AS rejected, 0 AS examples, true AS timed FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT 2, count(*) FILTER (o_orderkey % 7 <> 0), count(*) FILTER (o_orderkey % 7 = 0), least(5, count(*) FILTER (o_orderkey % 7 = 0))::INTEGER, true FROM orders WHERE o_orderkey % 2 = 0
""")
def load_reports(spark, sf_dir):
    """What each load says: documents, rejected rows, examples of them, and that it has a rate."""
    _, loads = _order_loads(spark, sf_dir)
    rows = [(i, x.indexed, x.rejected, len(x.examples), x.seconds > 0 and (x.rate > 0) == (x.indexed > 0)) for i, x in enumerate(loads, 1)]
    return spark.createDataFrame(rows, "load int, indexed long, rejected long, examples int, timed boolean")


@query(f"WITH {_LOADED} SELECT 1 AS files, count(*) AS documents, count(DISTINCT o_orderkey) AS keys FROM held")
def compacted(spark, sf_dir):
    """A version rewritten in one file has the documents that it had."""
    catalogue, _ = _order_loads(spark, sf_dir)
    _, files = catalogue.compact("orders_v1", 1)
    keys = catalogue.read("orders_v1").agg(F.countDistinct("o_orderkey").alias("keys"))
    return keys.select(F.lit(files).alias("files"), F.lit(catalogue.count("orders_v1")).alias("documents"), "keys")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 2 = 1")
def rolled_back(spark, sf_dir):
    """Two versions with a hidden vector; the alias goes forth and back, and what is displayed leaves the vector out."""
    properties = {"vec_id": {"type": "long"}, "label": {"type": "long"}, "embedding": {"type": "dense_vector"}}
    contract = Contract.from_mapping({"mappings": {"_source": {"excludes": ["embedding"]}, "properties": properties}}, "vec_id", ("vec_id",))
    catalogue, rows = _catalogue(spark), table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    for name, rest in (("vectors_v1", 1), ("vectors_v2", 0)):
        catalogue.load(name, rows.filter(F.col("vec_id") % 2 == rest), contract, "none")
        catalogue.publish("vectors", name)
    if catalogue.write_target("vectors", "vectors") != "vectors_v2" or catalogue.rollback("vectors", "vectors_v1") != ["vectors_v2"]:
        raise ValueError("the alias is not where it was published to")
    return catalogue.display("vectors", contract)


@query(f'WITH {_RAW} SELECT {_DOCUMENT} FROM raw WHERE asin <> \'\'')
def ingested_csv(spark, sf_dir):
    """Raw rows written as CSV files and ingested by the catalogue plan: one document a key, read back from its index."""
    catalogue = _catalogue(spark)
    csv = f"{catalogue.root}/_csv"
    raw_products(spark, sf_dir).drop("seq").coalesce(1).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(csv)
    settings = replace(Settings(), warehouse=catalogue.root)
    ingest_catalogue(spark, csv, settings)
    return catalogue.read(settings.index).drop("ingested_at")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.none.at'), '-') AS missing FROM events")
def json_paths(spark, sf_dir):
    props = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", scalar.json_path(props, "k").alias("k"), scalar.json_path(props, "none.at", "-").alias("missing"))


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00' AS iso FROM events")
def time_formats(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", scalar.version_stamp(ts).alias("stamp"), scalar.iso_utc(ts).alias("iso"))


@query("SELECT page_id, regexp_replace(url || '//', '/+$', '') AS url, lower(trim('  ' || url || ' ')) AS lowered, substring(html, 1, 20) AS head FROM pages")
def string_functions(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", scalar.strip_slash(F.concat(url, F.lit("//"))).alias("url"), F.lower(F.trim(F.concat(F.lit("  "), url, F.lit(" ")))).alias("lowered"), F.substring("html", 1, 20).alias("head"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_BM25 = f"""
d AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: t NOT IN ({_STOP})) AS terms FROM documents),
z AS (SELECT count(*) AS docs, avg(len(terms)) AS mean FROM d),
h AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(terms) AS len, unnest(terms) AS term FROM d) WHERE term IN ('anting', 'ouen', 'thion', 'have', 'ing') GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
b AS (
  SELECT id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score FROM h JOIN f USING (term), z GROUP BY id
)
"""


@query(f"WITH {_BM25} SELECT id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS place FROM b ORDER BY score DESC, id LIMIT 10")
def bm25_topk(spark, sf_dir):
    """The ten best documents of a query by BM25, without stemming."""
    return search.bm25_topk(table(spark, sf_dir, "documents"), "doc_id", "text", "anting the ouen thion have ing", 10, stemmed=False).withColumn("score", F.round("score", 6))


@query()
def bm25_stemmed(spark, sf_dir):
    return search.bm25_topk(table(spark, sf_dir, "documents"), "doc_id", "text", "antings ouened", 10).withColumn("score", F.round("score", 6))


@query(f"SELECT DISTINCT doc_id AS id FROM (SELECT doc_id, unnest({_LOWER}) AS w FROM documents) WHERE w IN ('ouen', 'anting')")
def text_match(spark, sf_dir):
    return search.match(table(spark, sf_dir, "documents"), "doc_id", "text", "ouen anting", stemmed=False)


@query(f"""
WITH {_BM25}, t AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS a FROM b ORDER BY score DESC, id LIMIT 20),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
e AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 12) DESC, vec_id) AS b FROM embeddings, q QUALIFY b <= 20),
m AS (SELECT coalesce(t.id, e.id) AS id, round(coalesce(1.0::DOUBLE / (60 + a), 0) + coalesce(1.0::DOUBLE / (60 + e.b), 0), 9) AS score FROM t FULL JOIN e ON t.id = e.id)
SELECT id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS place FROM m ORDER BY score DESC, id LIMIT 10
""")
def hybrid_rrf(spark, sf_dir):
    """Text and vector rankings fused by reciprocal ranks."""
    rows = table(spark, sf_dir, "embeddings")
    by_text = search.bm25_topk(table(spark, sf_dir, "documents"), "doc_id", "text", "anting the ouen thion have ing", 20, stemmed=False)
    probe = rows.filter("vec_id = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return search.fuse(by_text, knn.exact_topk(rows, probe, 20), 10).withColumn("score", F.round("score", 6))


@query(ORACLE_SQL["bow_hashed"])
def batch_embed(spark, sf_dir):
    """Documents through the batched backend call, a vector for each."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _moments(embed.embed(rows, embed.LexicalBackend, batch_size=64, workers=2, text_col="text"), "doc_id")


@query("SELECT item_id AS qid, true AS found_itself FROM benchmark")
def text_authenticity(spark, sf_dir):
    """All stored texts, embedded again, find themselves among the lexical vectors of all items."""
    items = table(spark, sf_dir, "benchmark")
    vectors = embed.lexical_vectors(items, "item_id", "text")
    texts = {r["item_id"]: r["text"] for r in items.collect()}
    return knn.authentic(vectors, texts, embed.LexicalBackend(), id_col="item_id")


@query(f"""
WITH {_hashed_sql('benchmark', 'item_id')}, sizes AS (SELECT item_id, sqrt(sum(n * n)) AS size FROM counts GROUP BY item_id),
probe AS (SELECT bucket, count(*)::DOUBLE AS n FROM (SELECT w, {_CRC} % 768 AS bucket FROM (SELECT unnest(['the', 'thing', 'of', 'that']) AS w)) GROUP BY bucket),
dots AS (SELECT item_id, sum(c.n * p.n) AS dot FROM counts c JOIN probe p USING (bucket) GROUP BY item_id),
scored AS (SELECT item_id AS id, 1 + coalesce(dot, 0) / size / (SELECT sqrt(sum(n * n)) FROM probe) AS score FROM sizes LEFT JOIN dots USING (item_id))
SELECT round(score, 4) AS score, count(*) AS n FROM (SELECT score FROM scored ORDER BY score DESC, id LIMIT 10) GROUP BY 1
""")
def text_knn(spark, sf_dir):
    """A query text against the lexical vectors of all items: the scores of the ten nearest, and how many have each."""
    items = table(spark, sf_dir, "benchmark")
    probe = knn.text_probes(spark, {0: "the thing of that"}, embed.LexicalBackend())
    near = knn.exact_topk(embed.lexical_vectors(items, "item_id", "text"), probe, 10, "item_id")
    return near.groupBy(F.round("score", 4).alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS documents, count(DISTINCT o_orderkey) AS keys, count(*) = count(DISTINCT o_orderkey) AS distinct_keys, max(o_orderkey) AS highest FROM orders")
def key_counts(spark, sf_dir):
    catalogue = _catalogue(spark)
    catalogue.load("orders_v1", table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), _order_contract(), "none")
    rows = catalogue.read("orders_v1")
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("o_orderkey").alias("keys"), (F.count(F.lit(1)) == F.countDistinct("o_orderkey")).alias("distinct_keys"), F.max("o_orderkey").alias("highest"))
