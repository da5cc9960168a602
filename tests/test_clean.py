import pytest
from pyspark.sql import functions as F

from shelfmark.functions import clean, scalar, text, vector


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("raw"))).collect()]


def test_floats(spark):
    raw = ["4.5", "1e3", "1_000", "1,234", "5d", "5f", "abc", "", "NaN", "inf", " 7 ", ".5", "-2.", "1__0", None]
    assert column(spark, raw, clean.parse_float) == [4.5, 1000.0, 1000.0, None, None, None, None, None, None, None, 7.0, 0.5, -2.0, None, None]


def test_ints_truncate_toward_zero(spark):
    assert column(spark, ["4.9", "-3.9", "1e3", "inf", "", "99999999999", "0"], clean.parse_int) == [4, -3, 1000, None, None, None, 0]


def test_codes_and_flags(spark):
    assert column(spark, ["12.0", "", "x", "7"], clean.parse_code) == ["12", None, None, "7"]
    assert column(spark, ["True", "False", "", "1", "0", None, "yes"], clean.parse_flag) == [True, False, False, True, False, False, False]


def test_visible(spark):
    assert column(spark, ["a", " ", "\t\n", "", None], clean.has_visible) == [True, False, False, False, False]


@pytest.mark.parametrize("a,b", [("coffee makers", "coffee maker"), ("making coffee", "make coffee"), ("running shoes", "run shoe"), ("berries", "berry"), ("boxes", "box"), ("kettle's lid", "kettle lid")])
def test_stems_meet(spark, a, b):
    assert column(spark, [a], text.analyze) == column(spark, [b], text.analyze)


def test_analyze_drops_stop_words(spark):
    assert column(spark, ["The glass of IT", None], lambda c: text.analyze(c, False)) == [["glass"], []]


def test_bucket_is_crc32(spark):
    import zlib

    assert column(spark, ["kettle", "über"], text.bucket) == [zlib.crc32(w.encode()) % 768 for w in ("kettle", "über")]


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)).cast("float") for i in x])
    one = spark.range(1)
    assert one.select(vector.cosine(v(1, 0), v(1, 1))).first()[0] == pytest.approx(0.5**0.5)
    assert one.select(vector.cosine(v(0, 0), v(1, 1))).first()[0] is None
    assert one.select(vector.normalise(v(3, 4))).first()[0] == pytest.approx([0.6, 0.8])
    assert one.select(vector.normalise(v(0, 0))).first()[0] == [0.0, 0.0]
    assert one.select(vector.quantise(v(3, 4))).first()[0] == [76, 102]
    assert one.select(vector.l2_distance(v(0, 0), v(3, 4))).first()[0] == 5.0
    assert one.select(vector.integer_dot(vector.quantise(v(1, 0)), vector.quantise(v(1, 0)))).first()[0] == 127 * 127


def test_scalars(spark):
    one = spark.sql("SELECT timestamp'2026-07-22 17:30:05.25' AS t, timestamp'2026-07-22 17:30:05' AS u, '{\"a\": {\"b\": 3}}' AS j")
    row = one.select(scalar.iso_utc(F.col("t")), scalar.iso_utc(F.col("u")), scalar.version_stamp(F.col("t")), scalar.json_path(F.col("j"), "a.b"), scalar.json_path(F.col("j"), "a.c", "?"), scalar.strip_slash(F.lit("http://x//"))).first()
    assert list(row) == ["2026-07-22T17:30:05.250000+00:00", "2026-07-22T17:30:05+00:00", "20260722-1730", "3", "?", "http://x"]
    assert spark.range(1).select(scalar.rate(F.lit(10), F.lit(0.0)), scalar.rate(F.lit(10), F.lit(4.0))).first() == (0.0, 2.5)
