from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from shelfmark.config import Settings
from shelfmark.operators import embed, upsert
from shelfmark.plans.ingest import GateFailed, ingest_catalogue, ingest_vectors
from shelfmark.plans.publish import Catalogue, next_version
from shelfmark.sources.contract import Contract, product_contract
from shelfmark.streaming.upsert import upsert_stream

HEADER = "asin,title,imgUrl,productURL,stars,reviews,price,listPrice,category_id,isBestSeller\n"
ROWS = '''A1,"Kettle, ""glass""",i,p,4.5,10,1_000,5d,12.0,True
A2,"Two
lines",i,p,abc,4.9,9.5,,7,False
,No key,i,p,1,1,1,1,1,True
A3,NULL,i,p,1,1,1,1,1,False
0012,Zeros,i,p,1,1,1,1,1,False
A1,Kettle again,i,p,3.5,11,2,1,1,False
'''


@pytest.fixture
def csv(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/amazon_products.csv").write_text(HEADER + ROWS)
    return str(tmp_path / "in")


@pytest.fixture
def settings(tmp_path):
    return replace(Settings.from_env({}), warehouse=f"file://{tmp_path}/wh", workers=2)


def test_settings():
    own = Settings.from_env({"SHELFMARK_BACKEND": " HTTP ", "SHELFMARK_WORKERS": "7", "SHELFMARK_BACKEND_URL": "http://x:1/"})
    assert (own.backend, own.workers, own.backend_url, own.replicas) == ("http", 7, "http://x:1", 0)


def test_catalogue(spark, csv, settings):
    done = ingest_catalogue(spark, csv, settings)
    assert (done.loaded.indexed, done.loaded.rejected, done.documents) == (5, 0, 4)
    catalogue = Catalogue(spark, settings.warehouse)
    rows = {r["asin"]: r for r in catalogue.read(settings.index).collect()}
    assert set(rows) == {"A1", "A2", "A3", "0012"}
    assert rows["A1"]["title"] == "Kettle again" and rows["A1"]["price"] == 2.0 and not rows["A1"]["isBestSeller"]
    assert rows["A2"]["title"] == "Two\nlines" and rows["A2"]["stars"] is None and rows["A2"]["reviews"] == 4
    assert rows["A3"]["title"] is None
    assert ingest_catalogue(spark, csv, settings).documents == 4 and catalogue.files(settings.index) == 1


def test_limits_count_documents(spark, csv, settings):
    counts = [ingest_catalogue(spark, csv, settings, limit=n, dry_run=True).documents for n in (None, 0, -1, 3)]
    assert counts == [5, 0, 0, 3]


def test_vectors_are_published(spark, csv, settings):
    done = ingest_vectors(spark, csv, settings)
    assert done.published and done.documents == 3 and done.target.startswith("amazon_products_embeddings_v1_")
    catalogue = Catalogue(spark, settings.warehouse)
    assert catalogue.target(settings.vector_alias) == done.target
    shown = catalogue.display(settings.vector_alias, product_contract(768))
    assert "embedding" not in shown.columns and shown.count() == 3
    assert ingest_vectors(spark, csv, settings, recreate=False).target == done.target and catalogue.count(settings.vector_alias) == 3


class Silent(embed.LexicalBackend):
    """Answers with empty vectors."""

    def embed(self, texts):
        return [[0.0] * self.dims for _ in texts]


def test_dry_run_runs_the_gate(spark, csv, settings):
    done = ingest_vectors(spark, csv, settings, dry_run=True)
    assert done.documents == 4 and done.sample[0]["dims"] == 768 and len(done.sample[0]["first"]) == 5
    with pytest.raises(GateFailed, match="zero-length"):
        ingest_vectors(spark, csv, settings, dry_run=True, make=Silent)


def test_failed_gates_leave_the_alias(spark, csv, settings):
    first = ingest_vectors(spark, csv, settings)
    with pytest.raises(GateFailed, match="recall"):
        ingest_vectors(spark, csv, settings, search=lambda p, k: p.selectExpr("qid", "CAST(0 AS long) AS id").limit(0))
    catalogue = Catalogue(spark, settings.warehouse)
    assert catalogue.target(settings.vector_alias) == first.target and len(catalogue.names()) >= 1


def test_version_names():
    from datetime import datetime

    now = datetime(2026, 7, 22, 17, 30)
    assert next_version([], "b", now) == "b_v1_20260722-1730"
    assert next_version(["b_v1", "b_v3_20260722-1730", "b_v9_other", "bb_v40"], "b", now) == "b_v4_20260722-1730"


def test_pointer(spark, tmp_path):
    catalogue = Catalogue(spark, f"file://{tmp_path}/wh")
    contract = Contract.from_mapping({"mappings": {"properties": {"id": {"type": "long"}}}}, "id", ("id",))
    assert catalogue.write_target("x", "live") == "x_v1"
    assert catalogue.create("x", contract) and not catalogue.create("x", contract)
    assert catalogue.write_target("x", "live") == "x"
    assert catalogue.create("x_v2", contract)
    assert catalogue.publish("live", "x") == [] and catalogue.publish("live", "x") == []
    assert catalogue.publish("live", "x_v2") == ["x"] and catalogue.target("live") == "x_v2"
    assert catalogue.rollback("live", "x") == ["x_v2"]
    catalogue._put("live", "x x_v2")
    with pytest.raises(ValueError, match="several"):
        catalogue.target("live")
    with pytest.raises(ValueError, match="no version"):
        catalogue.publish("live", "none")


def test_readers_of_a_version_see_it_whole(spark, tmp_path):
    catalogue = Catalogue(spark, f"file://{tmp_path}/wh")
    contract = Contract.from_mapping({"mappings": {"properties": {"id": {"type": "long"}, "v": {"type": "long"}}}}, "id", ("id",))
    frame = lambda v: spark.range(100).select("id", F.lit(v).cast("long").alias("v"))
    catalogue.load("x_v1", frame(1), contract, "none")
    catalogue.publish("live", "x_v1")
    reader = catalogue.read("live")
    catalogue.load("x_v1", frame(2), contract, "none")
    assert {r["v"] for r in reader.collect()} == {1}  # opened before the load, and its files stay
    assert {r["v"] for r in catalogue.read("live").collect()} == {2}
    catalogue.compact("x_v1", 1)
    assert catalogue.files("x_v1") == 1 and catalogue.count("live") == 100
    with pytest.raises(RuntimeError, match="another load"):
        catalogue._advance("x_v1", "g000001-00000000", frame(3))
    assert {r["v"] for r in catalogue.read("live").collect()} == {2} and not [n for n in catalogue.names() if n != "x_v1"]


def test_calls_are_full_across_batches(spark):
    class Counting:
        """Says with each vector how many texts its call had."""

        def embed(self, texts):
            return [[float(len(texts))] for _ in texts]

    class Losing:
        def embed(self, texts):
            return [[1.0]] * (len(texts) - 1)

    frame = spark.range(1000, numPartitions=1).select("id", F.when(F.col("id") % 10 > 0, F.col("id").cast("string")).alias("title"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        rows = embed.embed(frame, Counting, batch_size=64, workers=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["id"] for r in rows] == list(range(1000)) and all((r["embedding"] is None) == (r["id"] % 10 == 0) for r in rows)
    assert [r["embedding"][0] for r in rows if r["embedding"]] == [64.0] * 896 + [4.0] * 4
    with pytest.raises(Exception, match="vectors, asked for"):
        embed.embed(frame, Losing, batch_size=64).collect()
    with pytest.raises(ValueError, match="workers"):
        embed.embed(frame, Counting, workers=0)


def test_contract(spark):
    contract = product_contract(4)
    assert contract.vector_dims() == 4 and contract.hidden == {"embedding"} and product_contract().vector_dims() is None
    with pytest.raises(ValueError, match="undeclared"):
        contract.check_columns(spark.range(1))
    own = Contract.from_mapping('{"mappings": {"properties": {"k": {"type": "keyword"}, "v": {"type": "dense_vector", "dims": 2}}}}', "k", ("k",))
    rows = spark.createDataFrame([("a", [1.0, 2.0]), (None, [1.0, 2.0]), ("b", [1.0]), ("c", None)], "k string, v array<float>")
    good, bad = own.split(rows)
    assert sorted(r["k"] for r in good.collect()) == ["a", "c"]
    assert sorted(r["problems"][0] for r in bad.collect()) == ["k is null", "v has 1 entries, not 2"]


def test_last_wins_and_merge(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 1, "y"), ("a", 2, "z")], "k string, seq int, v string")
    assert sorted(map(tuple, upsert.last_wins(rows, "k", "seq", "v").collect())) == [("a", 2, "z"), ("b", 1, "y")]
    old = spark.createDataFrame([("a", 0, "o"), ("c", 0, "o")], "k string, seq int, v string")
    assert sorted(r["k"] + r["v"] for r in upsert.merge(old, upsert.last_wins(rows, "k", "seq", "v"), "k").collect()) == ["az", "by", "co"]


def test_stream(spark, csv, tmp_path):
    where = (csv, f"file://{tmp_path}/wh", "stream", f"file://{tmp_path}/check")
    upsert_stream(spark, *where).awaitTermination()
    (tmp_path / "in/more.csv").write_text(HEADER + "A2,New title,i,p,1,1,1,1,1,True\nA9,Nine,i,p,1,1,1,1,1,True\n")
    upsert_stream(spark, *where).awaitTermination()
    rows = {r["asin"]: r["title"] for r in Catalogue(spark, where[1]).read("stream").collect()}
    assert rows["A2"] == "New title" and rows["A9"] == "Nine" and len(rows) == 5


def test_cli(spark, csv, settings, capsys):
    from shelfmark.cli import main

    assert main(["catalogue", "--csv", csv, "--warehouse", settings.warehouse, "--limit", "2"], spark) == 0
    assert "2 documents" in capsys.readouterr().out
