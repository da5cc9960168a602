import pytest
from pyspark.sql import functions as F

from helpers import SPOILS, LabelBackend
from shelfmark.operators import embed, gates, knn, probes

AISLES = {
    "kitchen": ("Gooseneck pour kettle", "Chef knife block", "Silicone baking mat", "Espresso tamper"),
    "outdoor": ("Hanging solar lantern", "Folding trail chair", "Tent pegs", "Steel water flask"),
    "home": ("Feather pillow pair", "Woven laundry basket", "Curtain rod", "Desk fan"),
}


def gate(spark, spoil=None, **how):
    labels = {t: g for g, titles in probes.PROBE_GROUPS.items() for t in titles}
    return gates.check_backend(spark, LabelBackend(labels, how.pop("dims", 64), SPOILS.get(spoil)), **how).first()


def test_probe_set_is_sound(spark):
    assert probes.probe_faults(probes.probe_table(spark)) == []


def test_faulty_probe_sets_are_seen(spark):
    assert "a group shares no telling word" in probes.probe_faults(probes.probe_table(spark, AISLES))
    twice = {"a": ("red kettle", "red kettle"), "b": ("kettle blue",)}
    assert probes.probe_faults(probes.probe_table(spark, twice)) == ["titles repeat", "fewer than three groups", "a group has a single title", "a telling word occurs in two groups"]


def test_words_cluster(spark):
    row = gates.check_backend(spark, embed.LexicalBackend(), expect_dims=768).first()
    assert row["ok"] and row["neighbour_rate"] >= 0.9 and row["separation"] > gates.HEALTHY_SEPARATION


def test_aisles_do_not_cluster(spark):
    row = gates.check_backend(spark, embed.LexicalBackend(), groups=AISLES).first()
    assert not row["ok"] and row["neighbour_rate"] < 0.8


def test_sound_engine(spark):
    row = gate(spark)
    assert row["ok"] and (row["dims"], row["texts"], row["groups"]) == (64, 24, 6)


@pytest.mark.parametrize("spoil,says", [("alternating", "nearest neighbour"), ("one point", "same vector"), ("nothing", "zero-length"), ("first one lost", "asked for"), ("refused", "did not answer")])
def test_faults(spark, spoil, says):
    row = gate(spark, spoil)
    assert not row["ok"] and any(says in f for f in row["failures"])
    if spoil == "alternating":
        assert row["dims"] == 64
    if spoil == "one point":
        assert row["duplicates"] > 0
    if spoil == "refused":
        assert "Ready" in row["failures"][0]


def test_dimension_mismatch(spark):
    row = gate(spark, dims=384, expect_dims=768)
    assert "384" in row["failures"][0] and "768" in row["failures"][0]


def test_prefix_reaches_the_backend(spark):
    class Seen(embed.LexicalBackend):
        texts: list = []

        def embed(self, texts):
            self.texts += texts
            return super().embed(texts)

    gates.check_backend(spark, Seen(), prefix="search_document: ")
    assert Seen.texts and all(t.startswith("search_document: ") for t in Seen.texts)


def test_floors():
    assert gates.SEPARATION_FLOOR < gates.HEALTHY_SEPARATION and 0 < gates.RECALL_FLOOR < 1


def vectors(spark, rows, missing=0):
    import random

    rnd = random.Random(4)
    data = [(i, None if i < missing else [rnd.gauss(0, 1) for _ in range(8)]) for i in range(rows)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>")


def test_recall_of_exact_search(spark):
    rows = vectors(spark, 200)
    row = gates.check_recall(rows, lambda p, k: knn.exact_topk(rows, p, k)).first()
    assert row["ok"] and row["mean_recall"] == 1.0 and row["self_hit"] == 1.0 and row["probes"] == 5


def test_recall_of_nothing(spark):
    rows = vectors(spark, 100)
    row = gates.check_recall(rows, lambda p, k: p.select("qid", F.lit(0).cast("long").alias("id")).limit(0)).first()
    assert not row["ok"] and row["mean_recall"] == 0.0


def test_recall_gate_stops_early(spark):
    def never(p, k):
        raise AssertionError("not to be measured")

    assert gates.check_recall(vectors(spark, 0), never).first()["failures"] == ["the table is empty"]
    row = gates.check_recall(vectors(spark, 50, missing=5), never).first()
    assert row["failures"] == ["5 document(s) have no vector"] and row["mean_recall"] is None
    assert gates.check_recall(vectors(spark, 50), never, probes=0).first()["failures"] == ["no probe could be had"]


def test_inverted_file_recall(spark, tmp_path):
    rows = vectors(spark, 600)
    own = knn.probes_by_id(rows, 50)
    index = knn.InvertedFile.build(rows, cells=8)
    index.save(f"file://{tmp_path}/ivf")
    stored = index.at(spark, f"file://{tmp_path}/ivf")
    assert stored.cells.count() == 600
    each = gates.recall_by_probe(knn.exact_topk(rows, own, 10), stored.search(own, 10, cells=6))
    assert each.agg(F.avg("recall")).first()[0] >= 0.9


def test_duplicates_are_all_counted(spark):
    near = [(i, [1.0, 1e-4 * i / 100]) for i in range(100)]
    rows = spark.createDataFrame(near + [(200 + i, [0.0, 1.0]) for i in range(50)] + [(300, [-1.0, 0.0])], "id long, v array<double>")
    assert gates.duplicate_pairs(rows).first()[0] == 100 * 99 // 2 + 50 * 49 // 2


def test_topk_ignores_unfit_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0])], "vec_id long, embedding array<float>")
    probe = spark.createDataFrame([(9, [1.0, 0.0]), (10, [])], "qid long, qv array<double>")
    assert [(r["id"], r["score"], r["place"]) for r in knn.exact_topk(rows, probe, 5).orderBy("place").collect()] == [(1, 2.0, 1), (6, 2.0, 2)]
    with pytest.raises(ValueError):
        knn.exact_topk(rows, probe, 0)


def test_lexical_vectors_agree_with_the_backend(spark):
    texts = ["Glass kettle kettle", "", "Lantern", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r["i"]: r["embedding"] for r in embed.lexical_vectors(rows, "i", "t").collect()}
    for i, v in enumerate(embed.LexicalBackend().embed([t or "" for t in texts])):
        assert found[i] == pytest.approx(v, abs=1e-6)


def test_embed_checks(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "asin string, title string")
    for how in ({"batch_size": 0}, {"workers": 0}):
        with pytest.raises(ValueError):
            embed.embed(rows, embed.LexicalBackend, **how)
    got = {r["asin"]: r["embedding"] for r in embed.embed(rows, embed.LexicalBackend).collect()}
    assert len(got["a"]) == 768 and got["b"] is None
    with pytest.raises(ValueError, match="lexical"):
        embed.get_backend("other")


def test_embed_cache_sends_only_new_texts(spark):
    cache = spark.createDataFrame([("x", "r1", "", [1.0, 2.0])], "text string, revision string, prefix string, vector array<float>")
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y"), ("d", None)], "asin string, title string")
    got = {r["asin"]: r["embedding"] for r in embed.embed_cached(rows, cache, lambda: embed.LexicalBackend(2), "r1").collect()}
    assert got["a"] == [1.0, 2.0] and got["b"] == got["c"] and got["d"] is None


def test_http_backend_retries(monkeypatch):
    import urllib.error

    waits = []
    backend = embed.HttpBackend("http://x/", wait=waits.append)
    codes = iter([429, 429, 200])

    def call(path, body=None):
        code = next(codes)
        if code != 200:
            raise urllib.error.HTTPError("http://x", code, "", None, None)
        return [[1.0]]

    monkeypatch.setattr(backend, "_call", call)
    assert backend.embed(["a"]) == [[1.0]] and waits == [0.5, 1.0]
    for code, kind in ((413, embed.BatchTooLarge), (500, RuntimeError), (429, embed.Overloaded)):
        codes = iter([code] * 9)
        with pytest.raises(kind):
            backend.embed(["a"])
