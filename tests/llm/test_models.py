import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import DATA, same_rows
from shelfmark.llm import decontaminate, langid, ngram_lm, toxicity
from shelfmark.llm.eliasfano import EliasFano
from shelfmark.llm.folds import fold
from shelfmark.llm.queries import ORACLE_SQL, QUERIES

# decontamination


def test_contamination_oracle(spark, duck):
    same_rows(QUERIES["op1_decontaminate"](spark, DATA), duck.sql(ORACLE_SQL["op1_decontaminate"]))


@pytest.fixture
def items(spark):
    rows = [("b", "Hello, big WORLD"), ("a", "one two three four five six seven eight nine ten eleven"), (None, "zzz yyy"), ("e", None), ("f", " .! ")]
    return spark.createDataFrame(rows, "item_id string, text string")


@pytest.mark.parametrize("bound", [10, 1 << 20])
def test_contamination_edges(edge, empty, items, spark, bound):
    rows = decontaminate.find_contamination(edge, items, automaton_bytes=bound)
    by = {}
    for r in rows.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, by.values())) == 11
    assert by[1][0]["n_words"] == by[2][0]["n_words"] == by[3][0]["n_words"] == 0
    for i in (None, 4, 8):
        assert all((r["n_hit"], r["items"], r["contaminated"]) == (3, ["b"], True) for r in by[i])
    assert (by[8][0]["spans"][0]["start"], by[8][0]["spans"][0]["end"]) == (0, 16) and not by[5][0]["contaminated"]
    assert decontaminate.find_contamination(empty, items, automaton_bytes=bound).collect() == []
    assert not any(r["contaminated"] for r in decontaminate.find_contamination(edge, items.limit(0), automaton_bytes=bound).collect())
    left = decontaminate.drop_contaminated(edge, items, automaton_bytes=bound)
    assert left.columns == edge.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 5, 6, 7, 9]


def test_hits_join_and_map_back(spark, items):
    text = "Été: xx; One two, three four five six seven eight nine ten eleven. ZZZ-yyy one two three"
    row = decontaminate.find_contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), items).first()
    assert row["n_hit"] == 13 and row["items"] == ["a"] and [text[s["start"] : s["end"]] for s in row["spans"]] == ["One two, three four five six seven eight nine ten eleven. ZZZ-yyy"]


# language ID


def test_language_accuracy(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op5_langid"](spark, "/root/testdata/sf0.01").join(frame, "doc_id").filter("held_out AND lang_pred <> 'und'")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_gradients():
    net = langid.ByteNet(["a", "b"], seed=1)
    rng = np.random.default_rng(1)
    net.embed = net.embed.astype(np.float64)
    net.filters = [f.astype(np.float64) for f in net.filters]
    net.bias, net.out, net.shift = (x.astype(np.float64) for x in (rng.normal(0, 0.1, net.bias.shape), net.out, net.shift))
    x, y = rng.integers(97, 110, (5, langid.LENGTH)).astype(np.uint8), np.array([0, 1, 1, 0, 1])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(5), y]).mean()
    for p, g in zip(net.parameters(), net.gradients(x, y)):
        for at in rng.integers(0, p.size, 4):
            spot = np.unravel_index(at, p.shape)
            if p is net.embed and spot[0] == 0:
                continue
            keep, e = p[spot], 1e-6
            p[spot] = keep + e
            up = loss()
            p[spot] = keep - e
            down = loss()
            p[spot] = keep
            assert g[spot] == pytest.approx((up - down) / (2 * e), abs=1e-5)


def test_windows_are_independent():
    net = langid.ByteNet(["a", "b", "c"], seed=2)
    x = np.random.default_rng(0).integers(1, 255, (7, langid.LENGTH)).astype(np.uint8)
    assert np.allclose(net.probabilities(x), np.concatenate([net.probabilities(x[i : i + 1]) for i in range(7)]), atol=1e-5)


def test_language_edges(edge, empty):
    net = langid.fit(edge, F.lit(True))
    assert net.classes == ["en"]
    rows = {r["doc_id"]: r for r in langid.predict(edge, net).collect()}
    assert {i for i, r in rows.items() if r["lang_pred"] == "und"} == {1, 2, 3, 9} and all(0 <= r["score"] <= 1 for r in rows.values())
    assert langid.fit(empty, F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.predict(edge, None).collect()} == {"und"}
    assert langid.predict(empty, net).collect() == []
    kept = langid.keep_known(edge, net)
    assert kept.columns == edge.columns and kept.count() == 7


# toxicity


def slow_segments(scores):
    """Maximal scoring subsequences by their definition: take the best one, then look left and right of it."""
    if not scores:
        return []
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 1e-12 and (best is None or total > best[2] + 1e-12):
                best = (a, b + 1, total)
    if best is None:
        return []
    a, b, s = best
    return slow_segments(scores[:a]) + [(a, b, s)] + [(x + b, y + b, t) for x, y, t in slow_segments(scores[b:])]


def test_segments():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(0, 25))
        own = {i: float(rng.choice([-2.0, 1.3, 2.7, 0.9])) + float(rng.normal(0, 0.01)) for i in range(n) if rng.random() < 0.5}
        got = toxicity.maximal_segments(sorted(own.items()))
        want = slow_segments([own.get(i, toxicity.NEUTRAL) for i in range(n)])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_toxicity_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out")
    n = got.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int")).alias("right"), F.sum(F.expr("toxic * predicted")).alias("hit"), F.sum("toxic").alias("all")).first()
    assert n["right"] > 0.96 and n["hit"] > 0.75 * n["all"]


def test_log_odds_equal_the_formula(spark):
    rows = [(b"bad", 2, 40), (b"good", 60, 3), (b"both", 30, 30), (b"rare", 0, 1)]
    got = toxicity.log_odds(spark.createDataFrame(rows, "word binary, clean long, toxic long"), prior=10.0, least_z=1.0, least_odds=0.5)
    c, t = sum(r[1] for r in rows), sum(r[2] for r in rows)
    want = {}
    for word, clean, toxic in rows:
        own = 0.5 + 10.0 * (clean + toxic) / (c + t)
        odds = np.log((toxic + own) / (t + 10.0)) - np.log((clean + own) / (c + 10.0))
        if abs(odds) >= 0.5 and abs(odds) >= np.sqrt(1 / (toxic + own) + 1 / (clean + own)):
            want[word] = odds
    assert got.keys() == want.keys() and {b"bad", b"good"} <= got.keys()
    assert all(abs(got[w] - want[w]) < 1e-12 for w in want)


def test_toxicity_learns_only_from_learning_rows(spark):
    texts = spark.createDataFrame([(i, ("vile awful " if i % 3 == 0 else "kind calm ") + f"word{i} of text {i * 7}") for i in range(300)], "doc_id long, text string")
    labels = texts.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    learn = F.col("doc_id") < 200
    model = toxicity.fit(texts, labels, learn)
    other = toxicity.fit(texts, labels.withColumn("toxic", F.when(learn, F.col("toxic")).otherwise(1 - F.col("toxic"))), learn)
    assert (model.weights, model.rate, model.place, model.slope, model.shift) == (other.weights, other.rate, other.place, other.slope, other.shift)
    scored = toxicity.score(texts, model).join(labels, "doc_id").filter(~learn).collect()
    assert all((r["score"] >= 0.5) == bool(r["toxic"]) for r in scored)


def test_toxicity_edges(edge, empty, spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(edge, labels, F.lit(True))
    rows = toxicity.score(edge, model).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    none = toxicity.fit(edge, labels.limit(0), F.lit(True))
    assert all(r["score"] < 0.5 and r["passages"] == [] for r in toxicity.score(edge, none).collect())
    assert toxicity.score(empty, model).collect() == []


def test_passages_are_in_the_original(spark):
    model = toxicity.Model({b"bad": 5.0, b"r\xc3\xa9*": 5.0}, rate=1.0, place=0.001)
    text = "Ünder all. BAD, bad bad! fine words follow here and there and so on"
    row = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [text[p["start"] : p["end"]] for p in row["passages"]] == ["BAD, bad bad"]


# language model


def test_elias_fano():
    rng = np.random.default_rng(0)
    for _ in range(150):
        v = np.sort(rng.integers(0, int(rng.choice([1, 7, 1000, 2**40, 2**62])), rng.integers(0, 400)).astype(np.uint64))
        if len(v) and rng.random() < 0.3:
            v = np.sort(np.concatenate((v, np.full(300, v[0]))))
        own = EliasFano.build(v)
        q = np.concatenate((v, v + np.uint64(1), np.array([0, 2**63], np.uint64)))
        at, same = own.successor(q)
        assert (own.get(np.arange(len(v))) == v).all() and (at == np.searchsorted(v, q)).all() and (same == np.isin(q, v)).all()


def test_scores_match_brute_force(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(ngram_lm, "VOCABULARY_BYTES", 1 << 18)
    trie = ngram_lm.fit(docs, fold(F.col("doc_id"), 7) != 2, tokens_per_file=5000)
    assert len(trie.vocabulary) > 1 and len(trie.level2) > 3 and len(trie.level3) > 3
    split = {i: t.encode().lower().split() + [b"\n"] for i, t in texts.items()}
    one, two, three, before, follow, follow2, total2 = (Counter() for _ in range(7))
    for i, t in split.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            s = [None, *t]
            one.update(t)
            two.update(zip(s, s[1:]))
            three.update(zip(s, s[1:], s[2:]))
            before.update(s[:-1])
    follow.update(a for a, _ in two)
    follow2.update((a, b) for a, b, _ in three)
    for (a, b, _), n in three.items():
        total2[a, b] += n
    n, v, d = sum(one.values()), len(one), ngram_lm.DISCOUNT
    assert (trie.tokens, trie.words) == (n, v)
    for r in ngram_lm.score(docs, trie).collect():
        t = split[r["doc_id"]]
        s, score, base = [None, *t], 0.0, 0.0
        for i in range(1, len(s)):
            p = (one[s[i]] + 1) / (n + v + 1)
            base += math.log10(p)
            a = s[i - 1]
            if before[a]:
                p = max(two[a, s[i]] - d, 0) / before[a] + d * follow[a] / before[a] * p
            if i > 1 and total2[s[i - 2], a]:
                k = (s[i - 2], a)
                p = max(three[(*k, s[i])] - d, 0) / total2[k] + d * follow2[k] / total2[k] * p
            score += math.log10(p)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["n_tokens"] == len(t) and r["n_known"] == sum(one[w] > 0 for w in t)
        assert abs(r["score"] - score) < 2e-4 * len(t)  # stored probabilities have steps of 1/8192 of a power of ten


def test_model_is_better_than_its_base(spark):
    got = QUERIES["op10_ngram_lm"](spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (got["s"] - got["b"]) / got["n"] > 0.3


def test_language_model_edges(edge, empty):
    trie = ngram_lm.fit(edge, F.lit(True))
    rows = {r["doc_id"]: r for r in ngram_lm.score(edge, trie).collect()}
    assert rows[1]["n_tokens"] == rows[2]["n_tokens"] == rows[3]["n_tokens"] == 1 and rows[4]["n_tokens"] == 4
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows.values())
    none = ngram_lm.fit(empty, F.lit(True))
    assert {r["n_known"] for r in ngram_lm.score(edge, none).collect()} == {0}
    assert ngram_lm.score(empty, trie).collect() == []
