"""The pipeline against a plain version of each stage, and its stages on odd rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helpers import DATA
from shelfmark.llm import simhash


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that each stage keeps."""
    from shelfmark.llm.storage import stage

    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, DATA), name)
        out.append(docs)
    return out


def test_columns(spark, stages):
    columns = spark.read.parquet(f"{DATA}/documents.parquet").columns
    assert all(s.columns == columns for s in stages[:-1]) and len(corpus_pipeline.STAGES) == 5
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids", "decoded"]


def test_language_stage_keeps_clean_texts(stages, texts):
    left = {r["doc_id"] for r in stages[0].collect()}
    assert len(left) >= 0.99 * sum(any(c.isalpha() for c in t) for t in texts.values())


def test_line_stage(stages):
    seen = {}
    for r in stages[1].collect():
        assert r["n_chars"] == len(r["text"])
        for line in r["text"].split("\n"):
            if line.strip():
                assert seen.setdefault(line.strip(" \t\r\x0b\x0c"), r["doc_id"]) == r["doc_id"] and list(r["text"].split("\n")).count(line) == 1


def shingles(text):
    found = text.encode().lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def groups_of(texts):
    """Sets of ids reachable over five-word Jaccard similarity of 0.8 or more, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    near = {i: {j for j in sets if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    groups, todo = [], set(sets)
    while todo:
        group, edge = set(), {min(todo)}
        while edge:
            group |= edge
            edge = {j for i in edge for j in near[i]} - group
        groups.append(group)
        todo -= group
    return groups


def test_near_copies_stage(stages):
    texts = {r["doc_id"]: r["text"] or "" for r in stages[1].collect()}
    left = {r["doc_id"] for r in stages[2].collect()}
    assert left == {min(g) for g in groups_of(texts)}


def test_near_copies_of_every_similarity(spark):
    """Texts with some words replaced: whatever is at 0.8 or more of another one goes, whatever isn't stays."""
    rng, texts = random.Random(5), {}
    for base in range(60):
        words = [f"w{rng.randrange(100000)}" for _ in range(rng.choice((8, 40, 300)))]
        for edits in (0, 0, 1, 2, 4, 6, 8):
            own = list(words)
            for at in rng.sample(range(len(own)), min(edits, len(own))):
                own[at] = f"x{rng.randrange(100000)}"
            texts[len(texts)] = " ".join(own)
    rows = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(5)
    left = {r["doc_id"] for r in simhash.keep_one(rows).collect()}
    want = {min(g) for g in groups_of(texts)}
    assert want <= left and len(left) <= len(want) + 2


def test_large_group_of_near_copies(spark, monkeypatch):
    """One text of a group that is larger than what one task compares with its hub."""
    monkeypatch.setattr(simhash, "HUB", 50)
    rng = random.Random(6)
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(words[:k] + [f"x{i}"] + words[k + 1 :])) for i in range(400) for k in [rng.randrange(200)]] + [(1000, "other text of its own here")]
    left = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {0, 1000}


def test_benchmark_stage(spark, stages):
    from shelfmark.llm.decontaminate import windows, words

    held = [w for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() for w in (b" " + b" ".join(x) + b" " for x in windows(r["text"].encode()))]
    clean = {r["doc_id"] for r in stages[2].collect() if not any(h in b" " + b" ".join(words(r["text"].encode())) + b" " for h in held)}
    assert {r["doc_id"] for r in stages[3].collect()} == clean


def test_last_stage(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    assert {r["doc_id"]: r["decoded"] for r in stages[4].collect()} == before


def test_run_is_the_stages(spark, stages):
    want = {(r["doc_id"], r["n_tokens"]) for r in stages[-1].collect()}
    assert {(r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, DATA).collect()} == want


@pytest.mark.parametrize("which", ["edge", "empty"])
def test_stages_take_odd_rows(spark, request, which):
    from shelfmark.llm.storage import stage

    rows = stage(request.getfixturevalue(which).withColumn("n_chars", F.lit(None).cast("long")), "odd")
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, rows, DATA)
        assert out.columns == rows.columns and out.count() <= rows.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, rows, DATA).count() == rows.count()
