import hashlib
import time
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helpers import DATA, same_rows
from shelfmark.llm import components as components_module
from shelfmark.llm import exact_dedup, line_dedup, simhash, storage, substring_dedup
from shelfmark.llm.components import components
from shelfmark.llm.queries import ORACLE_SQL, QUERIES


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# exact dedup


def test_exact_oracle(spark, duck):
    same_rows(QUERIES["op4_exact_dedup"](spark, DATA), duck.sql(ORACLE_SQL["op4_exact_dedup"]))


@pytest.mark.parametrize("bucket_bytes", [64, 1 << 20])
def test_exact_edges(edge, bucket_bytes):
    rows = exact_dedup.exact_dedup(edge, bucket_bytes=bucket_bytes).collect()
    assert len(rows) == 11
    by = defaultdict(list)
    for r in rows:
        by[r["text_sha256"]].append(r)
    blank = by[hashlib.sha256(b"").hexdigest()]
    assert {r["doc_id"] for r in blank} == {1, 2, 3} and {r["keep_id"] for r in blank} == {3} and {r["group_size"] for r in blank} == {3}
    hello = by[hashlib.sha256(b"hellobigworld").hexdigest()]
    assert sorted(map(str, (r["doc_id"] for r in hello))) == ["4", "4", "None"] and {r["keep_id"] for r in hello} == {4} and sum(r["kept"] for r in hello) == 1
    assert all(sum(r["kept"] for r in g) == 1 and g[0]["group_size"] == len(g) for g in by.values())


def test_exact_empty(empty):
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_colliding_keys_are_told_apart():
    chains = exact_dedup.Chains(1000)
    assert [chains.find(7, b, i) for i, b in enumerate([b"a", b"b", b"a", b"c", b"b"])] == [0, 1, 0, 3, 1]


def test_directory_splits_overfull_buckets():
    # prefixes 0 and 1 are heavy, the rest is light
    owners = exact_dedup.directory([(0, 90), (1, 90), (2, 5), (7, 5)], 3, 100)
    assert owners == sorted(owners) and owners[0] != owners[1] and owners[4] == owners[7]
    assert exact_dedup.directory([], 2, 10) == [0, 0, 0, 0]
    assert len(set(exact_dedup.directory([(3, 1000)], 2, 10))) == 3  # one key can't be split further


# components


def test_components(spark):
    rnd = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rnd.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    sets = Sets(1100)
    for a, b in pairs:
        sets.join(a, b)
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert found == {n: sets.find(n) for n in nodes}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("one_task", [0, 100_000])
def test_components_of_few_edges_in_one_task(spark, monkeypatch, one_task):
    """Chains that need more rounds than one task takes at once, groups and lone pairs; few edges don't cost a dozen jobs a round."""
    monkeypatch.setattr(components_module, "ONE_TASK", one_task)
    rnd = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rnd.permutation(400)[:, None] + [[0, 400]]] + [(1000 + i, 1001 + i) for i in range(300)] + [(2000, 2000 + i) for i in range(1, 50)] + [(7, 7)]
    sets = Sets(2100)
    for a, b in pairs:
        sets.join(a, b)
    edges = spark.createDataFrame(pairs, "u long, v long")
    spark.sparkContext.setJobGroup(f"components-{one_task}", "")
    found = components(edges)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{one_task}"))
    spark.sparkContext.setJobGroup("", "")
    assert {r["node"]: r["component"] for r in found.collect()} == {n: sets.find(n) for a, b in pairs if a != b for n in (a, b)}
    assert jobs <= 10 or not one_task


def test_shuffle_files_go_when_a_table_is_written(spark):
    """Else they stay on disk until the driver happens to collect its garbage."""
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    setting = spark.conf.get(storage._CLEANUP, None)

    def files():
        return {f.getName() for f in (held.getAllFiles().apply(i) for i in range(held.getAllFiles().size())) if f.getName().startswith("shuffle_")}

    before = files()
    table = storage.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert table.count() == 7 and spark.conf.get(storage._CLEANUP, None) == setting
    own = files() - before
    for _ in range(50):
        if not own & files():
            break
        time.sleep(0.2)
    shuffles = {name.split("_")[1] for name in own & files()}
    assert len(shuffles) <= 1  # that of the count just made


# SimHash


def slow_fingerprint(text, size=3):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark, texts):
    ids = sorted(texts)
    marks = [slow_fingerprint(texts[i]) for i in ids]
    sets = Sets(len(ids))
    for a in range(len(ids)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= 2:
                sets.join(a, b)
    want = {i: (f"{m:016x}", ids[sets.find(k)]) for k, (i, m) in enumerate(zip(ids, marks))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash"](spark, DATA).collect()} == want


def test_simhash_edges(edge, empty):
    rows = simhash.simhash_groups(edge).collect()
    assert len(rows) == 11
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fp"] == by[2]["fp"] == by[3]["fp"] == 0 and by[3]["component_id"] == 1
    assert by[None]["component_id"] == 4 and by[8]["component_id"] == 4
    assert simhash.simhash_groups(empty).collect() == []
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6, 7, 9]
    assert simhash.keep_one(empty).collect() == []


@pytest.mark.parametrize("sample", [40, 300])
def test_pairs_across_shards_are_found(spark, sample):
    rnd = np.random.default_rng(9)
    base = rnd.integers(0, 1 << 63, 60, dtype=np.uint64)
    marks = set(base.tolist())
    for b in base.tolist():
        for _ in range(12):
            m = b
            for bit in rnd.integers(0, 64, rnd.integers(1, 4)).tolist():
                m ^= 1 << bit
            marks.add(m)
    marks = sorted(marks)
    sets = Sets(len(marks))
    for a in range(len(marks)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= 2:
                sets.join(a, b)
    signed = np.array(marks, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(m,) for m in signed], "fp long")
    found = {r["node"]: r["component"] for r in simhash.link_fingerprints(frame, 2, shard=16, sample=sample).collect()}
    groups = defaultdict(set)
    for m, c in found.items():
        groups[c].add(m)
    want = defaultdict(set)
    for k, m in enumerate(signed):
        want[sets.find(k)].add(m)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_tree_prunes_nothing_it_needs():
    rnd = np.random.default_rng(1)
    points = np.unique(rnd.integers(0, 1 << 20, 3000, dtype=np.uint64))
    got = set()
    for q, p in simhash.VantageTree(points, leaf=8).pairs(points):
        got |= set(zip(q.tolist(), p.tolist()))
    want = np.argwhere(np.bitwise_count(points[:, None] ^ points[None]) <= 2)
    assert got == set(map(tuple, want.tolist()))


# lines


def brute_lines(rows, least=line_dedup.LEAST, size=line_dedup.SHINGLE):
    """Sets of (id, pos) of similar lines."""
    lines = [(i, k, line.strip(" \t\r\x0b\x0c")) for i, t in rows if t is not None for k, line in enumerate(t.split("\n")) if line.strip(" \t\r\x0b\x0c")]
    sets = [{s[j : j + size] for j in range(len(s) - size + 1)} or {s} for _, _, s in lines]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    found = Sets(len(lines))
    for k, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                common[j] += j < k
        for j, n in common.items():
            if n and n >= least * (len(s) + len(sets[j]) - n):
                found.join(k, j)
    groups = defaultdict(set)
    for k, (i, p, _) in enumerate(lines):
        groups[found.find(k)].add((i, p))
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_lines_match_brute_force(docs, texts):
    rows = line_dedup.line_components(docs).collect()
    got, kept = defaultdict(set), defaultdict(list)
    for r in rows:
        got[r["component"]].add((r["id"], r["pos"]))
        kept[r["component"]] += [(r["id"], r["pos"])] * r["kept"]
    want = brute_lines(texts.items())
    got = {frozenset(g) for g in got.values()}
    assert len(want ^ got) <= 0.02 * len(want)  # banding finds a pair at the least similarity with probability 0.985
    assert all(len(k) == 1 for k in kept.values())


def test_lines_query(spark, texts):
    first = {min(g) for g in brute_lines(texts.items())}
    dropped = {x for g in brute_lines(texts.items()) for x in g} - first
    rows = {r["doc_id"]: r for r in QUERIES["op7_line_dedup"](spark, DATA).collect()}
    assert set(rows) == set(texts)
    wrong = 0
    for i, t in texts.items():
        left = [x for k, x in enumerate(t.split("\n")) if (i, k) not in dropped]
        wrong += hashlib.sha256("\n".join(left).encode()).hexdigest() != rows[i]["text_sha256"]
        assert rows[i]["n_lines"] == t.count("\n") + 1
    assert wrong <= 0.02 * len(texts)


def test_signatures_are_least_values_of_bins(docs):
    """Bins are filtered, so a row of a shingle writes one of them; a band's key is null only where none of its bins and none that they turn to has a value."""
    lines = line_dedup._lines(storage.with_places(docs, "test"), "c0", "c1")
    signed = line_dedup._signed(lines)
    assert "FILTER (WHERE" in signed._jdf.queryExecution().executedPlan().toString()
    assert signed.agg(F.sum("n")).first()[0] == lines.count()
    some = lines.filter("length(line) between 20 and 60").limit(20)
    held = {(r["h"], r["g"]): r for r in line_dedup._signed(some).collect()}
    for r in some.select("h", "g", "line").distinct().collect():
        own, wide = {}, r["line"].encode("utf-16-be")
        for i in range(0, max(len(wide) - 2 * line_dedup.SIGNED, 0) + 1, 2):
            mark = xxhash.xxh64_intdigest(wide[i : i + 2 * line_dedup.SIGNED], 42)
            own[(mark & 0xFFFF) % line_dedup.BINS] = min(mark >> 33, own.get((mark & 0xFFFF) % line_dedup.BINS, 1 << 31))
        full = [next((own[k] for k in (j, *((j * t + 1) % line_dedup.BINS for t in line_dedup.TURNS)) if k in own), -1) for j in range(line_dedup.BINS)]
        row = held[r["h"], r["g"]]
        assert row["lo"] == sum((m & 1) << j for j, m in enumerate(full)) and row["hi"] == sum((m >> 1 & 1) << j for j, m in enumerate(full))


@pytest.mark.parametrize("cuts", [0, 10_000_000])
def test_texts_are_joined_with_cuts_of_any_number(docs, edge, monkeypatch, cuts):
    """The same rows whether the lines to be cut are broadcast or the texts are shuffled; more than CUTS aren't broadcast."""
    monkeypatch.setattr(line_dedup, "CUTS", cuts)
    left = line_dedup.dedup_lines(docs)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (cuts > 0)
    want = {min(g) for g in brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert left.count() == docs.count() and left.agg(F.sum("n_dropped")).first()[0] > len(want) / 2
    assert sum(r["n_dropped"] for r in line_dedup.dedup_lines(edge).collect()) == 2  # three equal lines


def test_variants_of_one_line_meet(spark):
    base = "the quick brown fox jumps over the lazy dog while forty two other animals watch the scene from the old barn "
    rows = [(i, base + f"number {i:04d}") for i in range(300)] + [(1000, "something else entirely that nobody repeats"), (1001, "é" * 50), (1002, " " + "é" * 50 + " ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    parts = defaultdict(set)
    for r in line_dedup.line_components(frame).collect():
        parts[r["component"]].add(r["id"])
    assert sorted(map(sorted, parts.values())) == [list(range(300)), [1001, 1002]]


def test_pairs_of_one_template_meet(spark):
    rnd, rows = np.random.default_rng(4), []
    base = random_words(rnd, 40)[:200]
    for i in range(150):
        own = "".join(chr(97 + c) for c in rnd.integers(0, 26, 26))
        rows += [(i, f"{base[:100]} {own} {base[100:]}"), (i + 1000, f"{base[:50]}{i % 10}{base[51:100]} {own} {base[100:]}")]
    want = {frozenset(i for i, _ in g) for g in brute_lines(rows)}
    assert want == {frozenset((i, i + 1000)) for i in range(150)}  # similar within a pair, a shared bucket for many pairs
    got = defaultdict(set)
    for r in line_dedup.line_components(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["component"]].add(r["id"])
    assert set(map(frozenset, got.values())) == want


def test_short_lines_and_letter_cases_meet(spark):
    rnd, rows = np.random.default_rng(6), []
    for i in range(40):
        line = random_words(rnd, 20)[:60].strip().ljust(60, "z")
        rows += [(i, line), (i + 100, line[:30] + "#" + line[31:]), (i + 200, line.upper())]  # one character of 60: 51 of 61 shingles
    got = defaultdict(set)
    for r in line_dedup.line_components(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["component"]].add(r["id"])
    assert sum({i, i + 100, i + 200} in got.values() for i in range(40)) >= 39


def test_lines_of_one_template(spark):
    """Lines of a template with some words replaced: many share a bucket without being similar, and similar ones aren't to be lost there."""
    rnd = np.random.default_rng(8)
    words = [random_words(rnd, 1) for _ in range(400)]
    base = [words[k] for k in rnd.integers(0, 400, 60)]
    rows = []
    for i in range(400):
        own = list(base)
        for k in rnd.integers(0, 60, int(rnd.integers(1, 5))):
            own[k] = words[rnd.integers(0, 400)]
        rows.append((i, " ".join(own)))
    sets = [{t[j : j + line_dedup.SHINGLE] for j in range(len(t) - line_dedup.SHINGLE + 1)} for _, t in rows]
    want = [(a, b) for a in range(400) for b in range(a) if len(sets[a] & sets[b]) >= line_dedup.LEAST * len(sets[a] | sets[b])]
    of = {r["id"]: r["component"] for r in line_dedup.line_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = sum(a in of and of[a] == of.get(b) for a, b in want)
    assert len(want) > 100 and held >= 0.98 * len(want)


def test_large_buckets_are_split(spark, monkeypatch):
    """Groups in one bucket of which none is small: hubs and splits find what pairs would."""
    monkeypatch.setattr(line_dedup, "SMALL", 4)
    rnd = np.random.default_rng(9)
    base = random_words(rnd, 60)[:300]
    rows = [(100 * g + i, f"{base[:150]} {own} {base[150:]} {i}") for g in range(12) for own in [random_words(rnd, 12)[:70]] for i in range(8)]
    got = defaultdict(set)
    for r in line_dedup.line_components(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["component"]].add(r["id"])
    want = {frozenset(i for i, _ in g) for g in brute_lines(rows)}
    assert len(set(map(frozenset, got.values())) ^ want) <= 0.02 * len(want)


@pytest.mark.parametrize("small", [4, 1024])
def test_pairs_of_a_crowded_bucket_are_all_compared(spark, monkeypatch, small):
    """Similar pairs that meet in one large bucket only, each with a dozen differing bins and similar to no common line."""
    monkeypatch.setattr(line_dedup, "SMALL", small)
    rnd, rows = np.random.default_rng(12), []
    for i in range(150):
        lo, hi = (int(x) for x in rnd.integers(0, 1 << line_dedup.BINS, 2))
        other = sum(1 << int(b) for b in rnd.choice(line_dedup.BINS, 12, replace=False))
        rows += [(2 * i, [7], lo, hi), (2 * i + 1, [7], lo ^ other, hi)]
    distinct = spark.createDataFrame(rows, "lid long, keys array<long>, lo long, hi long")
    of = line_dedup.linked(line_dedup.buckets(distinct), lambda pairs: pairs.filter("u = v + 1 AND v % 2 = 0"))
    assert {r["node"]: r["component"] for r in of.collect()} == {i: i // 2 * 2 for i in range(300)}


def test_blocks_of_a_bucket_hold_groups_and_pairs(spark, monkeypatch):
    """A group that is larger than a block, with lines outside it of which each is similar to one of the group only."""
    monkeypatch.setattr(line_dedup, "SMALL", 8)
    distinct = spark.createDataFrame([(i, [7], 0, 0) for i in range(60)], "lid long, keys array<long>, lo long, hi long")
    asked = []

    def similar(pairs):
        asked.append(pairs)
        return pairs.filter("u < 40 OR (u >= 50 AND u - v = 45)")  # 0 to 39 are a group, 50 to 59 join 5 to 14, 40 to 49 are alone

    of = {r["node"]: r["component"] for r in line_dedup.linked(line_dedup.buckets(distinct), similar).collect()}
    assert of == {i: 0 for i in range(60) if i < 40 or i >= 50}
    met = {frozenset((r["u"], r["v"])) for pairs in asked for r in pairs.collect()}
    assert all(frozenset((i, j)) in met for i in range(40, 50) for j in range(60) if i != j)


def test_pairs_with_sketches_far_apart_are_compared(spark):
    """Similar pairs whose sketches differ in 20 of 30 bins: no sketch turns a pair away that nothing else has compared."""
    rnd, rows = np.random.default_rng(13), []
    for i in range(40):
        lo, hi = (int(x) for x in rnd.integers(0, 1 << line_dedup.BINS, 2))
        other = sum(1 << int(b) for b in rnd.choice(line_dedup.BINS, 20, replace=False))
        rows += [(2 * i, [7], lo, hi), (2 * i + 1, [7], lo ^ other, hi)]
    distinct = spark.createDataFrame(rows, "lid long, keys array<long>, lo long, hi long")
    of = line_dedup.linked(line_dedup.buckets(distinct), lambda pairs: pairs.filter("u = v + 1 AND v % 2 = 0"))
    assert {r["node"]: r["component"] for r in of.collect()} == {i: i // 2 * 2 for i in range(80)}


def test_bound_keeps_similar_sets_and_few_others(spark):
    rnd, sets = np.random.default_rng(14), []
    for size in (1, 4, 5, 9, 45, 300, 900, 3000):
        base = rnd.integers(0, 1 << 62, size)
        for kept in (1.0, 0.9, 0.89, 0.8, 0.6):
            n = int(np.ceil(kept * size))
            sets += [base[:n], np.concatenate((base[:n], rnd.integers(0, 1 << 62, size - n)))]
    rows = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in enumerate(sets)], "lid long, hashes array<long>")
    held = line_dedup.parities(rows)
    for r in held.collect():
        assert r["size"] == len(sets[r["lid"]]) and [r[f"p{k}"] for k in range(line_dedup.PARITY)] == simhash.parity(sets[r["lid"]].astype(np.uint64)).tolist()
    got = {(r["u"], r["v"]) for r in line_dedup._met(held.selectExpr("*", "lid AS c", "1 AS key"), ["key"], 0.8).collect()}
    alike = {(i, j): len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])}
    assert {x for x, j in alike.items() if j >= 0.8} <= got
    assert not [x for x in got if alike[x] < 0.5 and max(len(sets[k]) for k in x) < 1000]


def test_lines_that_are_near_are_seldom_compared_exactly(spark, monkeypatch):
    """Lines of one template that share buckets and aren't similar: their parities tell, not their texts."""
    rnd, rows, asked = np.random.default_rng(15), [], []
    base = random_words(rnd, 80)[:400]
    rows = [(i, f"{base[:200]} {random_words(rnd, 20)[:90].ljust(90, 'q')} {base[200:]}") for i in range(200)]
    exact = line_dedup._similar
    monkeypatch.setattr(line_dedup, "_similar", lambda pairs, *more: asked.append(pairs) or exact(pairs, *more))
    assert line_dedup.line_components(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []
    assert sum(p.count() for p in asked) < 1000  # of 19,900


def test_pairs_of_a_crowd_are_few_and_made_once(spark, monkeypatch):
    """Near copies of one line: its most central copies take most of them, and a pair in several buckets is made in one of them."""
    rnd, made = np.random.default_rng(21), []
    words = [random_words(rnd, 1) for _ in range(400)]
    base = [words[k] for k in rnd.integers(0, 400, 60)]
    rows = []
    for i in range(300):
        own = list(base)
        for k in rnd.integers(0, 60, int(rnd.integers(1, 9))):
            own[k] = words[rnd.integers(0, 400)]
        rows.append((i, " ".join(own)))
    met = line_dedup._met
    monkeypatch.setattr(line_dedup, "_met", lambda *given: made.append(met(*given)) or made[-1])
    got = {frozenset((r["id"], r["component"])) for r in line_dedup.line_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [p for frame in made for p in frame.collect()]
    assert got and len(pairs) == len(set(pairs)) and len(pairs) < 3000  # of 44,850


def test_a_line_of_many_lines_loses_some(spark):
    lines = [f"line {i} " + hashlib.md5(str(i).encode()).hexdigest() for i in range(20_000)]
    frame = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(reversed(lines)) + "\nanother one that stays")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(frame).collect()}
    assert got == {1: ("\n".join(lines), 0), 2: ("another one that stays", 20_000)}


def test_lines_edges(edge, empty):
    rows = line_dedup.dedup_lines(edge)
    assert set(rows.columns) == {*edge.columns, "n_lines", "n_dropped"}
    got = sorted((str(r["doc_id"]), r["text"] or "", r["n_lines"], r["n_dropped"]) for r in rows.collect() if r["doc_id"] not in (5, 6))
    assert ("1", "", 0, 0) in got and ("2", "", 1, 0) in got and ("3", " \t\n", 2, 0) in got and ("7", "a\n\nb", 3, 0) in got
    assert sum(g[3] for g in got) == 2 and ("None", "", 1, 1) in got  # of three equal lines one stays
    assert line_dedup.dedup_lines(empty).collect() == []


# substrings


def test_gear_is_a_rolling_hash():
    text, h, want = bytes(range(256)) * 2, 0, []
    for b in text:
        h = ((h << 1) + int(substring_dedup._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert substring_dedup.gear(text).tolist() == want


def test_cuts_follow_the_content():
    rnd = np.random.default_rng(3)
    text = bytes(rnd.integers(97, 123, 20_000, dtype=np.uint8))
    a, b = ({text[s:e] for s, e in zip([0, *c], c)} for c, text in ((substring_dedup.cuts(t), t) for t in (text, b"inserted" + text)))
    assert len(a & b) > 0.98 * len(a)
    ends = substring_dedup.cuts(text)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes.max() <= substring_dedup.LONGEST and sizes[:-1].min() >= substring_dedup.SHORTEST
    assert substring_dedup.cuts(b"") == []


def random_words(rnd, n):
    return " ".join("".join(chr(97 + c) for c in rnd.integers(0, 26, rnd.integers(2, 9))) for _ in range(n))


def test_planted_passages(spark):
    rnd = np.random.default_rng(8)
    passage = random_words(rnd, 60)
    rows = [(i, random_words(rnd, 200)) for i in range(30)]
    for i in (3, 11, 25):
        rows[i] = (i, rows[i][1] + f" é{i} " + passage + " " + random_words(rnd, 40))
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    spans = {r["doc_id"]: r["spans"] for r in found.collect()}
    assert {i for i, s in spans.items() if s} == {3, 11, 25}
    for i in (3, 11, 25):
        assert all(rows[i][1][s["start"] : s["end"]] in passage for s in spans[i]) and {s["dropped"] for s in spans[i]} == {i != 3}
    left = {r["doc_id"]: r["text"] for r in substring_dedup.drop_passages(found).collect()}
    assert left[3] == rows[3][1] and left[0] == rows[0][1]
    assert len(left[11]) == len(rows[11][1]) - sum(s["end"] - s["start"] for s in spans[11]) and left[11].startswith(rows[11][1][:100])


def test_substring_edges(edge, empty, spark):
    rows = substring_dedup.repeated_passages(edge).collect()
    assert len(rows) == 11 and not any(r["spans"] for r in rows)  # short texts, and repeats inside one text
    assert substring_dedup.repeated_passages(empty).collect() == []
    twice = spark.createDataFrame([(None, "abcdefg " * 200), (2, "abcdefg " * 200)], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in substring_dedup.repeated_passages(twice).collect()}
    assert not any(s["dropped"] for s in spans[2]) and all(s["dropped"] for s in spans[None]) and spans[None]


def test_substring_query(spark):
    assert QUERIES["op6_substring_dedup"](spark, DATA).filter(F.col("n_spans") < 1).count() == 0
