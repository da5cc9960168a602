"""SimHash near-dedup with vantage-point trees over Hamming distance.

Distinct fingerprints are dealt to shards by a top tree grown from a bounded
sample; a fingerprint whose ball crosses a shard's border also visits the shards
beyond it, so pairs across borders are found exactly. Each shard grows its own
tree, prunes by the triangle inequality and keeps a spanning forest of its pairs;
the forests meet in distributed connected components.

Fingerprints of few differing bits miss most near copies of a Jaccard similarity
of 0.8, and at the radius those need (some 17 of 64 bits) a tree prunes nothing.
Where rows are dropped, the pairs that the trees find are therefore joined by those
that share a MinHash band, and all are checked by the exact similarity of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.arrowtext import column, release, signed, steps, utf8
from shelfmark.llm.components import components
from shelfmark.llm.line_dedup import BANDS, BINS, PARITY, ROWS, TURNS, buckets, linked
from shelfmark.llm.storage import fits, stage, with_places

SEED = 42
#: Words in a shingle and differing bits of a link, as the digest query has them.
SHINGLE, RADIUS = 3, 2
#: Fingerprints that the top tree is grown from, points of a leaf, and those of a shard.
SAMPLE, LEAF, SHARD = 4096, 48, 65536
#: Pairs of a row that meet its text in one task, about.
HUB = 1000
#: What line dedup's bound on the similarity of two sets needs.
_SETS = ["size", *(f"p{k}" for k in range(PARITY))]


def _hashes(text: bytes | None, size: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    found = text.lower().split() if text else []  # bytes: A-Z only, and blanks are space and tab to carriage return
    if not found:
        return np.zeros(0, dtype="<u8")
    shingles = map(b" ".join, zip(*(found[i:] for i in range(size)))) if len(found) >= size else [b" ".join(found)]
    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """64 bits, each set if it is in over half of the shingles' hashes; 0 without words."""
    return _majority(_hashes(text, size))


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            marks = np.array([fingerprint(t, size) for t in utf8(column(batch, "text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(marks.view(np.int64))], names=["id", "fp"])

    return run


def add_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp) for each row; null, empty and blank texts have fingerprint 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(size), "id long, fp long")


class VantageTree:
    """A vantage-point tree over distinct 64-bit points.

    A node splits its points by their distance to one of them: up to ``mu``
    within, the rest without. A query ball of radius r at distance d from the
    vantage point enters the inner side if d - r <= mu and the outer if d + r > mu.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF, radius: int = RADIUS):
        self.points, self.leaf, self.radius = points, leaf, radius
        self.nodes: list[tuple] = []  # (vantage, mu, inner, outer) or (None, indices)
        self.leaves = 0
        self.root = self._grow(np.arange(len(points)))

    def _grow(self, at: np.ndarray) -> int:
        here = len(self.nodes)
        self.nodes.append(())
        split = self._split(self.points[at]) if len(at) > self.leaf else None
        if split is None:
            self.nodes[here] = (None, at, self.leaves)
            self.leaves += 1
            return here
        vantage, mu = split
        within = np.bitwise_count(self.points[at] ^ vantage) <= mu
        self.nodes[here] = (vantage, mu, self._grow(at[within]), self._grow(at[~within]))
        return here

    def _split(self, own: np.ndarray) -> tuple[np.uint64, int] | None:
        """Of a few vantage points and thresholds, those with the fewest border points among well balanced ones."""
        best, at = None, None
        some = own[:: max(1, len(own) // 2048)]
        for vantage in own[[0, len(own) // 3, 2 * len(own) // 3]]:
            held = np.cumsum(np.bincount(np.bitwise_count(some ^ vantage), minlength=70)) / len(some)
            for mu in np.flatnonzero((held >= 0.15) & (held <= 0.85)).tolist():
                border = held[min(69, mu + self.radius)] - (held[mu - self.radius] if mu >= self.radius else 0)
                cost = border + 0.5 * abs(held[mu] - 0.5)
                if best is None or cost < best:
                    best, at = cost, (vantage, mu)
        if at and 0 < np.count_nonzero(np.bitwise_count(own ^ at[0]) <= at[1]) < len(own):
            return at
        return None

    def route(self, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, queries whose ball reaches it, whether each lies in it)."""
        held = [(self.root, np.arange(len(queries)), np.ones(len(queries), dtype=bool))]
        while held:
            node, at, home = held.pop()
            if self.nodes[node][0] is None:
                yield self.nodes[node][2], at, home
                continue
            vantage, mu, inner, outer = self.nodes[node]
            far = np.bitwise_count(queries[at] ^ vantage).astype(np.int16)
            for child, side, own in ((inner, far - self.radius <= mu, far <= mu), (outer, far + self.radius > mu, far > mu)):
                if side.any():
                    held.append((child, at[side], home[side] & own[side]))

    def pairs(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, point numbers) of all pairs within the radius, a leaf at a time."""
        members = {x[2]: x[1] for x in self.nodes if x[0] is None}
        for leaf, at, _ in self.route(queries):
            own = members[leaf]
            for a in range(0, len(at), 16384):
                for b in range(0, len(own), 256):
                    q, p = np.nonzero(np.bitwise_count(queries[at[a : a + 16384], None] ^ self.points[None, own[b : b + 256]]) <= self.radius)
                    if len(q):
                        yield at[a : a + 16384][q], own[b : b + 256][p]


def _forest(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Union-find over arrays; roots are the least numbers."""
    for a, b in zip(left.tolist(), right.tolist()):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)


def shard_edges(points: np.ndarray, visitors: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within the radius among points, and between visitors and points."""
    own = np.concatenate((points, visitors))
    parent = np.arange(len(own)).tolist()
    if len(points):
        for q, p in VantageTree(points, leaf, radius).pairs(own):
            keep = q > p  # pairs of points come twice
            _forest(parent, q[keep], p[keep])
    linked = [i for i in range(len(own)) if parent[i] != i]
    return own[linked], own[[parent[i] for i in linked]]


def _dealer(tree: VantageTree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = column(batch, "fp").to_numpy(zero_copy_only=False).view(np.uint64)
            homes = np.zeros(len(marks), dtype=np.int32)
            routes = list(tree.route(marks))
            for leaf, at, home in routes:
                homes[at[home]] = leaf
            for leaf, at, home in routes:
                sent = at[home | (homes[at] < leaf)]  # of a pair across a border, the one from the lower shard visits
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sent), leaf, np.int32)), pa.array(marks[sent].view(np.int64)), pa.array(homes[sent] == leaf)], names=["shard", "fp", "home"])

    return run


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(column(b, "shard").to_numpy(), column(b, "fp").to_numpy().view(np.uint64), column(b, "home").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not parts:
            return
        shards, marks, homes = (np.concatenate(x) for x in zip(*parts))
        for shard in np.unique(shards):
            here = shards == shard
            u, v = shard_edges(marks[here & homes], marks[here & ~homes], radius)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return run


def fingerprint_edges(marks: DataFrame, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Distinct ``fp`` to (u, v): a spanning forest of the links of each shard at ``radius`` or fewer differing bits."""
    total = marks.count()
    some = [r[0] for r in marks.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(min(sample, total // 8)).collect()]  # a bounded sample
    points = np.array(some, dtype=np.int64).view(np.uint64)
    tree = VantageTree(points, max(8, len(points) * shard // max(1, total)), radius)
    dealt = marks.select("fp").mapInArrow(_dealer(tree), "shard int, fp long, home boolean")
    return dealt.repartitionById(max(1, tree.leaves), F.col("shard")).mapInArrow(_search(radius), "u long, v long")


def link_fingerprints(marks: DataFrame, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Distinct ``fp`` to (node, component) of the links at ``radius`` or fewer differing bits; lone ones are left out."""
    return components(fingerprint_edges(marks, radius, shard, sample), "simhash")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``docs``: id, fp (long), component_id.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the
    smallest id reachable over links, a row's own included. Texts of fewer than
    ``size`` words are one shingle; texts without words have fingerprint 0,
    linked like any other. Null ids are rows but name no component unless no
    other row is there (null). Repeated rows stay. An empty table gives no rows.
    Further columns are ignored.
    """
    rows = stage(add_fingerprints(docs, id_col, text_col, size), "simhash")
    marks = stage(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-marks")
    linked = marks.join(link_fingerprints(marks, radius, shard, sample), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    linked = stage(linked, "simhash-linked")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def signature(hashes: np.ndarray) -> tuple[list[int | None], int, int]:
    """Band keys and the two words of the sketch of a set of sorted shingle hashes, as line dedup has them."""
    at = (hashes & np.uint64(0xFFFF)) % np.uint64(BINS)
    bins, first = np.unique(at, return_index=True)  # of sorted hashes the first one of a bin is its least
    own = dict(zip(bins.tolist(), (hashes[first] >> np.uint64(33)).tolist()))
    full = [next((own[k] for k in (j, *((j * t + 1) % BINS for t in TURNS)) if k in own), -1) for j in range(BINS)]
    parts = [full[k * ROWS : (k + 1) * ROWS] for k in range(BANDS)]
    keys = [None if max(p) < 0 else xxhash.xxh64_intdigest(np.array([k, *p], dtype="<i8").tobytes(), SEED) for k, p in enumerate(parts)]
    return keys, sum((m & 1) << j for j, m in enumerate(full)), sum((m >> 1 & 1) << j for j, m in enumerate(full))


def parity(hashes: np.ndarray) -> np.ndarray:
    """The words of the parities of distinct hashes, as line dedup has them."""
    odd = np.bincount((hashes & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _signer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            marks, ends, keys, sketches, sizes, odd = [], [], [], [], [], []
            for text in utf8(column(batch, "text")):
                hashes = _hashes(text, size)
                own = np.unique(hashes)
                marks.append(_majority(hashes))
                ends.append(np.frombuffer(xxhash.xxh3_128_digest(own.tobytes(), SEED), dtype="<i8"))
                k, lo, hi = signature(own)
                keys.append([None if x is None else x - (x >> 63 << 64) for x in k])
                sketches.append((lo, hi))
                sizes.append(len(own))
                odd.append(parity(own))
            h, g = np.stack(ends).T
            lo, hi = np.array(sketches, dtype=np.int64).T
            fields = [column(batch, n) for n in ("_file", "_row", "id")]
            made = [pa.array(h.copy()), pa.array(g.copy()), pa.array(signed(marks)), pa.array(keys, pa.list_(pa.int64())), pa.array(lo.copy()), pa.array(hi.copy())]
            made += [pa.array(sizes, pa.int64()), *(pa.array(p.copy()) for p in np.stack(odd).T)]
            yield pa.RecordBatch.from_arrays(fields + made, names=["_file", "_row", "id", "h", "g", "fp", "keys", "lo", "hi", *_SETS])
        release()

    return run


def _checker(size: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # rows come in the order of the last join, so a hub is hashed once in a row
        for batch in steps(batches, "b"):
            keep = []
            for v, a, b in zip(column(batch, "v").to_pylist(), utf8(column(batch, "a")), utf8(column(batch, "b"))):
                if v != last:
                    last, held = v, np.unique(_hashes(b, size))
                own = np.unique(_hashes(a, size))
                both = len(np.intersect1d(own, held, assume_unique=True))
                keep.append(both >= least * (len(own) + len(held) - both))
            yield pa.RecordBatch.from_arrays([column(batch, "u"), column(batch, "v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))
        release()

    return run


def _with_text(pairs: DataFrame, end: str, other: str, texts: DataFrame, name: str) -> DataFrame:
    """``pairs`` with the text of one end; an end of many pairs is dealt to several tasks, its text to each."""
    many = fits(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HUB).select(end, F.expr(f"n div {HUB}").alias("parts")))
    dealt = pairs.join(many, end, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(other), F.col("parts") + 1), F.lit(0))).drop("parts")
    copies = texts.withColumnsRenamed({"lid": end, "text": name}).join(many, end, "left")
    copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(0)).cast("long")))).drop("parts")
    return dealt.join(copies, [end, "part"]).drop("part")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, radius: int = 3, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near copies, all columns unchanged.

    Two rows are near copies if the Jaccard similarity of their sets of shingles of
    ``size`` words is ``least`` or more; groups are what is reachable. Candidates
    are fingerprints at ``radius`` or fewer differing bits, found by the trees, and
    rows that share a MinHash band: a pair at 0.8 does with probability 0.999.
    Texts of fewer words are one shingle; null, empty and blank texts are copies of
    each other. Of a group the row with the smallest id stays (null last; of
    repeated rows the first by place). An empty table gives no rows.
    """
    placed = with_places(docs, "near-docs")
    names = placed.columns[:-2]
    rows = placed.select("_file", "_row", F.col(names[docs.columns.index(id_col)]).cast("long").alias("id"), F.col(names[docs.columns.index(text_col)]).cast("string").alias("text"))
    signs = "_file long, _row long, id long, h long, g long, fp long, keys array<long>, lo long, hi long, " + ", ".join(f"{x} long" for x in _SETS)
    marks = stage(rows.mapInArrow(_signer(size), signs), "near-marks")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_file", "_row")).alias("best")
    distinct = marks.groupBy("h", "g").agg(best, *[F.first(c).alias(c) for c in ("fp", "keys", "lo", "hi", *_SETS)])
    distinct = stage(distinct.select(F.monotonically_increasing_id().alias("lid"), "best", "fp", "keys", "lo", "hi", *_SETS), "near-distinct")

    own = stage(distinct.groupBy("fp").agg(F.min("lid").alias("first")), "near-fingerprints")
    edges = fingerprint_edges(own, radius)
    edges = edges.join(own.toDF("u", "a"), "u").join(own.toDF("v", "b"), "v").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    equal = distinct.select("fp", "lid").join(own, "fp").filter("lid > first").select(F.col("lid").alias("u"), F.col("first").alias("v"))

    def similar(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("u", "v")).alias("lid")).distinct()
        wanted = stage(distinct.select("lid", "best._file", "best._row").join(ends, "lid"), "near-ends")
        texts = stage(rows.select("_file", "_row", "text").join(fits(wanted), ["_file", "_row"]).select("lid", "text"), "near-texts")
        both = _with_text(_with_text(pairs, "u", "v", texts, "a"), "v", "u", texts, "b")
        return both.select("u", "v", "a", "b").mapInArrow(_checker(size, least), "u long, v long")

    def sets(lids: DataFrame) -> DataFrame:
        return distinct.select("lid", *_SETS).join(fits(lids), "lid")

    named = linked(buckets(distinct.select("lid", "keys", "lo", "hi")), similar, edges.unionByName(equal), sets=sets, least=least)
    of = distinct.select("lid", "best").join(named, F.col("lid") == F.col("node"), "left").select(F.coalesce("component", "lid").alias("component"), "best")
    kept = of.groupBy("component").agg(F.min("best").alias("best")).select("best._file", "best._row")
    gone = stage(marks.select("_file", "_row").join(kept, ["_file", "_row"], "left_anti"), "near-gone")
    return placed.join(fits(gone), ["_file", "_row"], "left_anti").select(*names).toDF(*docs.columns)
