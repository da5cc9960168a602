"""Exact dedup over an extendible-hash index on shared files.

Map tasks normalise each text, chain equal ones and write one body a distinct
text to a shared table, so thousands of copies leave a task as one. A directory
of key prefixes is doubled until no bucket is overfull; owner tasks each take a
run of buckets, that is a key range, and walk its keys in order, chaining texts
whose keys collide and comparing bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.arrowtext import column, row_numbers, signed, steps, utf8
from shelfmark.llm.storage import stage

#: Deleted before texts are compared.
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of bodies that a bucket holds before it splits, and that a map task chains at a time.
BUCKET_BYTES = 16 << 20
CHAIN_BYTES = 32 << 20
#: The directory has at most 2**MOST_DEPTH entries; only those are sent to the driver.
MOST_DEPTH = 18


class Chains:
    """Texts by 64-bit key; those whose keys collide form a chain that is compared byte by byte."""

    def __init__(self, limit: int):
        self.limit, self.held, self.by_key = limit, 0, {}

    def find(self, key: int, body: bytes, row: int) -> int:
        """The row of the first equal text, or ``row`` itself where there is none yet."""
        chain = self.by_key.setdefault(key, [])
        for other, seen in chain:
            if seen == body:
                return other
        if self.held > self.limit:
            self.by_key, self.held = {}, 0
            chain = self.by_key.setdefault(key, [])
        chain.append((row, body))
        self.held += len(body) + 100
        return row


def _enter(id_col: str, text_col: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, chains = row_numbers(), Chains(CHAIN_BYTES)
        for batch in steps(batches, text_col):
            texts = column(batch, text_col)
            bodies = [(b or b"").translate(None, BLANKS) for b in utf8(texts)]
            rows = [next(numbers) for _ in bodies]
            keys = signed([xxhash.xxh64_intdigest(b) for b in bodies])
            firsts = [chains.find(k, b, r) for k, b, r in zip(keys.tolist(), bodies, rows)]
            chars = pc.fill_null(pc.utf8_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), column(batch, id_col).cast(id_type), chars, pa.array(firsts, pa.int64()), pa.array(keys),
                 pa.array([b if r == f else None for b, r, f in zip(bodies, rows, firsts)], pa.binary())],
                names=["row", "id", "chars", "first", "key", "body"],
            )

    return run


def directory(histogram: list[tuple[int, int]], depth: int, capacity: int) -> list[int]:
    """The bucket of each ``depth``-bit key prefix, by doubling.

    Starts from one bucket; while a bucket is overfull and can still be told
    apart by a further bit it splits in two, and the directory doubles when its
    bucket already uses every bit. Buckets are numbered in key order.
    """
    size = [0] * (1 << depth)
    for prefix, n in histogram:
        size[prefix] += n
    held = [0]
    for n in size:
        held.append(held[-1] + n)
    entries, level = [(0, 0)], 0  # (depth, prefix) of the bucket of each entry
    while level <= depth:
        width = 1 << (depth - level)
        overfull = {b for b in set(entries) if b[0] == level and held[(b[1] + 1) * width] - held[b[1] * width] > capacity}
        if not overfull or level == depth:
            break
        entries = [(level + 1, i) if b in overfull else b for i, b in ((i, entries[i >> 1]) for i in range(2 * len(entries)))]
        level += 1
    numbers: dict[tuple[int, int], int] = {}
    for b in entries:
        numbers.setdefault(b, len(numbers))
    return [numbers[entries[i >> (depth - level)]] for i in range(1 << depth)]


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's rows in key order: each text's class is the first row of the chain that has equal bytes."""
    last, chain = None, []
    for batch in batches:
        rows, classes, digests = column(batch, "row").to_pylist(), [], []
        for row, key, body in zip(rows, column(batch, "key").to_pylist(), column(batch, "body").to_pylist()):
            if key != last:
                last, chain = key, []
            found = next((c for c in chain if c[1] == body), None)
            if found is None:
                chain.append(found := (row, body, hashlib.sha256(body).hexdigest()))
            classes.append(found[0])
            digests.append(found[2])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(classes, pa.int64()), pa.array(digests, pa.string())], names=["first", "class", "sha256"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting blanks (space, tab to carriage
    return); null counts as empty, so null, empty and blank texts form one group.
    The row with the most code points in its original text stays, then the
    smallest id; null ids come last; of rows alike in both one stays. Repeated
    rows are rows of their own. An empty table gives no rows. Further columns
    are ignored, whatever their names.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    entered = stage(ids.mapInArrow(_enter("id", "text", pa.int64()), "row long, id long, chars long, first long, key long, body binary"), "exact-index")
    total = entered.agg(F.sum(F.length("body") + F.lit(100))).first()[0] or 0
    depth = min(MOST_DEPTH, max(0, (total // bucket_bytes).bit_length()) + 3)
    bodies = entered.filter(F.col("body").isNotNull()).select("row", "key", "body")
    prefix = F.shiftrightunsigned("key", 64 - depth).cast("int")
    seen = bodies.groupBy(prefix.alias("p")).agg(F.sum(F.length("body") + F.lit(100)).alias("n")).collect()  # at most 2**MOST_DEPTH rows
    buckets = directory([(r["p"], r["n"]) for r in seen], depth, bucket_bytes)
    table = docs.sparkSession.createDataFrame(list(enumerate(buckets)), "p int, owner int")  # 2**MOST_DEPTH small rows at most
    owned = bodies.withColumn("p", prefix).join(F.broadcast(table), "p").select("row", "key", "body", "owner")
    owned = owned.repartitionById(max(buckets) + 1, F.col("owner")).drop("owner").sortWithinPartitions("key")
    classes = stage(owned.mapInArrow(_own, "first long, class long, sha256 string"), "exact-classes")
    members = entered.select("row", "id", "chars", "first")
    best = F.min(F.struct(-F.col("chars"), F.col("id").isNull().alias("none"), "id", "row"))
    chained = members.groupBy("first").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).join(classes, "first")
    same = Window.partitionBy("class")  # a row for each map task that chained the text, not for each copy
    keeps = chained.select("first", "sha256", F.min("best").over(same).alias("best"), F.sum("n").over(same).alias("group_size"))
    return members.join(keeps, "first").select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha256").alias("text_sha256")
    )
