"""Token-ID files: documents' ids, each with an end id, in ascending order of id, entropy-coded.

A shard is one file, written by one task under another name and renamed:

    8 bytes   b"SHELFTOK"
    4 x u32   version, bits of an id, number of blocks, number of documents
    blocks    u32 ids, u32 bytes, u32 CRC-32 of the ids as little-endian u32, then the bytes
    documents i64 id (0 where null), u8 null, u32 ids with the end id
    u32       CRC-32 of all before

Blocks are coded independently of each other, see ``blockcoder``. Integers are
little-endian.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.arrowtext import column, release
from shelfmark.llm.blockcoder import BLOCK, LANES, checksum, decode_blocks, encode_blocks
from shelfmark.llm.bpe import codec, default_tokenizer, encoded_steps
from shelfmark.llm.sharedarrays import read_bytes, write_bytes

MAGIC, VERSION = b"SHELFTOK", 2
#: Bytes of text in a shard, and the id after each document.
SHARD_BYTES, END_ID = 24 << 20, 2


class ShardWriter:
    def __init__(self, bits: int):
        self.bits, self.coded = bits, io.BytesIO()
        self.count, self.ids, self.sizes = 0, [], []
        self.held: list[np.ndarray] = []
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.extend([doc_id], ids, np.array([len(ids)]))

    def extend(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents in order: their names, the ids of all of them, and how many each has."""
        self.ids += doc_ids
        self.sizes.append(sizes)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= LANES * BLOCK:
            self._code(False)

    def _code(self, last: bool) -> None:
        whole = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        self.held.clear()
        end = len(whole) if last else len(whole) // BLOCK * BLOCK
        blocks = [whole[a : min(end, a + BLOCK)] for a in range(0, end, BLOCK)]
        for ids, coded in zip(blocks, encode_blocks(blocks, self.bits)):
            self.coded.write(struct.pack("<III", len(ids), len(coded), checksum(ids)))
            self.coded.write(coded)
        self.count += len(blocks)
        self.held, self.waiting = [whole[end:].copy()], len(whole) - end

    def finish(self) -> bytes:
        self._code(True)
        out = MAGIC + struct.pack("<IIII", VERSION, self.bits, self.count, len(self.ids)) + self.coded.getvalue()
        out += np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.array([i is None for i in self.ids], "u1").tobytes() + b"".join(n.astype("<u4").tobytes() for n in self.sizes)
        return out + struct.pack("<I", zlib.crc32(out))


def read_shard(held: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, ids with the end id) of a shard in order; a wrong checksum is a ValueError."""
    if held[:8] != MAGIC or len(held) < 28:
        raise ValueError("not a token shard")
    if struct.unpack("<I", held[-4:])[0] != zlib.crc32(held[:-4]):
        raise ValueError("the shard's checksum is wrong")
    version, bits, blocks, docs = struct.unpack_from("<IIII", held, 8)
    if version != VERSION:
        raise ValueError(f"unknown version {version}")
    at, coded = 24, []
    for _ in range(blocks):
        n, size, crc = struct.unpack_from("<III", held, at)
        coded.append((n, crc, at + 12, size))
        at += 12 + size
    names = np.frombuffer(held, "<i8", docs, at)
    empty = np.frombuffer(held, "u1", docs, at + 8 * docs)
    sizes = np.frombuffer(held, "<u4", docs, at + 9 * docs)
    rest, doc = np.zeros(0, np.uint32), 0
    for first in range(0, len(coded), LANES):
        own = coded[first : first + LANES]
        ids = decode_blocks([(n, held[a : a + size]) for n, _, a, size in own], bits)
        for (_, crc, _, _), x in zip(own, ids):
            if checksum(x) != crc:
                raise ValueError("a block's checksum is wrong")
        rest = np.concatenate((rest, *ids))
        start = 0
        while doc < docs and start + sizes[doc] <= len(rest):
            yield (None if empty[doc] else int(names[doc])), rest[start : start + sizes[doc]]
            start += int(sizes[doc])
            doc += 1
        rest = rest[start:]
    if doc != docs or len(rest):
        raise ValueError("the shard's documents and blocks don't agree")


_SHARDS = "shard int, n_docs long, n_ids long, n_bytes long"


def _writer(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = None
        for batch, ids, ends in encoded_steps(batches, path):
            writer = writer or ShardWriter(max(len(codec(path).sizes), end_id + 1, 2).bit_length())
            writer.extend(column(batch, "id").to_pylist(), np.insert(ids, ends, np.uint32(end_id)), np.diff(ends, prepend=0) + 1)
        if writer:
            shard, held = TaskContext.get().partitionId(), writer.finish()
            write_bytes(folder, f"shard-{shard:06d}.tok", held)
            numbers = (len(writer.ids), int(sum(n.sum() for n in writer.sizes)), len(held))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([n], pa.int64()) for n in numbers)], names=["shard", "n_docs", "n_ids", "n_bytes"])
            del writer, held
            release()

    return run


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> list[tuple[int, int, int, int]]:
    """Write the shards of ``docs`` to ``folder``: (shard, documents, ids, bytes) of each, in order.

    Documents go by ascending id, null ids last, rows of one id by their text;
    null and empty texts are only the end id. An empty table writes no shard.
    Further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("id").asc_nulls_last(), F.col("text")]
    dealt = rows.repartitionByRange(max(1, -(-total // shard_bytes)), F.col("id").asc_nulls_last(), F.xxhash64("text")).sortWithinPartitions(order[0], F.xxhash64("text"), order[1])
    made = dealt.mapInArrow(_writer(folder, tokenizer or default_tokenizer(), end_id), _SHARDS).collect()  # a row for each shard
    return sorted(tuple(r) for r in made)


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(column(batch, "shard").to_pylist(), column(batch, "start").to_pylist()):
                held = list[tuple]()
                for name, ids in read_shard(read_bytes(folder, f"shard-{shard:06d}.tok")):
                    held.append((name, start, len(ids), ids.astype("<u4").tobytes()))
                    start += len(ids)
                    if len(held) == 1000:
                        yield _rows(held)
                        held = []
                yield _rows(held)
                release()

    return run


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names=["id", "start", "n_tokens", "ids"])


def read_tokens(spark, folder: str, shards: list[tuple[int, int, int, int]], id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of each document in the files; ``start`` counts the ids of all documents before it."""
    starts, at = [], 0
    for task, (shard, _, n, _) in enumerate(shards):
        starts.append((task, shard, at))
        at += n
    table = spark.createDataFrame(starts, "task int, shard int, start long").repartitionById(max(1, len(starts)), F.col("task"))  # a shard for each task
    return table.mapInArrow(_reader(folder), "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)
