"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

The automaton's letters are the numbers of the items' words, so a window of ten
words is ten states, not one for each byte. Each text is normalised to its words,
scanned once by their numbers, and every match is mapped back to word numbers and
to offsets in the original.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.arrowtext import column, release, steps, utf8

#: Consecutive words in a window; an item of fewer words is one window.
WINDOW = 10
#: Bytes of item text in one automaton, which takes about 90 times as much memory in each worker; larger benchmarks are split over several.
AUTOMATON_BYTES = 4 << 20

#: Lower-cases A-Z and blanks every other ASCII byte but digits and a-z; bytes of other characters stay.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def windows(text: bytes | None, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The windows of an item as their words."""
    found = words(text)
    return [tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))] if found else []


class Machine:
    """The automaton of items; its values are (number of words, ids of the items that have the window)."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], size: int = WINDOW):
        holders: dict[tuple[int, ...], set] = {}
        self.numbers: dict[bytes, int] = {}  # of words, from 1; 0 is any other word
        for item, text in items:
            for window in windows(text, size):
                holders.setdefault(tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window), set()).add(item)
        self.built = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, ids in holders.items():
            self.built.add_word(window, (len(window), frozenset(ids)))
        self.empty = not holders
        if holders:
            self.built.make_automaton()

    def matches(self, found: list[bytes]) -> list[tuple[int, tuple[int, frozenset]]]:
        """(last word, value) of each window that occurs in a sequence of words."""
        if self.empty:
            return []
        number = self.numbers.get
        return list(self.built.iter(tuple([number(w, 0) for w in found])))


def scan(text: bytes, split: list[bytes], machine: Machine) -> tuple[int, set, list[tuple[int, int]]]:
    """Hit words, item ids, and (start, end) of each hit stretch in code points of the original, whose words are ``split``."""
    found = machine.matches(split)
    if not found:
        return 0, set(), []
    hit = np.zeros(len(split) + 1, dtype=np.int64)
    ids: set = set()
    for last, (size, holders) in found:
        hit[last - size + 1] += 1
        hit[last + 1] -= 1
        ids |= holders
    inside = np.cumsum(hit[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    places = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
    chars = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    spans = [(int(chars[places[a][0]]) - 1, int(chars[places[b - 1][1] - 1])) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
    return int(inside.sum()), ids, spans


def _shards(items: DataFrame, bound: int) -> list:
    """Broadcast lists of (item id, text), each of at most about ``bound`` bytes."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // bound + 1
    sc = items.sparkSession.sparkContext
    parts = [items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items for k in range(n)]
    return [sc.broadcast([(r["id"], r["text"].encode()) for r in part.collect()]) for part in parts]


def _finder(held: list, size: int):
    """A function from texts to (words, hit words, item ids, stretches) of each."""
    built: dict = {}

    def machine(k: int) -> Machine:
        if k not in built:
            built.clear()  # one at a time
            built[k] = Machine(held[k].value, size)
        return built[k]

    def find(texts: list[bytes]) -> list[tuple[int, int, set, list]]:
        split = [words(t) for t in texts]
        if len(held) == 1:
            found = [scan(t, w, machine(0)) for t, w in zip(texts, split)]
        else:
            ids: list[set] = [set() for _ in texts]
            merged: list[list] = [[] for _ in texts]
            for k in range(len(held)):
                for i, (t, w) in enumerate(zip(texts, split)):
                    _, some, spans = scan(t, w, machine(k))
                    ids[i] |= some
                    merged[i] += spans
            found = [_merge(t, some, spans) for t, some, spans in zip(texts, ids, merged)]
        return [(len(w), *f) for w, f in zip(split, found)]

    return find


def _scanner(held: list, size: int):
    find = _finder(held, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            found = find([t or b"" for t in utf8(column(batch, "text"))])
            columns = [
                pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                pa.array([sorted(x for x in f[2] if x is not None) for f in found], pa.list_(pa.string())),
                pa.array([[{"start": a, "end": b} for a, b in f[3]] for f in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), *columns], names=["id", "n_words", "n_hit", "items", "spans"])
        release()

    return run


def _keeper(held: list, size: int, text: str):
    find = _finder(held, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            yield batch.filter(pa.array([not f[1] for f in find([t or b"" for t in utf8(column(batch, text).cast(pa.string()))])]))
        release()

    return run


def _merge(text: bytes, ids: set, spans: list[tuple[int, int]]) -> tuple[int, set, list[tuple[int, int]]]:
    """Hit words and joined stretches from those of several automata."""
    if not spans:
        return 0, ids, []
    chars = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    places = [(int(chars[a]) - 1, int(chars[b - 1])) for a, b in (m.span() for m in _WORD.finditer(text.translate(_TABLE)))]
    starts = np.array([p[0] for p in places])
    inside = np.zeros(len(places), dtype=bool)
    for a, b in spans:
        inside[np.searchsorted(starts, a) : np.searchsorted(starts, b)] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    return int(inside.sum()), ids, [(places[a][0], places[b - 1][1]) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def _item_shards(benchmark: DataFrame, item_col: str, item_text_cols: tuple[str, ...], bound: int) -> list:
    parts = [benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(c).cast("string").alias("text")) for c in item_text_cols]
    items = parts[0]
    for part in parts[1:]:
        items = items.unionByName(part)
    return _shards(items.filter(F.col("text").isNotNull()), bound)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_cols: tuple[str, ...] = ("text",), window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_hit, items, spans, contaminated.

    A word is hit when it lies in an occurrence of a window of an item: ``window``
    consecutive words, or all of a shorter item. Each of ``item_text_cols``
    (questions, answers) has windows of its own. ``items`` are the ids with
    occurring windows as sorted distinct strings; an item with a null id marks
    words but has no id to list. ``spans`` are hit stretches in code points of
    the original. Null and empty texts have no words; items without words have
    no window; an empty benchmark hits nothing. Repeated rows are kept. A
    benchmark beyond ``automaton_bytes`` is scanned for by several automata in
    turn, with the same results. Further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    held = _item_shards(benchmark, item_col, item_text_cols, automaton_bytes)
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_scanner(held, window), f"id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>")
    return found.withColumnRenamed("id", id_col).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_cols: tuple[str, ...] = ("text",),
    window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """The rows of ``docs`` without a hit word, all columns unchanged.

    Null and empty texts stay, and all where the benchmark has no words. Repeated
    rows are judged alike; an empty table gives no rows.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    held = _item_shards(benchmark, item_col, item_text_cols, automaton_bytes)
    return rows.mapInArrow(_keeper(held, window, names[docs.columns.index(text_col)]), schema).toDF(*docs.columns)
