"""Language-model scoring with a trigram trie in Elias-Fano coded, memory-mapped levels.

Level 1 is the vocabulary, in order of the words' hashes. Level 2 holds the
bigrams as one rising sequence of (first word, second word); a monotone pointer
sequence gives each word its children. In level 3 a word is written relative to
its context: as its place among the successors of the word before it. Each level
is cut into files by key ranges, and every file is built by one task from counts
that were summed before they were dealt. Probabilities are interpolated with
absolute discounting and stored quantised; contexts' weights follow from counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.arrowtext import column, steps, utf8
from shelfmark.llm.eliasfano import EliasFano
from shelfmark.llm.sharedarrays import load, pack, save, sum_by_key, unpack
from shelfmark.llm.storage import new_path

#: Taken off each count of a bigram or trigram and given to what follows the shorter context.
DISCOUNT = 0.75
#: Bytes of text for a file of the vocabulary, tokens for a file of a higher level, text of a step.
VOCABULARY_BYTES, LEVEL_TOKENS, STEP = 64 << 20, 4_000_000, 8 << 20
#: Words, or n-grams, that a task counts before it hands them on; words whose numbers a worker remembers.
HELD_WORDS, HELD_KEYS, REMEMBERED = 300_000, 1_500_000, 300_000
#: Marks of equal counts that a file reports, for cutting the next level.
MARKS = 32
#: Steps of a stored probability for a power of ten.
FINE = 4096
#: The end of a text, which no word is.
END = b"\n"

_U = np.uint64
#: The probability of each stored number.
_CHANCE = 10.0 ** (np.arange(65536) / -float(FINE))


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-case (A-Z) words between blanks, then the end."""
    return [*text.lower().split(), END] if text else [END]


def _hash(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=_U)


def _quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * FINE), 0, 65535).astype(np.uint16)


def _deal(bucket: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket with its keys, summed, as blobs; ``bucket`` rises with the keys of one bucket or not at all."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    rows = []
    for b, part in zip(found.tolist(), np.split(order, first[1:])):
        k, n = sum_by_key(keys[part], counts[part])
        rows.append((b, pack(k, True), pack(n)))
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["bucket", "keys", "counts"])


def _deal_sorted(keys: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """As :func:`_deal` for keys that each count once; a bucket's keys are sent less its lower bound."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    rows = []
    for b, part in _runs(np.searchsorted(bounds, keys, side="right") - 1):
        rows.append((b, pack(keys[part] - bounds[b], True), pack(counts[part])))
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["bucket", "keys", "counts"])


_DEALT = "bucket int, keys binary, counts binary"


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The summed (bucket, keys, counts) that a task was dealt."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for b, k, n in zip(*(column(batch, c).to_pylist() for c in ("bucket", "keys", "counts"))):
            held.setdefault(b, []).append((unpack(k, "u8", True), unpack(n, "i8")))
    for b in sorted(held):
        yield b, *sum_by_key(*(np.concatenate(x) for x in zip(*held.pop(b))))


def _marks(counts: np.ndarray) -> np.ndarray:
    """Places that cut the counts into MARKS about equal sums."""
    total = np.cumsum(counts)
    return np.searchsorted(total, total[-1] * np.arange(MARKS) // MARKS, side="right")


@dataclass
class Trie:
    """What a worker needs to open the files of a model."""

    folder: str
    tokens: int = 0
    words: int = 0
    texts: int = 0
    vocabulary: list[tuple[int, int]] = field(default_factory=list)  # (number of the first word, words) of each file
    level2: list[tuple[int, int, int]] = field(default_factory=list)  # (first key, number of the first bigram, bigrams)
    level3: list[tuple[int, int]] = field(default_factory=list)  # (first bigram, trigrams)
    widest: int = 1  # successors of a word at most, and one

    @property
    def base(self) -> int:
        """Word numbers lie below it: 0 is the start, 1 to ``words`` the words, words + 1 an unknown one."""
        return self.words + 2

    def open(self) -> OpenTrie:
        if self.folder not in _open:
            _open.clear()
            _open[self.folder] = {}
        kept = _open[self.folder]
        stage = (len(self.level2), len(self.level3), self.widest)
        if kept.get("stage") != stage:
            kept["stage"], kept["trie"] = stage, OpenTrie(self)
        return kept["trie"]


_open: dict[str, dict] = {}


class _Local(dict):
    """Words to local numbers in order of their first use, from 1 on; ``new`` are those not looked up yet."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        at = self[word] = len(self) + 1
        return at


class OpenTrie:
    """A trie's files, mapped as they are asked for, and the words seen lately."""

    def __init__(self, trie: Trie):
        self.trie = trie
        self.files: dict[str, object] = {}
        self.starts1 = np.array([a for a, _ in trie.vocabulary] or [1], np.int64)
        self.keys2 = np.array([k for k, _, _ in trie.level2], _U)
        self.starts2 = np.array([a for _, a, _ in trie.level2], np.int64)
        self.starts3 = np.array([a for a, _ in trie.level3], np.int64)
        self.forget()

    def forget(self) -> None:
        """Local numbers: 0 is the start of a text."""
        self.local = _Local()
        self.number = np.zeros(1, np.int64)
        self.count = np.array([self.trie.texts], np.int64)
        self.first, self.degree = self._children(self.number)

    def file(self, name: str):
        if name not in self.files:
            sequence = name.startswith(("keys", "pointers"))
            self.files[name] = EliasFano.open(self.trie.folder, name) if sequence else load(self.trie.folder, name)
        return self.files[name]

    def _children(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first bigram of each word, and how many it has, by level 1's pointers."""
        first, degree = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        if self.trie.widest > 1:
            known = np.flatnonzero(numbers <= self.trie.words)
            for f, part in _groups(np.searchsorted(self.starts1, np.maximum(numbers[known], 1), side="right") - 1):
                at = known[part]
                pointers, start = self.file(f"pointers2-{f}"), self.starts1[f] - (f == 0)  # the first file has the start too
                first[at] = pointers.get(numbers[at] - start).astype(np.int64)
                degree[at] = pointers.get(numbers[at] - start + 1).astype(np.int64) - first[at]
        return first, degree

    def places(self, words: list[bytes]) -> np.ndarray:
        """Local numbers of words; new ones are looked up together."""
        found = np.fromiter(map(self.local.__getitem__, words), np.int64, len(words))
        new = self.local.new
        if new:
            self.local.new = []
            hashes = _hash(new)
            numbers, counts = np.full(len(new), self.trie.words + 1, np.int64), np.zeros(len(new), np.int64)
            files = len(self.trie.vocabulary)
            bounds = np.array([(k << 64) // files for k in range(1, files)], _U)
            order = np.argsort(hashes)
            for f, part in _runs(np.searchsorted(bounds, hashes[order], side="right")):
                start, size = self.trie.vocabulary[f]
                if size:
                    known, at_ = self.file(f"words-{f}"), order[part]
                    at = np.minimum(np.searchsorted(known, hashes[at_]), size - 1)
                    same = known[at] == hashes[at_]
                    numbers[at_[same]] = start + at[same]
                    counts[at_[same]] = self.file(f"counts1-{f}")[at[same]]
            first, degree = self._children(numbers)
            self.number, self.count = np.concatenate((self.number, numbers)), np.concatenate((self.count, counts))
            self.first, self.degree = np.concatenate((self.first, first)), np.concatenate((self.degree, degree))
        return found

    def bigrams(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the bigrams of word numbers, -1 for none, and their stored probabilities."""
        keys, back = _sorted_once(a.astype(_U) * _U(self.trie.base) + b.astype(_U))
        at, p = np.full(len(keys), -1, np.int64), np.zeros(len(keys))
        for f, part in _runs(np.searchsorted(self.keys2, keys, side="right") - 1):
            if f >= 0:
                place, same = self.file(f"keys2-{f}").successor(keys[part] - self.keys2[f])
                hit = part.start + np.flatnonzero(same)
                at[hit] = self.starts2[f] + place[same]
                p[hit] = _CHANCE.take(self.file(f"chances2-{f}")[place[same]])
        return at[back], p[back]

    def trigrams(self, bigram: np.ndarray, relative: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stored probabilities of the trigrams, 0 for none, and the weight that each bigram leaves to shorter contexts."""
        missing = relative < 0
        keys, back = _sorted_once(bigram.astype(_U) * _U(self.trie.widest) + np.where(missing, 0, relative).astype(_U))
        p, weight = np.zeros(len(keys)), np.ones(len(keys))
        lower = self.starts3.astype(_U) * _U(self.trie.widest)
        for f, part in _runs(np.searchsorted(lower, keys, side="right") - 1):
            own = keys[part] - lower[f]
            stored = self.file(f"weights3-{f}")[(own // _U(self.trie.widest)).astype(np.int64)]
            weight[part] = _CHANCE.take(stored)
            some = np.flatnonzero(stored)  # contexts with a successor leave less than all
            place, same = self.file(f"keys3-{f}").successor(own[some])
            p[part.start + some[same]] = _CHANCE.take(self.file(f"chances3-{f}")[place[same]])
        return np.where(missing, 0.0, p[back]), weight[back]

    def walk(self, texts: list[bytes | None]) -> Walk:
        """The texts' tokens one after another, each with its word before; texts don't touch."""
        split = [tokens(t) for t in texts]
        ends = np.cumsum([len(s) for s in split])
        if len(self.local) > REMEMBERED:
            self.forget()
        now = self.places([w for s in split for w in s])
        before = np.concatenate(([0], now[:-1]))
        starts = np.concatenate(([0], ends[:-1]))
        before[starts] = 0
        return Walk(now, before, starts, ends)


@dataclass
class Walk:
    now: np.ndarray
    before: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _sorted_once(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, which lookups take faster, and the place of each key among them."""
    order = np.argsort(keys)
    own = keys[order]
    first = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(first) - 1
    return own[first], back


def _runs(which: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(value, where it stands) of values in rising order."""
    if len(which):
        cuts = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(which)]
        for a, b in zip(cuts, cuts[1:]):
            yield int(which[a]), slice(a, b)


def _groups(which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, places that have it)."""
    if len(which):
        order = np.argsort(which, kind="stable")
        found, first = np.unique(which[order], return_index=True)
        yield from zip(found.tolist(), np.split(order, first[1:]))


def _count_words(files: int):
    bounds = np.array([(k << 64) // files for k in range(1, files)], _U)

    def out(held: Counter) -> pa.RecordBatch:
        keys, counts = _hash(list(held)), np.array(list(held.values()), np.int64)
        return _deal(np.searchsorted(bounds, keys, side="right"), keys, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in steps(batches, "text", STEP):
            for text in utf8(column(batch, "text")):
                held.update(tokens(text))
            if len(held) > HELD_WORDS:
                yield out(held)
                held.clear()
        if held:
            yield out(held)

    return run


def _write_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, keys, counts in _collect(batches):
            save(folder, f"words-{file}", keys)
            save(folder, f"counts1-{file}", counts)
            end = int(counts[keys == _hash([END])[0]].sum())
            yield pa.RecordBatch.from_pylist([{"file": file, "n": len(keys), "total": int(counts.sum()), "texts": end, "marks": _marks(counts).tolist()}], schema=_MARKED)

    return run


_MARKED = pa.schema([("file", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("texts", pa.int64()), ("marks", pa.list_(pa.int64()))])
_MARKED_SQL = "file int, n long, total long, texts long, marks array<long>"


def _count_level(trie: Trie, level: int, bounds: np.ndarray):
    """Bigrams or trigrams of the training texts, dealt by ``bounds``."""

    lower = bounds if level == 2 else bounds.astype(_U) * _U(trie.widest)  # the least key of each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie.open()
        held: list[np.ndarray] = []
        size = 0
        for batch in steps(batches, "text", STEP):
            w = own.walk(utf8(column(batch, "text")))
            a, b = own.number[w.before], own.number[w.now]
            if level == 2:
                keys = a.astype(_U) * _U(trie.base) + b.astype(_U)
            else:
                at, _ = own.bigrams(a, b)
                relative = at - own.first[w.before]
                inner = np.ones(len(at), bool)
                inner[w.starts] = False
                here = np.flatnonzero(inner)
                keys = at[here - 1].astype(_U) * _U(trie.widest) + relative[here].astype(_U)
            held.append(keys)
            size += len(keys)
            if size > HELD_KEYS:
                yield _deal_sorted(np.concatenate(held), lower)
                held, size = [], 0
        if size:
            yield _deal_sorted(np.concatenate(held), lower)

    return run


def _write_level2(trie: Trie, bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, keys, counts in _collect(batches):
            own = trie.open()
            words = ((keys + _U(bounds[file])) // _U(trie.base)).astype(np.int64)  # in order
            change = np.concatenate(([True], words[1:] != words[:-1]))
            firsts, at = words[change], np.cumsum(change) - 1
            totals = np.full(len(firsts), trie.texts, np.int64)
            for f, part in _groups(np.where(firsts > 0, np.searchsorted(own.starts1, np.maximum(firsts, 1), side="right") - 1, -1)):
                if f >= 0:
                    totals[part] = own.file(f"counts1-{f}")[firsts[part] - own.starts1[f]]
            EliasFano.build(keys).save(trie.folder, f"keys2-{file}")
            save(trie.folder, f"chances2-{file}", _quantise((counts - DISCOUNT) / totals[at]))
            yield pa.RecordBatch.from_pylist([{"file": file, "n": len(keys), "total": int(counts.sum()), "texts": 0, "marks": _marks(counts).tolist()}], schema=_MARKED)

    return run


def _write_pointers(trie: Trie):
    """Level 1's pointers: for each word the number of its first bigram, and one more at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in column(batch, "id").to_pylist():
                own = OpenTrie(trie)
                start, size = trie.vocabulary[file]
                numbers = np.arange(start - (file == 0), start + size + 1)
                out = np.zeros(len(numbers), np.int64)
                for at in range(0, len(numbers), 1 << 18):
                    keys = numbers[at : at + (1 << 18)].astype(_U) * _U(trie.base)
                    for f, part in _groups(np.maximum(np.searchsorted(own.keys2, keys, side="right") - 1, 0)):
                        place, _ = own.file(f"keys2-{f}").successor(np.maximum(keys[part], own.keys2[f]) - own.keys2[f])
                        out[at + part] = own.starts2[f] + place
                EliasFano.build(out.astype(_U)).save(trie.folder, f"pointers2-{file}")
                yield pa.RecordBatch.from_pylist([{"file": file, "widest": int(np.diff(out).max(initial=0))}], schema=pa.schema([("file", pa.int32()), ("widest", pa.int64())]))

    return run


def _write_level3(trie: Trie, bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, keys, counts in _collect(batches):
            contexts = (keys // _U(trie.widest)).astype(np.int64)  # a context lies in one file
            n = bounds[file + 1] - bounds[file]
            totals = np.bincount(contexts, weights=counts, minlength=n)
            EliasFano.build(keys).save(trie.folder, f"keys3-{file}")
            degree = np.bincount(contexts, minlength=n)
            save(trie.folder, f"weights3-{file}", _quantise(np.where(degree > 0, DISCOUNT * degree / np.maximum(totals, 1), 1.0)))
            save(trie.folder, f"chances3-{file}", _quantise((counts - DISCOUNT) / totals[contexts]))
            yield pa.RecordBatch.from_pylist([{"file": file, "n": len(keys), "total": int(counts.sum()), "texts": 0, "marks": []}], schema=_MARKED)

    return run


def _bounds(rows: list[tuple[int, int, list[int]]], files: int) -> list[int]:
    """Starts of about ``files`` runs of equal counts from (start, total, marks) of the level before."""
    marks = [(start + m, total / MARKS) for start, total, own in rows for m in own]
    whole, held, out = sum(n for _, n in marks), 0.0, []
    for place, n in sorted(marks):
        if held >= whole * (len(out) + 1) / files and (not out or place > out[-1]):
            out.append(place)
        held += n
    return out


def fit(docs: DataFrame, learn: Column, text_col: str = "text", tokens_per_file: int = LEVEL_TOKENS) -> Trie:
    """The trie of the rows where ``learn`` holds; its files lie in the shared folder.

    All n-grams of all those texts are counted; null and empty texts count as one
    end. Words are told apart by their 64-bit hashes. Without rows every word is
    unknown. The driver only gets sizes and MARKS places of each file.
    """
    spark = docs.sparkSession
    rows = docs.filter(learn).select(F.col(text_col).cast("string").alias("text"))
    trie = Trie(new_path(spark, "ngrams"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // VOCABULARY_BYTES))

    def dealt(run, n: int, write) -> list:
        made = rows.mapInArrow(run, _DEALT).repartitionById(n, F.col("bucket")).mapInArrow(write, _MARKED_SQL)
        return sorted(made.collect(), key=lambda r: r["file"])  # a row for each file

    found = {r["file"]: r for r in dealt(_count_words(files), files, _write_words(trie.folder))}
    for f in range(files):
        r = found.get(f)
        trie.vocabulary.append((1 + trie.words, r["n"] if r else 0))
        trie.words += r["n"] if r else 0
        trie.tokens += r["total"] if r else 0
        trie.texts += r["texts"] if r else 0
    if not trie.words:
        return trie
    if trie.base**2 >= 1 << 64:
        raise OverflowError(f"{trie.words} words don't fit 64-bit bigram keys")
    n = max(1, trie.tokens // tokens_per_file)
    cuts = _bounds([(trie.vocabulary[f][0], r["total"], r["marks"]) for f, r in found.items()], n)
    bounds = [0, *(c * trie.base for c in cuts)]
    made = {r["file"]: r for r in dealt(_count_level(trie, 2, np.array(bounds, _U)), len(bounds), _write_level2(trie, bounds))}
    at = 0
    for f, key in enumerate(bounds):
        if f not in made:  # a key range without bigrams
            EliasFano.build(np.zeros(0, _U)).save(trie.folder, f"keys2-{f}")
            save(trie.folder, f"chances2-{f}", np.zeros(0, np.uint16))
        size = made[f]["n"] if f in made else 0
        trie.level2.append((key, at, size))
        at += size
    starts = [(trie.level2[f][1], r["total"], r["marks"]) for f, r in made.items()]
    pointed = spark.range(files, numPartitions=files).mapInArrow(_write_pointers(trie), "file int, widest long").collect()
    trie.widest = max(r["widest"] for r in pointed) + 1
    if at * trie.widest >= 1 << 64:
        raise OverflowError(f"{at} bigrams with up to {trie.widest} successors don't fit 64-bit trigram keys")
    inner = [0, *_bounds(starts, n)]
    trie.level3 = []
    made3 = {r["file"]: r["n"] for r in dealt(_count_level(trie, 3, np.array(inner, np.int64)), len(inner), _write_level3(trie, [*inner, at]))}
    trie.level3 = [(a, made3.get(f, 0)) for f, a in enumerate(inner)]
    for f, a in enumerate(inner):
        if f not in made3:  # contexts without a successor
            EliasFano.build(np.zeros(0, _U)).save(trie.folder, f"keys3-{f}")
            save(trie.folder, f"weights3-{f}", np.zeros([*inner, at][f + 1] - a, np.uint16))
            save(trie.folder, f"chances3-{f}", np.zeros(0, np.uint16))
    return trie


def _score(trie: Trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie.open()
        for batch in steps(batches, "text", STEP):
            w = own.walk(utf8(column(batch, "text")))
            count = own.count[w.now]
            one = (count + 1) / (trie.tokens + trie.words + 1)
            sums = [np.add.reduceat(x, w.starts) for x in (np.log10(one), (count > 0).astype(np.int64))]
            p = _interpolated(trie, own, w, one) if trie.words else one
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), pa.array(w.ends - w.starts), pa.array(sums[1]), pa.array(sums[0]), pa.array(np.add.reduceat(np.log10(p), w.starts))],
                names=["id", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def _interpolated(trie: Trie, own: OpenTrie, w: Walk, one: np.ndarray) -> np.ndarray:
    """The probability of each token after the two before it."""
    at, p = own.bigrams(own.number[w.before], own.number[w.now])
    total = own.count[w.before]
    two = p + np.where(total > 0, DISCOUNT * own.degree[w.before] / np.maximum(total, 1), 1.0) * one
    inner = np.ones(len(at), bool)
    inner[w.starts] = False
    here = np.flatnonzero(inner)
    here = here[at[here - 1] >= 0]
    relative = np.where(at[here] >= 0, at[here] - own.first[w.before[here]], -1)
    q, weight = own.trigrams(at[here - 1], relative)
    three = two.copy()
    three[here] = q + weight * two[here]
    return three


def score(docs: DataFrame, trie: Trie, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_tokens, n_known, base_score, score.

    Scores are log10 probabilities of the whole text with its end; ``base_score``
    is that of add-one unigrams. Null and empty texts are one end. Repeated rows
    and null ids are kept; an empty table gives no rows; further columns are
    ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_score(trie), f"id {kind}, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("id", id_col)
