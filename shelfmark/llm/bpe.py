"""BPE encoding and decoding with tree concatenation of long unsplit text.

The texts of a batch are cut where the pre-tokeniser always cuts: between a
character that is no white space and a blank. Each distinct piece of the batch
is encoded once: words of Latin letters by merging many of them in lockstep (see
``merges``), others by the library. Stretches that the pre-tokeniser leaves unsplit and that
are long are halved down to leaves, the leaves are encoded in one parallel batch,
and halves are joined bottom-up: a window around the join is encoded anew and
grows until its first and last token are the ones that the two sides already
had. A token list is the encoding of its text when every two neighbours are the
encoding of theirs, so agreement on both sides makes the joined list exact.
Nothing is remembered from one batch to the next.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm.arrowtext import column, release, steps
from shelfmark.llm.merges import Merges

#: Bytes of a leaf of the tree, tokens on each side of a first window.
LEAF, WINDOW = 512, 4
#: Bytes of text that are encoded together, and those of a word that is merged in lockstep at most.
STEP, WORD = 1 << 20, 64

#: White space of ASCII, and the first two bytes of longer characters among which white space is.
_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_WIDE = [(0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)]
#: Letters of ASCII; marks of ASCII but the apostrophe, which may begin a stretch with letters; first bytes of Latin letters.
_LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
_MARK = np.isin(np.arange(256), [*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
_MARKED = re.compile(r"[!-&(-/:-@\[-`{-~][A-Za-z\u0080-\uffff]|[^!-&(-~\u00c0-\u023f]")
_LATIN = np.isin(np.arange(256), [*range(0xC3, 0xC9)])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of byte-level tokens: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of ``sizes`` that begin at ``starts``, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def cuts(data: np.ndarray) -> np.ndarray:
    """The blanks that follow a character which surely is no white space."""
    at = np.flatnonzero(data == 0x20)
    at = at[at > 0]
    before = data[at - 1]
    safe = ~_SPACE[before]
    high = np.flatnonzero(before >= 0x80)
    if len(high):
        two, three = data[np.maximum(at[high] - 2, 0)], data[np.maximum(at[high] - 3, 0)]
        safe[high] &= two != 0xC2
        for first, second in _WIDE:
            safe[high] &= (three != first) | (two != second)
    return at[safe]


def latin_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pieces are a blank or none, Latin letters and then marks, and where the marks begin."""
    n = len(data)
    lead = _LATIN[data]
    after = np.zeros(n, bool)
    after[1:] = lead[:-1]
    following = np.zeros(n, np.uint8)
    following[:-1] = data[1:]
    sign = (data == 0xC3) & ((following == 0x97) | (following == 0xB7))  # of multiplication and division
    letter = _LETTER[data] | (lead & ~sign) | (after & (data >= 0x80))
    mark = _MARK[data]
    bad = ~(letter | mark)
    bad[1:] |= mark[:-1] & letter[1:]
    first = starts.copy()
    blank = data[np.minimum(starts, n - 1)] == 0x20
    first[blank] += 1
    wrong, marks = np.concatenate(([0], np.cumsum(bad))), np.concatenate(([0], np.cumsum(mark)))
    inner = np.minimum(first + 1, ends)  # a mark before the piece's first letter says nothing
    good = (first < ends) & (wrong[ends] == wrong[inner]) & letter[np.minimum(first, n - 1)]
    return good, ends - (marks[ends] - marks[np.minimum(first, ends)])


class Codec:
    """Encodes and decodes exactly as the tokenizer file's own library does, without added special tokens."""

    def __init__(self, path: str, leaf: int = LEAF):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.bare = Tokenizer(self.library.model)  # merges alone, on text in the byte alphabet
        self.leaf = leaf
        self.names = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        alphabet = byte_alphabet()
        self.bytes = [b""] * (max(self.names) + 1)
        for i, name in self.names.items():
            self.bytes[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        self.spelled = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.sizes = np.array([len(b) for b in self.bytes])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        made = json.loads(self.library.to_str())
        split = made["pre_tokenizer"] or {}
        #: Whether a blank after a character that is no white space always starts a piece.
        self.cuts = made["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not any(" " in t for t in self.special)
        self.merges = Merges(made["model"], alphabet)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_array(pa.array(texts, pa.string()))
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (u32), and how many ids there are up to each text's end; null is empty."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        places = np.zeros(len(data), bool)
        if self.cuts:
            places[cuts(data)] = True
        places[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.append(np.flatnonzero(places), len(data))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        ids, first, sizes = self._distinct(pieces.dictionary)
        which = pieces.indices.to_numpy()
        own = sizes[which]
        ends = np.concatenate(([0], np.cumsum(own)))
        return ids[ragged(first[which], own)], ends[np.searchsorted(starts, bounds[1:])]

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces: ids, where those of each piece begin, how many they are."""
        bounds = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1)
        data = np.frombuffer(pieces.buffers()[2], np.uint8)[: bounds[-1]]
        starts, ends = bounds[:-1], bounds[1:]
        words = np.zeros(len(pieces), bool)
        if self.cuts and self.merges.usable:
            words, marks = latin_words(data, starts, ends)
            words &= (ends - starts) <= min(WORD, self.leaf)
            words[list(self._spelled_special(pieces, words))] = False
        ids = [np.zeros(0, np.uint32)]
        first, sizes, held = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), 0
        at = np.flatnonzero(words)
        if len(at):
            some, own = self.merges.encode(data, starts[at], marks[at])
            tails = np.flatnonzero(marks[at] < ends[at])
            more, more_own = self.merges.encode(data, marks[at][tails], ends[at][tails])
            sizes[at] = own
            sizes[at[tails]] += more_own
            first[at] = np.cumsum(sizes[at]) - sizes[at]
            joined = np.zeros(int(sizes.sum()), np.uint32)
            joined[ragged(first[at], own)] = some
            joined[ragged(first[at[tails]] + own[tails], more_own)] = more
            ids.append(joined)
            held = len(joined)
        rest = np.flatnonzero(~words)
        texts = [p.decode() for p in pieces.take(pa.array(rest)).to_pylist()]
        long = [i for i, t in enumerate(texts) if len(t) >= self.leaf]
        done = dict(zip(long, self.encode_long([texts[i] for i in long])))
        short = [i for i in range(len(texts)) if i not in done]
        for a in range(0, len(short), 20_000):
            part = short[a : a + 20_000]
            done |= zip(part, (e.ids for e in self.library.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)))
        if done:
            flat = [np.array(done[i], np.uint32) for i in range(len(texts))]
            sizes[rest] = [len(x) for x in flat]
            first[rest] = held + np.cumsum(sizes[rest]) - sizes[rest]
            ids += flat
        return np.concatenate(ids), first, sizes

    def _spelled_special(self, pieces: pa.Array, words: np.ndarray) -> Iterator[int]:
        """Numbers of words in which a special token is spelled."""
        for token in self.special:
            if not token or _MARKED.search(token):
                continue  # letters after marks, or other characters, are in no word
            yield from (i for i in np.flatnonzero(words).tolist() if token in pieces[i].as_py().decode())

    def encode_long(self, texts: list[str]) -> list[list[int]]:
        """Pre-tokenises each text and encodes the unsplit stretches, long ones as trees; all trees grow together."""
        parts: list[list] = []
        stretches: list[str] = []
        for text in texts:
            own: list = []
            for part in self.split_special.split(text) if self.split_special else [text]:
                if part in self.special:
                    own.append([self.special[part]])
                elif part:
                    for name, _ in self.library.pre_tokenizer.pre_tokenize_str(part):
                        own.append(len(stretches))
                        stretches.append(name)
            parts.append(own)
        done = self.trees(stretches)
        return [[i for p in own for i in (done[p] if isinstance(p, int) else p)] for own in parts]

    def trees(self, stretches: list[str]) -> list[list[int]]:
        """The ids of stretches in the byte alphabet, by halving, encoding leaves and joining."""
        leaves, forest = [], []
        for s in stretches:
            n = 1
            while len(s) > self.leaf * n:
                n *= 2
            cuts = [len(s) * k // n for k in range(n + 1)]
            forest.append(range(len(leaves), len(leaves) + n))
            leaves += [s[a:b] for a, b in zip(cuts, cuts[1:])]
        ids = self._bare(leaves)
        trees = [[ids[k] for k in own] for own in forest]
        while any(len(t) > 1 for t in trees):
            joins = [(t, k) for t, own in enumerate(trees) for k in range(0, len(own) - 1, 2)]
            joined = iter(self._join([(trees[t][k], trees[t][k + 1]) for t, k in joins]))
            trees = [own if len(own) == 1 else [next(joined) for _ in range(0, len(own) - 1, 2)] for own in trees]
        return [t[0] for t in trees]

    def _bare(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]

    def _join(self, sides: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        out: list = [None] * len(sides)
        left, size = list(range(len(sides))), WINDOW
        while left:
            windows = [(sides[k][0][-size:], sides[k][1][:size]) for k in left]
            again = self._bare(["".join(self.names[i] for i in a + b) for a, b in windows])
            unsettled = []
            for k, (a, b), w in zip(left, windows, again):
                x, y = sides[k]
                if not x or not y:
                    out[k] = x + y
                elif (len(a) == len(x) or w[0] == a[0]) and (len(b) == len(y) or w[-1] == b[-1]):
                    out[k] = x[: len(x) - len(a)] + w + y[len(b) :]
                else:
                    unsettled.append(k)
            left, size = unsettled, size * 2
        return out

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids as the library decodes them, special tokens included; see :meth:`decode_array`."""
        own = np.frombuffer(ids, "<u4")
        return self.decode_array(own, np.array([len(own)])).cast(pa.binary())[0].as_py()

    def decode_array(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids one after another, cut at ``ends``. Broken sequences become U+FFFD; numbers that are no ids are left out, as in the library."""
        known = np.minimum(ids, len(self.sizes) - 1)
        sizes = np.where(ids < len(self.sizes), self.sizes[known], 0)
        data = self.spelled[ragged(self.starts[known], sizes)]
        bounds = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], ends))]
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file in a Python worker."""
    if path not in _codecs:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded_steps(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices with an ``id`` and a ``text`` column, the ids of their texts and where each text's end; null is empty."""
    own = codec(path)
    for batch in steps(batches, "text", STEP):
        yield batch, *own.encode_array(column(batch, "text"))
    release()


def _runner(path: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, ends in encoded_steps(batches, path):
            bounds = np.concatenate(([0], ends))
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds * 4), pa.py_buffer(ids.astype("<u4"))])
            columns = [column(batch, "id"), pa.array(np.diff(bounds)), held.cast(pa.binary())]
            if decode:
                columns.append(codec(path).decode_array(ids, ends))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids", "decoded"][: len(columns)])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, decode: bool = True) -> DataFrame:
    """One row for each row of ``docs``: id, n_tokens, ids, and with ``decode`` the decoded text.

    ``ids`` is binary, little-endian unsigned 32-bit integers. Null and empty
    texts have no ids and decode to the empty text. The spelling of a special
    token in a text is that token, as in the library. Repeated rows and null ids
    are kept; an empty table gives no rows; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids binary" + ", decoded string" * decode
    return rows.mapInArrow(_runner(tokenizer or default_tokenizer(), decode), schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """(id, text) from ids as :func:`encode` returns them; null ids decode to the empty text."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(path).decode(i or b"") for i in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
