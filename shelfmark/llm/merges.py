"""Byte-pair merges of many short words in lockstep.

Words of one length are columns of a matrix; a step merges, in every column that
still has one, the leftmost pair of least rank, which is the order in which one word
alone is merged. So the ids are those of the tokenizer whose merges they are.
"""

from __future__ import annotations

import numpy as np

#: Words of a matrix, and slots of the table of pairs as a power of two.
WORDS, SLOTS = 8192, 19
_NONE = np.int32((1 << 31) - 1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Merges:
    """The merges of the model of a byte-level tokenizer file; ``alphabet`` gives the byte of each character of its tokens."""

    def __init__(self, model: dict, alphabet: dict[str, int]):
        self.usable = model["type"] == "BPE" and not any(model.get(k) for k in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        vocab = model["vocab"] if self.usable else {}
        self.usable = self.usable and max(vocab.values()) < 1 << 16 and all(c in vocab for c in alphabet)
        if not self.usable:
            return
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.byte = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.byte[b] = vocab[c]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.keys, self.ranks = np.full(1 << SLOTS, -1, np.int64), np.full(1 << SLOTS, _NONE, np.int32)
        for rank, (a, b) in enumerate(pairs):
            key = vocab[a] << 16 | vocab[b]
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] not in (-1, key):
                at = (at + 1) & ((1 << SLOTS) - 1)
            if self.keys[at] == -1:
                self.keys[at], self.ranks[at] = key, rank

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _FACTOR >> np.uint64(64 - SLOTS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or the largest number where it isn't merged."""
        shape = left.shape
        keys = (left.astype(np.int64) << 16 | right).reshape(-1)
        at = self._slot(keys)
        held = self.keys.take(at)
        found = np.where(held == keys, self.ranks.take(at), _NONE)
        look = np.flatnonzero((held != keys) & (held != -1))
        while len(look):
            at[look] = (at[look] + 1) & ((1 << SLOTS) - 1)
            held = self.keys[at[look]]
            found[look] = np.where(held == keys[look], self.ranks[at[look]], _NONE)
            look = look[(held != keys[look]) & (held != -1)]
        return found.reshape(shape)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words data[start:end], one word after another, and how many each has; a word is one stretch of the pre-tokeniser."""
        lengths = ends - starts
        sizes = np.zeros(len(starts), np.int64)
        order = np.argsort(lengths, kind="stable")
        cuts = np.searchsorted(lengths[order], np.arange(lengths.max(initial=0) + 2))
        held = []
        for n, (low, high) in enumerate(zip(cuts, cuts[1:])):
            for at in range(low, high, WORDS):
                some = order[at : min(high, at + WORDS)]
                ids, sizes[some] = self._columns(data[starts[some] + np.arange(n)[:, None]])
                held.append((some, ids.T))
        first = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.uint32)
        for some, ids in held:
            used = np.arange(ids.shape[1]) < sizes[some][:, None]
            out[(first[some][:, None] + np.arange(ids.shape[1]))[used]] = ids[used]
        return out, sizes

    def _columns(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each column of bytes."""
        n, words = text.shape
        done, sizes = np.zeros((n, words), np.int32), np.full(words, n, np.int64)
        ids = self.byte.take(text)
        if n < 2:
            return ids, sizes
        ranks = self.rank(ids[:-1], ids[1:])
        own, places = np.arange(words), np.arange(n)[:, None]  # words that go on; places in them
        for left in range(n, 0, -1):  # every word that goes on has so many ids
            if left == 1:
                done[0, own], sizes[own] = ids[0], 1
                break
            at = ranks.argmin(0)
            best = ranks[at, np.arange(len(own))]
            on = best != _NONE
            if not on.all():
                ended = own[~on]
                done[:left, ended], sizes[ended] = ids[:, ~on], left
                own, ids, ranks, at, best = own[on], ids[:, on], ranks[:, on], at[on], best[on]
                if not len(own):
                    break
            after = places[: left - 1] > at
            ids = np.where(after, ids[1:], ids[:-1])
            ids[at, np.arange(len(own))] = self.merged.take(best)
            if left > 2:
                ranks = np.where(after[: left - 2], ranks[1:], ranks[:-1])
                for look, side in ((np.flatnonzero(at > 0), -1), (np.flatnonzero(at < left - 2), 0)):
                    place = at[look] + side
                    ranks[place, look] = self.rank(ids[place, look], ids[place + 1, look])
        return done, sizes
