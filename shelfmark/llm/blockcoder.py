"""Adaptive context-mixing range coder for blocks of token ids, many blocks in lockstep.

Each block has a model of its own that starts afresh. Orders 1 and 2 predict one
id from the ids before; how sure each is, and how often predictions held lately,
add up in the logistic domain to the probability that the prediction holds, and
all three terms learn from every outcome. Where it doesn't hold, the id is coded
by its order-0 frequency among the ids so far, counted again at the places of
COUNTED; an id that has none yet follows an escape as a plain number. One numpy step
codes the next id of all blocks; every number is an integer, so all machines
decode alike.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a block, blocks coded together, entries of a prediction table.
BLOCK, LANES, TABLE = 8192, 1280, 1024
#: Ids after which the frequencies are counted again, and the bits that they add up to.
COUNTED = (32, 64, 128, 256, 512, 768, 1024, 1536, 2048, 3072, 4096, 6144)
BITS = 12
#: Ids lie below 2**IDS; the coder's interval is of 48 bits and moves on by words of 16.
IDS, WORD, FULL, LEAST = 20, 16, 1 << 48, 1 << 32
_WHOLE, _ID = 1 << BITS, (1 << IDS) - 1
_ESCAPE = 1 << IDS  # marks an escape in a packed entry: id or escape, frequency, start
_NOTHING = _ESCAPE | _WHOLE << 24  # the entry of an escape before anything is counted
_SQUASH = np.clip(np.rint(65536 / (1 + np.exp(-(np.arange(4096) - 2048) / 256.0))), 256, 65280).astype(np.int64)
#: How sure an entry is after a miss or a hit.
_SURE = np.array([*(s >> 1 for s in range(8)), *(min(s + 1, 7) for s in range(8))], np.int64)
_SURE[0:2] = 1  # a new id takes the place
_SURE = (_SURE << IDS).astype(np.int32)
#: Steps by which logits learn, as a power of two below the error of 65536.
_RATE = 8


class _Predictor:
    """Orders 1 and 2 of some blocks; ``n`` is how many of them are still going. Both orders are rows of the same arrays."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.places = np.stack((lane * TABLE, (lane + lanes) * TABLE))
        self.bases = np.stack((lane * 16, (lane + lanes) * 16, lane * 8 + lanes * 32))
        self.guess = np.zeros(2 * lanes * TABLE, np.int32)  # the id, how sure it is above
        of_sure = np.array([-512, *(-256 + 96 * s for s in range(1, 8))] * 2, np.int64)
        self.logits = np.concatenate((np.tile(of_sure, 2 * lanes), np.full(lanes * 8, 2048, np.int64)))  # 2048 is even odds
        self.context = np.zeros((2, lanes), np.int64)
        self.lately = np.zeros(lanes, np.int64)

    def predict(self, n: int) -> None:
        """The predicted id of each block and the probability (of 65536) that it comes."""
        self.at = ((self.context[:, :n] >> 4) & (TABLE - 1)) + self.places[:, :n]
        entry = self.guess.take(self.at)
        self.ids, self.sure = entry & _ID, entry >> IDS
        self.id = np.where(self.sure[1] > 0, self.ids[1], self.ids[0])
        self.slots = self.bases[:, :n].copy()
        self.slots[:2] += self.sure
        self.slots[:2] += (self.ids[0] == self.id) << 3
        self.slots[2] += self.lately[:n]
        self.held = self.logits.take(self.slots)
        self.p = _SQUASH.take(self.held[0] + self.held[1] + self.held[2], mode="clip")

    def learn(self, n: int, ids: np.ndarray, right: np.ndarray) -> None:
        """``ids`` came; ``right`` tells where the prediction held."""
        self.held += (np.where(right, 65536, 0) - self.p) >> _RATE
        self.logits[self.slots] = self.held
        lately = self.lately[:n]
        lately += lately + right
        lately &= 7
        same = self.ids == ids
        own = np.where(same | (self.sure < 2), ids, self.ids)
        own |= _SURE.take(self.sure + (same << 3))
        self.guess[self.at] = own
        mixed, context = ids * np.int64(40503), self.context[:, :n]
        context[1] = context[0] * 3 + mixed
        context[0] = mixed


class _Counts:
    """Order-0 frequencies of the ids so far of some blocks, which add up to 2**BITS with that of the escape."""

    def __init__(self, before: np.ndarray, escapes: np.ndarray, since: int):
        """``before`` has a row of ids for each block; ``escapes`` says how many of the last ``since`` ids had no frequency."""
        lanes, m = before.shape
        own = np.sort(before, axis=1).reshape(-1)
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        new[::m] = True
        at = np.flatnonzero(new)
        ids, count, lane = own[at].astype(np.int64), np.diff(np.append(at, len(own))), at // m
        escape = np.clip((escapes + 1) * _WHOLE // (since + 2), 8, _WHOLE * 7 // 8)
        least, keep = np.ones(lanes, np.int64), np.ones(len(ids), bool)
        while (over := np.bincount(lane[keep], minlength=lanes) > (_WHOLE - escape) // 2).any():  # the rarest ids go by the escape
            least[over] += 1
            keep &= count >= least[lane]
        ids, count, lane = ids[keep], count[keep], lane[keep]
        number = np.bincount(lane, minlength=lanes)
        total = np.maximum(1, np.bincount(lane, count, minlength=lanes).astype(np.int64))
        size = 1 + count * (_WHOLE - escape - number)[lane] // total[lane]
        used = np.bincount(lane, size, minlength=lanes).astype(np.int64)
        first = np.cumsum(number) - number
        start = np.cumsum(size) - size
        start -= (np.cumsum(used) - used)[lane]
        # an entry for each id, and after those of a block one for its escape
        self.first = first + np.arange(lanes)
        where = np.arange(len(ids)) + lane
        self.entries = np.full(len(ids) + lanes, _ESCAPE, np.int64)
        self.entries[where] = ids
        sizes, starts = np.empty(len(self.entries), np.int64), np.empty(len(self.entries), np.int64)
        sizes[where], starts[where] = size, start
        last = self.first + number
        sizes[last], starts[last] = _WHOLE - used, used
        self.entries |= (sizes << 24) | (starts << 40)
        self.sizes, self.last, self.lane, self.where = sizes, last, lane, where

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """For each value below 2**BITS of each block the number of its entry, counted from the block's first one; and the first ones."""
        own = np.arange(len(self.entries)) - self.first.repeat(self.last - self.first + 1)
        return own.astype(np.uint16).repeat(self.sizes), self.first

    def entries_of(self, ids: np.ndarray) -> np.ndarray:
        """The entries of ids, a row for each block."""
        out = np.empty(ids.shape, np.int64)
        wide = int(max(ids.max(initial=0), (self.entries & _ID).max(initial=0))) + 1
        some = max(1, (1 << 21) // wide)
        place = np.zeros(some * wide, np.int64)
        ends = np.searchsorted(self.lane, np.arange(0, len(ids) + some, some))
        for k, low in enumerate(range(0, len(ids), some)):
            mine = slice(ends[k], ends[k + 1])
            own, lanes = self.entries[self.where[mine]], ids[low : low + some]
            at = (self.lane[mine] - low) * wide + (own & _ID)
            place[at] = own
            found = place.take(np.arange(len(lanes))[:, None] * wide + lanes)
            out[low : low + some] = np.where(found, found, self.entries[self.last[low : low + some]][:, None])
            place[at] = 0
        return out


def _chunks(steps: int) -> list[tuple[int, int]]:
    cuts = [0, *(c for c in COUNTED if c < steps), steps]
    return list(zip(cuts, cuts[1:]))


def encode_blocks(blocks: list[np.ndarray], bits: int = IDS) -> list[bytes]:
    """The bytes of each block of ids, which lie below 2**bits; ``bits`` is IDS at most."""
    return _in_lanes(blocks, [len(b) for b in blocks], _encode, bits, b"")


def decode_blocks(coded: list[tuple[int, bytes]], bits: int = IDS) -> list[np.ndarray]:
    """The ids of each (number of ids, bytes)."""
    return _in_lanes(coded, [n for n, _ in coded], _decode, bits, np.zeros(0, np.uint32))


def _in_lanes(held: list, lengths: list[int], code, bits: int, none) -> list:
    """``code`` of the longest first, LANES at a time; ``none`` for those of no ids."""
    out = [none] * len(held)
    order = sorted((k for k in range(len(held)) if lengths[k]), key=lambda k: -lengths[k])
    for at in range(0, len(order), LANES):
        some = order[at : at + LANES]
        for k, x in zip(some, code([held[k] for k in some], bits)):
            out[k] = x
    return out


class _Writer:
    """The intervals and words of some blocks."""

    def __init__(self, lanes: int, words: int):
        self.low, self.size = np.zeros(lanes, np.int64), np.full(lanes, FULL, np.int64)
        self.words, self.used = np.zeros((lanes, words), np.uint32), np.zeros(lanes, np.int64)

    def carry(self, some: np.ndarray) -> None:
        """Adds one to the last word of those whose interval has left the range; sums above a word are mended at the end."""
        if len(some):
            self.words[some, self.used[some] - 1] += 1
            self.low[some] -= FULL

    def settle(self, need: np.ndarray) -> None:
        """Writes out the words of small intervals, which no longer change but by a carry."""
        while len(need):
            self.shift(need)
            size = self.size[need] << WORD
            self.size[need] = size
            need = need[size < LEAST]

    def shift(self, need: np.ndarray) -> None:
        at, low = self.used[need], self.low[need]
        if at.max(initial=0) >= self.words.shape[1]:
            self.words = np.concatenate((self.words, np.zeros_like(self.words)), axis=1)
        self.words.reshape(-1)[need * self.words.shape[1] + at] = low >> 32
        self.used[need] = at + 1
        self.low[need] = (low & (LEAST - 1)) << WORD

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for _ in range(3):
            self.shift(every)
        while (over := self.words >> WORD).any():
            self.words &= 0xFFFF
            self.words[:, :-1] += over[:, 1:]
        return [self.words[k, : self.used[k]].astype("<u2").tobytes() for k in every]


def _encode(blocks: list[np.ndarray], bits: int) -> list[bytes]:
    lengths = np.array([len(b) for b in blocks])
    lanes, steps = len(blocks), int(lengths.max())
    ids = np.zeros((lanes, steps), np.int32)
    for k, b in enumerate(blocks):
        ids[k, : len(b)] = b
    model, out = _Predictor(lanes), _Writer(lanes, max(16, steps * 5 // 8))
    escapes, since, n = np.zeros(lanes, np.int64), 0, lanes
    for begin, end in _chunks(steps):
        while lengths[n - 1] <= begin:
            n -= 1
        here = _Counts(ids[:n, :begin], escapes[:n], since) if begin else None
        entries = (here.entries_of(ids[:n, begin:end]) if here else np.full((n, end), _NOTHING)).T.copy()
        columns = ids[:n, begin:end].T.copy()
        escapes, since = np.zeros(lanes, np.int64), end - begin
        for now, entry in zip(columns, entries):
            while lengths[n - 1] <= begin:
                n -= 1
            begin += 1
            now, entry, low, size = now[:n], entry[:n], out.low[:n], out.size[:n]
            model.predict(n)
            right = model.id == now
            hit = (size >> 16) * model.p
            unit = (size - hit) >> BITS
            low += np.where(right, 0, hit + unit * (entry >> 40))
            size[:] = np.where(right, hit, unit * ((entry >> 24) & 0xFFFF))
            out.carry(np.flatnonzero(low >= FULL))
            out.settle(np.flatnonzero(size < LEAST))
            plain = np.flatnonzero((entry & _ESCAPE) > (right * _ESCAPE))
            if len(plain):
                escapes[plain] += 1
                for shift, width in _digits(bits):
                    unit = size[plain] >> width
                    low[plain] += unit * (now[plain] >> shift & ((1 << width) - 1))
                    size[plain] = unit
                    out.carry(plain[low[plain] >= FULL])
                    out.settle(plain[unit < LEAST])
            model.learn(n, now, right)
    return out.finish()


def _digits(bits: int) -> list[tuple[int, int]]:
    """(shift, bits) of the parts in which a plain number is written."""
    return [(0, bits)] if bits <= WORD else [(WORD, bits - WORD), (0, WORD)]


def _decode(coded: list[tuple[int, bytes]], bits: int) -> list[np.ndarray]:
    lengths = np.array([n for n, _ in coded])
    lanes, steps = len(coded), int(lengths.max())
    width = max(len(b) for _, b in coded) // 2 + 4
    words = np.zeros((lanes, width), np.uint16)
    for k, (_, b) in enumerate(coded):
        words[k, : len(b) // 2] = np.frombuffer(b, "<u2")
    flat, used = words.reshape(-1), np.arange(lanes) * width + 3
    stop = (np.arange(lanes) + 1) * width - 1
    first = words[:, :3].astype(np.int64)
    value, sizes = first[:, 0] << 32 | first[:, 1] << 16 | first[:, 2], np.full(lanes, FULL, np.int64)

    def settle(need: np.ndarray) -> None:
        while len(need):
            at, size = used[need], sizes[need] << WORD
            value[need] = value[need] << WORD | flat.take(np.minimum(at, stop[need]))
            used[need], sizes[need] = at + 1, size
            need = need[size < LEAST]

    ids = np.zeros((lanes, steps), np.int32)
    model, begins = _Predictor(lanes), np.arange(lanes) * _WHOLE
    escapes, since, n = np.zeros(lanes, np.int64), 0, lanes
    for begin, end in _chunks(steps):
        while lengths[n - 1] <= begin:
            n -= 1
        if begin:
            counts = _Counts(ids[:n, :begin], escapes[:n], since)
            (slots, firsts), entries = counts.slots(), counts.entries
        else:
            slots, firsts, entries = np.zeros(n * _WHOLE, np.uint16), np.zeros(n, np.int64), np.array([_NOTHING])
        columns = np.zeros((end - begin, n), np.int32)
        escapes, since = np.zeros(lanes, np.int64), end - begin
        for step, column in enumerate(columns, begin):
            while lengths[n - 1] <= step:
                n -= 1
            v, size = value[:n], sizes[:n]
            model.predict(n)
            hit = (size >> 16) * model.p
            over = v - hit
            unit = (size - hit) >> BITS
            right = over < 0
            # exact: both are below 2**48, and a quotient below 2**12 that is no whole number lies far enough from one
            place = np.minimum((over / unit).astype(np.int64), _WHOLE - 1)
            entry = entries.take(slots.take(np.maximum(place, 0) + begins[:n]) + firsts[:n])
            v[:] = np.where(right, v, over - unit * (entry >> 40))
            size[:] = np.where(right, hit, unit * ((entry >> 24) & 0xFFFF))
            settle(np.flatnonzero(size < LEAST))
            now = column[:n]
            now[:] = np.where(right, model.id, entry & _ID)
            plain = np.flatnonzero((entry & _ESCAPE) > (right * _ESCAPE))
            if len(plain):
                escapes[plain] += 1
                own = np.zeros(len(plain), np.int64)
                for _, wide in _digits(bits):
                    unit = size[plain] >> wide
                    got = np.minimum(v[plain] // unit, (1 << wide) - 1)
                    v[plain] -= unit * got
                    size[plain] = unit
                    own = own << wide | got
                    settle(plain[unit < LEAST])
                now[plain] = own
            model.learn(n, now, right)
        ids[: columns.shape[1], begin:end] = columns.T
    return [ids[k, : lengths[k]].astype(np.uint32) for k in range(lanes)]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
