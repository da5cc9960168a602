"""Language ID with a byte convolutional network.

Bytes are embedded, filters of several widths run over fixed-length windows, each
filter's maximum over a window feeds a softmax. The network is trained here in
numpy on a bounded sample of labelled text and applied to every window of every
text; a text's probabilities are the means over its windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.arrowtext import column, release, steps
from shelfmark.llm.storage import fits, stage

#: Bytes of a window (a multiple of each width), filter widths, filters of a width, numbers of a byte.
LENGTH, WIDTHS, FILTERS, DIM = 240, (2, 3, 4), 12, 8
#: At most so many labelled rows of each language are learned from, with so many windows of each.
ROWS, CUTS, EPOCHS = 800, 3, 8
#: Training steps at least, so that small samples are learned too.
STEPS = 400
UNKNOWN = "und"
#: Windows that are scored together.
BATCH = 512

_PLAIN = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter, of the categories Lu, Ll, Lt, Lm and Lo; numbers such as \u00b2 and \u2167 are none."""
    return bool(text) and (_PLAIN.search(text) is not None or any(map(str.isalpha, text)))


def to_windows(text: bytes) -> np.ndarray:
    """All windows of a text as (windows, LENGTH) bytes, the last one filled up with zeros."""
    own = np.frombuffer(text.lower(), np.uint8)
    out = np.zeros((max(1, -(-len(own) // LENGTH)), LENGTH), np.uint8)
    out.reshape(-1)[: len(own)] = own
    return out


class ByteNet:
    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.embed = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [rng.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.shift = np.zeros(len(classes), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.shift]

    def _pool(self, windows: np.ndarray, places: bool) -> tuple[np.ndarray, list]:
        """The maxima of each filter, before bias; with ``places`` where they are.

        Positions of one remainder modulo the width don't overlap, so their patches
        are a plain view of the embedded bytes and each remainder is one product.
        """
        n = len(windows)
        flat = self.embed[windows.reshape(-1)].reshape(-1)
        maxima, where = [], []
        for w, f in zip(WIDTHS, self.filters):
            best, at = None, None
            for r in range(w):
                rows = LENGTH // w * n - (r > 0)
                got = flat[r * DIM : r * DIM + rows * w * DIM].reshape(rows, w * DIM) @ f
                if r:  # the last patch of a window would run into the next window
                    got = np.concatenate((got, got[:1]))
                got = got.reshape(n, LENGTH // w, FILTERS)[:, : LENGTH // w - (r > 0)]
                if places:
                    k = got.argmax(1)
                    top = np.take_along_axis(got, k[:, None], 1)[:, 0]
                    k = k * w + r
                    at = k if best is None else np.where(top > best, k, at)
                else:
                    top = got.max(1)
                best = top if best is None else np.maximum(best, top)
            maxima.append(best)
            where.append(at)
        return np.concatenate(maxima, 1), where

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self._pool(windows, False)[0] + self.bias, 0)
        return _softmax(pooled @ self.out + self.shift)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        pooled, where = self._pool(windows, True)
        hidden = np.maximum(pooled + self.bias, 0)
        error = _softmax(hidden @ self.out + self.shift)
        error[np.arange(len(labels)), labels] -= 1
        error /= len(labels)
        back = (error @ self.out.T) * (hidden > 0)
        embed, filters = np.zeros_like(self.embed), []
        for i, (w, f, at) in enumerate(zip(WIDTHS, self.filters, where)):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]  # rows, filters
            bytes_ = np.take_along_axis(windows[:, None, :], at[:, :, None] + np.arange(w), 2)  # rows, filters, width
            patch = self.embed[bytes_].reshape(len(labels), FILTERS, w * DIM)
            filters.append(np.einsum("nfk,nf->kf", patch, own, optimize=True))
            np.add.at(embed, bytes_.reshape(-1), (own[:, :, None] * f.T[None]).reshape(-1, DIM))
        embed[0] = 0
        return [embed, *filters, back.sum(0), hidden.T @ error, error.sum(0)]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[bytes], labels: list[str], epochs: int = EPOCHS, rate: float = 0.004, batch: int = 128, seed: int = 7) -> ByteNet:
    """Adam on cross-entropy over windows; the same rows in the same order give the same network."""
    net = ByteNet(sorted(set(labels)), seed)
    number = {c: i for i, c in enumerate(net.classes)}
    parts = [to_windows(t) for t in texts]
    x, y = np.concatenate(parts), np.repeat([number[c] for c in labels], [len(p) for p in parts])
    rng = np.random.default_rng(seed)
    held = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(max(epochs, -(-STEPS * batch // len(x)))):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            step += 1
            some = order[at : at + batch]
            for p, g, (m, v) in zip(net.parameters(), net.gradients(x[some], y[some]), held):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", rows: int = ROWS) -> ByteNet | None:
    """A network learned from at most ``rows`` rows of each language among those where ``learn`` holds.

    The sample is the rows with the lowest hashes of ``key_col``; of each, CUTS
    stretches of a window are sent to the driver. Rows are counted by language
    first, so that only those with hashes low enough are ranked. Rows with a null language or a
    text without a letter are not learned from; None where no row is left.
    """
    pick = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "text"))
    some = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    some = some.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(key_col)).alias("h"), F.col(text_col).cast("string").alias("text"))
    some = some.select("lang", "h", F.array(*[F.expr(f"substring(text, 1 + pmod(xxhash64(h, {k}), greatest(length(text) - {LENGTH - 40}, 1)), {LENGTH - 20})") for k in range(CUTS)]).alias("text"))
    counts = fits(stage(some.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langid-counts"))
    low = F.pmod("h", F.lit(1 << 30)) < F.least(F.lit(1.0), (4.0 * rows + 100) / F.col("n")) * float(1 << 30)
    some = some.join(counts, "lang").filter(low)
    got = [(r["lang"], t) for r in some.withColumn("k", pick).filter(F.col("k") <= rows).orderBy("h", "lang", "text").collect() for t in dict.fromkeys(r["text"])]
    got = [(lang, t.encode()[:LENGTH]) for lang, t in got if has_letter(t)]
    return train([t for _, t in got], [lang for lang, _ in got]) if got else None


def _names_of(net: ByteNet | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language of each text, and its score."""
    known = [i for i, t in enumerate(texts) if net and has_letter(t)]
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if known:
        raw = [texts[i].encode() for i in known]
        parts = [to_windows(t) for t in raw]
        x = np.concatenate(parts)
        p = np.concatenate([net.probabilities(x[a : a + BATCH]) for a in range(0, len(x), BATCH)])
        starts = np.cumsum([0] + [len(w) for w in parts[:-1]])
        weight = np.minimum(LENGTH, np.concatenate([len(t) - LENGTH * np.arange(len(w)) for t, w in zip(raw, parts)])).astype(np.float64)
        mean = np.add.reduceat(p * weight[:, None], starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
        for i, c, s in zip(known, mean.argmax(1).tolist(), mean.max(1).tolist()):
            names[i], scores[i] = net.classes[c], min(1.0, s)
    return names, scores


def _predict(net: ByteNet | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            names, scores = _names_of(net, column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(names), pa.array(scores)], names=["id", "lang_pred", "score"])
        release()

    return run


def _keep(net: ByteNet | None, text: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            names, scores = _names_of(net, column(batch, text).cast(pa.string()).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores)]))
        release()

    return run


def predict(docs: DataFrame, net: ByteNet | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: id, lang_pred, score.

    Every window of the whole text counts by its bytes. Texts that are null,
    empty or without a letter, and all texts where nothing could be learned, are
    ``und`` with score 0. Ties take the first language by name. Repeated rows
    are kept; an empty table gives no rows; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_predict(net), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, net: ByteNet | None, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with a score of ``least`` or more, all columns unchanged.

    Null and empty texts and those without a letter go, and all where nothing
    could be learned. Repeated rows are judged alike; an empty table gives no rows.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_keep(net, names[docs.columns.index(text_col)], least), schema).toDF(*docs.columns)
