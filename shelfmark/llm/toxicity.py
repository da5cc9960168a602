"""Toxicity by maximum-scoring segments.

Words and word beginnings get log-odds of toxic against clean text under an
informative Dirichlet prior; a word scores as itself or else as its longest
beginning with significant odds, and without any it gets a small penalty. One linear scan finds
all maximal scoring segments of a text. Segment scores of clean text follow an
extreme-value law; its parameters turn the segments of a text into one evidence
value, and a logistic curve turns that into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from shelfmark.llm.arrowtext import column, steps, utf8
from shelfmark.llm.storage import stage

#: Labelled rows learned from at most, prior words, significance of a word's odds, words of the model at most.
ROWS, PRIOR, LEAST_Z, MOST_WORDS = 16_000, 500.0, 3.2, 50_000
#: Least log-odds of a word, either way, tried on the learning rows: small ones come from copies of a few texts.
LEAST_ODDS = (1.0, 1.5, 2.0, 2.5, 3.0)
#: Parts of the learning rows; each is scored by weights of the others. Words whose score one of those trials remembers.
PARTS, TRIAL_WORDS = 4, 20_000
#: Code points of the beginnings, longest first, and words whose score a task remembers.
BEGINNINGS, REMEMBERED = (9, 8, 7, 6, 5), 300_000
#: Score of a word without significant odds, and the largest score of one with.
NEUTRAL, MOST = -0.15, 6.0
#: A segment is a passage if a clean text of its length has one as high with at most this probability.
SIGNIFICANT = 0.01
#: Words that a counting task holds before it hands them on.
HELD = 300_000

_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: bytes | None) -> list[bytes]:
    if not text:
        return []
    return (text if text.isascii() else text.decode().lower().encode()).translate(_TABLE).split()


def tokens(word: bytes) -> list[bytes]:
    """A word and its beginnings, marked by an asterisk, longest first."""
    text = word.decode()
    return [word, *(text[:n].encode() + b"*" for n in BEGINNINGS if len(text) > n)]


class Scores(dict):
    """Score of a word by its longest token with one, 0 without; filled as words come."""

    def __init__(self, weights: dict[bytes, float], remembered: int):
        self.weights, self.remembered = weights, remembered

    def __missing__(self, word: bytes) -> float:
        if len(self) > self.remembered:
            self.clear()
        found = self[word] = next((self.weights[t] for t in tokens(word) if t in self.weights), 0.0)
        return found


@dataclass
class Model:
    weights: dict[bytes, float]
    rate: float = 1.0  # of the extreme-value law of clean texts
    place: float = 1.0  # its factor of the text's length
    slope: float = 1.0
    shift: float = -4.0
    remembered: int = REMEMBERED
    scores: Scores | None = None

    def segments(self, text: bytes | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Words of the text, and its maximal scoring segments (first word, word after the last, score)."""
        if self.scores is None:
            self.scores = Scores(self.weights, self.remembered)
        own = words(text)
        return len(own), maximal_segments([(i, s) for i, s in enumerate(map(self.scores.__getitem__, own)) if s])

    def chance(self, score: float, n: int) -> float:
        """Probability that a clean text of ``n`` words has a segment of this score."""
        return -math.expm1(-self.place * n * math.exp(-self.rate * score))

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Sum over segments of how far each stands above what the length explains."""
        if not found:
            return 0.0
        base = math.log(max(self.place * n, 1e-9))
        top = max(s for _, _, s in found)
        return max(0.0, self.rate * top - base) + sum(max(0.0, self.rate * s - base - 4) for _, _, s in found if s < top)

    def score(self, n: int, found: list[tuple[int, int, float]]) -> float:
        x = self.slope * self.evidence(n, found) + self.shift
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def maximal_segments(scored: list[tuple[int, float]], neutral: float = NEUTRAL) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a word sequence, in linear time (Ruzzo and Tompa).

    ``scored`` has (place, score) of the words with a score of their own, in
    order; each word between them scores ``neutral`` (negative).
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, total before, total after, stack place of a lower start
    total, last = 0.0, -1
    for place, score in scored:
        total += neutral * (place - last - 1)
        last = place
        before, total = total, total + score
        if score <= 0:
            continue
        first, low, after = place, before, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append((first, place + 1, low, after, j))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, after - low) for a, b, low, after, _ in stack]


def _counted(kinds: list[str]) -> str:
    return "word binary, " + ", ".join(f"{k} long" for k in kinds)


#: Columns of counts: clean and toxic texts of each part.
KINDS = [f"{k}{part}" for part in range(PARTS) for k in ("clean", "toxic")]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [Counter() for _ in KINDS]

    def out() -> pa.RecordBatch:
        names = list(set().union(*held))
        batch = pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *(pa.array([c[w] for w in names], pa.int64()) for c in held)], names=["word", *KINDS])
        for c in held:
            c.clear()
        return batch

    for batch in steps(batches, "text"):
        for text, toxic, part in zip(utf8(column(batch, "text")), column(batch, "toxic").to_pylist(), column(batch, "part").to_pylist()):
            held[2 * part + toxic].update({t for word in set(words(text)) for t in tokens(word)})  # texts, not words, so one text counts once
        if sum(map(len, held)) > HELD:
            yield out()
    yield out()


def log_odds(counts: DataFrame, prior: float = PRIOR, least_z: float = LEAST_Z, least_odds: float = LEAST_ODDS[0], most_words: int = MOST_WORDS) -> dict[bytes, float]:
    """Log-odds of the words of (word, clean, toxic) under a Dirichlet prior of half a text plus a share in proportion to their overall counts.

    Words whose odds lie ``least_z`` standard errors and ``least_odds`` from even are returned, the
    most significant ``most_words`` at most (the size of the model).
    """
    n = counts.agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).first()
    if not n["c"] or not n["t"]:
        return {}
    all_ = float(n["c"] + n["t"])
    a = F.col("clean") + F.col("toxic")
    own = 0.5 + prior * a / all_
    at, ac = F.col("toxic") + own, F.col("clean") + own
    odds = F.log(at / (n["t"] + prior)) - F.log(ac / (n["c"] + prior))
    rated = counts.select("word", odds.alias("odds"), (odds / F.sqrt(1 / at + 1 / ac)).alias("z"))
    kept = rated.filter((F.abs("z") >= least_z) & (F.abs("odds") >= least_odds)).orderBy(F.abs("z").desc(), "word").limit(most_words).collect()
    return {bytes(r["word"]): r["odds"] for r in kept}


def weights(odds: dict[bytes, float], least: float) -> dict[bytes, float]:
    """The words with log-odds of at least ``least``, either way, and their scores."""
    return {w: max(-MOST, min(MOST, x)) for w, x in odds.items() if abs(x) >= least}


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift by Newton steps with a small ridge, so separable rows end too."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-3 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, g), -5, 5)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", rows: int = ROWS) -> Model:
    """A model learned from at most ``rows`` labelled ids among those where ``learn`` (on the id) holds.

    The sample is the labelled ids with the lowest hashes, so the joined side is
    bounded by ``rows``; where an id has several texts, all count, and the curves
    are fitted on the ``rows`` with the lowest hashes. Null labels are left out;
    an id with several labels counts as toxic if any is. Without both kinds of
    rows every text scores low.

    The least odds, the extreme-value law and the logistic curve are learned
    from scores that rows of one part get by weights of the other parts; equal
    texts are in one part. If no part's rows get any score that way, as with a
    few dozen rows, from the scores by weights of all rows.
    """
    known = labels.filter(learn & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    known = known.select("key", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")).orderBy(F.xxhash64("key"), "key").limit(rows)
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    mark = F.xxhash64("text")
    some = texts.join(F.broadcast(known), "key").select("text", "toxic", mark.alias("mark"), F.pmod(mark, F.lit(PARTS)).cast("int").alias("part"))
    sums = [F.sum(k).alias(k) for k in KINDS]
    counts = stage(some.mapInArrow(_count, _counted(KINDS)).groupBy("word").agg(*sums), "toxicity-counts")

    def odds_without(part: int | None) -> dict[bytes, float]:
        own = {k: sum(F.col(f"{k}{p}") for p in range(PARTS) if p != part) for k in ("clean", "toxic")}
        return log_odds(counts.select("word", own["clean"].alias("clean"), own["toxic"].alias("toxic")))

    whole = odds_without(None)
    if not whole:
        return Model({})
    parts = [odds_without(p) for p in range(PARTS)]

    def sample(odds: list[dict[bytes, float]]) -> list[Row]:  # numbers of at most ``rows`` texts
        return some.mapInArrow(_sample(odds), "mark long, toxic int, n long, scores array<array<double>>").orderBy("mark", "n", "toxic").limit(rows).collect()

    seen = sample(parts)
    if not any(s for r in seen for s in r["scores"]):
        seen = sample([whole] * PARTS)
    toxic = np.array([r["toxic"] for r in seen], float)
    best, found = math.inf, Model({})
    for k, least in enumerate(LEAST_ODDS):
        model = Model(weights(whole, least))
        clean = [(r["n"], max(r["scores"][k], default=0.0)) for r in seen if not r["toxic"] and r["n"]]
        model.rate, model.place = extreme_value([n for n, _ in clean], [s for _, s in clean])
        x = np.array([model.evidence(r["n"], [(0, 0, s) for s in r["scores"][k]]) for r in seen])
        model.slope, model.shift = _logistic(x, toxic)
        p = np.clip(1 / (1 + np.exp(-np.clip(model.slope * x + model.shift, -50, 50))), 1e-6, 1 - 1e-6)
        loss = -float(np.mean(np.log(np.where(toxic > 0, p, 1 - p))))
        if loss <= best and model.weights:
            best, found = loss, model
    return found


def extreme_value(lengths: list[int], tops: list[float]) -> tuple[float, float]:
    """Rate and place of P(top >= s) = 1 - exp(-place n exp(-rate s)), by likelihood over clean texts that have a segment.

    Texts without one add their length to the exposure below the lowest score.
    """
    n, s = np.array(lengths, float), np.array(tops, float)
    has = s > 0
    if has.sum() < 5:
        return 1.0, 1.0 / max(1.0, n.sum())
    floor = float(np.quantile(s[has], 0.05))
    over = s > floor
    rate = float(np.clip(1 / max(1e-6, (s[over] - floor).mean()), 0.1, 5)) if over.any() else 1.0
    return rate, float(over.sum() / max(1.0, n.sum()) * math.exp(rate * floor))


def _sample(parts: list[dict[bytes, float]]):
    """Segment scores of each text for each of LEAST_ODDS, by the weights given for its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trials = [[Model(weights(odds, least), remembered=TRIAL_WORDS) for least in LEAST_ODDS] for odds in parts]
        for batch in steps(batches, "text"):
            found = [[m.segments(t) for m in trials[part]] for t, part in zip(utf8(column(batch, "text")), column(batch, "part").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "mark"), column(batch, "toxic").cast(pa.int32()), pa.array([f[0][0] for f in found], pa.int64()),
                 pa.array([[[s for _, _, s in segments] for _, segments in f] for f in found], pa.list_(pa.list_(pa.float64())))],
                names=["mark", "toxic", "n", "scores"],
            )

    return run


def _scorer(model: Model):
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            scores, passages = [], []
            for text in utf8(column(batch, "text")):
                n, found = model.segments(text)
                scores.append(model.score(n, found))
                sure = [(a, b, s) for a, b, s in found if model.chance(s, n) <= SIGNIFICANT]
                own = []
                if sure:
                    places = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
                    chars = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                    own = [{"start": int(chars[places[a][0]]) - 1, "end": int(chars[places[b - 1][1] - 1]), "score": s} for a, b, s in sure]
                passages.append(own)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(scores, pa.float64()), pa.array(passages, pa.list_(span))], names=["id", "score", "passages"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, score, passages (start, end, score of each significant one).

    Offsets are code points of the original. Null and empty texts have no
    passage and the score of no evidence. Repeated rows and null ids are kept;
    an empty table gives no rows; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scorer(model), f"id {kind}, score double, passages array<struct<start:int,end:int,score:double>>").withColumnRenamed("id", id_col)
