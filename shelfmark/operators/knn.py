"""Nearest neighbours by cosine: exact, over int8 codes, rescored, and through an inverted-file index.

Scores are one matrix product for each Arrow batch. A task keeps the best k of
each probe, so only k rows a probe and task are shuffled, whatever the number of
vectors. Probes go to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Probes in a block, and bytes of a block of scores.
BLOCK, SCORE_BYTES = 2048, 64 << 20


def unit(matrix: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def to_matrix(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a vector of ``dims`` entries, those vectors as float64)."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    some = np.flatnonzero(sizes == dims)
    kept = vectors.take(pa.array(some)) if len(some) < len(vectors) else vectors
    return some, np.asarray(kept.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)


def codes(matrix: np.ndarray) -> np.ndarray:
    """int8 codes of unit vectors, as float32 for fast products; half away from zero as SQL rounds."""
    scaled = unit(matrix) * 127
    return (np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)).astype(np.float32)


class _Best:
    """The best k ids of each probe so far; ties go to the smaller id."""

    def __init__(self, probes: int, k: int):
        self.k = k
        self.scores = np.zeros((probes, 0))
        self.ids = np.zeros((probes, 0), np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate((self.scores, scores), axis=1)
        ids = np.concatenate((self.ids, np.broadcast_to(ids, (len(scores), len(ids)))), axis=1)
        if scores.shape[1] > 4 * self.k:  # drop what can't be among the best, ties at the edge kept
            edge = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            width = int((scores >= edge).sum(1).max())
            at = np.argsort(-scores, axis=1, kind="stable")[:, :width]
            scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.scores, self.ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _scan(names: list, matrix: np.ndarray, k: int, quantised: bool):
    own = codes(matrix) if quantised else unit(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(own), k)
        rows = max(1, SCORE_BYTES // (8 * len(own)))
        for batch in batches:
            some, held = to_matrix(batch.column(1), own.shape[1])
            ids = batch.column(0).take(pa.array(some)).to_numpy(zero_copy_only=False)
            sound = np.isfinite(held).all(1) & (np.linalg.norm(held, axis=1) > 0)
            held, ids = held[sound], ids[sound]
            for at in range(0, len(ids), rows):
                part = codes(held[at : at + rows]) if quantised else unit(held[at : at + rows])
                best.add(np.round((own @ part.T).astype(np.float64), 12), ids[at : at + rows])
        n = best.ids.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), n)), pa.array(best.ids.reshape(-1)), pa.array(best.scores.reshape(-1))], names=["qid", "id", "score"])

    return run


def count_close(rows: DataFrame, floor: float) -> DataFrame:
    """One row: ``close``, the sum of n * m over pairs of (id, v, n) whose cosine is above ``floor``, each pair once."""

    def count(names: list, matrix: np.ndarray, weights: np.ndarray):
        own, first = unit(matrix), np.array(names, np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, step = 0, max(1, SCORE_BYTES // (8 * len(own)))
            for batch in batches:
                some, held = to_matrix(batch.column(1), own.shape[1])
                ids, n = (batch.column(i).take(pa.array(some)).to_numpy(zero_copy_only=False) for i in (0, 2))
                for at in range(0, len(ids), step):
                    close = (own @ unit(held[at : at + step]).T > floor) & (first[:, None] < ids[None, at : at + step])
                    total += int(weights @ close @ n[at : at + step])
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["close"])

        return run

    held = rows.select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("n").alias("qn"))
    parts = []
    for names, matrix in _blocks(held):
        weights = {r["qid"]: r["qn"] for r in held.filter(F.col("qid").isin(names)).select("qid", "qn").collect()}  # a block
        parts.append(rows.select("id", "v", "n").mapInArrow(count(names, matrix, np.array([weights[q] for q in names], np.int64)), "close long"))
    if not parts:
        return rows.sparkSession.createDataFrame([(0,)], "close long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.agg(F.coalesce(F.sum("close"), F.lit(0)).alias("close"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def _blocks(probes: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, matrix) of at most about BLOCK probes each."""
    n = -(-probes.count() // BLOCK)
    for b in range(n):
        rows = probes.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == b).orderBy("qid").collect()
        rows = [r for r in rows if r["qv"]]
        for dims in sorted({len(r["qv"]) for r in rows}):
            own = [r for r in rows if len(r["qv"]) == dims]
            yield [r["qid"] for r in own], np.array([r["qv"] for r in own], dtype=np.float64)


def exact_topk(vectors: DataFrame, probes: DataFrame, k: int, id_col: str = "vec_id", field: str = "embedding", quantised: bool = False) -> DataFrame:
    """(qid, id, score, place) of the ``k`` nearest vectors of each probe (qid, qv).

    The score is cosine + 1, from 0 to 2, or with ``quantised`` the product of
    int8 codes. Ties go to the smaller id. Null vectors, ones of another length,
    not finite or without length are never found; empty probes find nothing.
    """
    if k < 1:
        raise ValueError(f"k {k}")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(field).alias("v")).filter(F.col("v").isNotNull())
    parts = [rows.mapInArrow(_scan(names, matrix, k, quantised), "qid long, id long, score double") for names, matrix in _blocks(probes)]
    if not parts:
        return probes.sparkSession.createDataFrame([], "qid long, id long, score double, place int")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return _ranked(found, k).withColumn("score", F.col("score") if quantised else F.col("score") + 1)


def rescored_topk(vectors: DataFrame, probes: DataFrame, k: int, oversample: int = 4, id_col: str = "vec_id", field: str = "embedding") -> DataFrame:
    """As :func:`exact_topk` among the ``k * oversample`` candidates of each probe by int8 codes."""
    from shelfmark.functions.vector import cosine

    near = exact_topk(vectors, probes, k * oversample, id_col, field, quantised=True).select("qid", "id")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(field).alias("v"))
    scored = near.join(rows, "id").join(probes.select("qid", "qv"), "qid").select("qid", "id", (F.round(cosine("v", "qv"), 12) + 1).alias("score"))
    return _ranked(scored, k)


def probes_by_id(vectors: DataFrame, every: int = 50, id_col: str = "vec_id", field: str = "embedding") -> DataFrame:
    """Every vector whose id is divisible by ``every``, as probes."""
    return vectors.filter(F.col(id_col) % every == 0).select(F.col(id_col).cast("long").alias("qid"), F.col(field).cast("array<double>").alias("qv"))


def text_probes(spark, texts: dict[int, str], backend, prefix: str = "") -> DataFrame:
    """Query texts by id as probes (qid, qv); a handful, embedded on the driver."""
    held = sorted(texts.items())
    vectors = backend.embed([prefix + t for _, t in held])
    return spark.createDataFrame([(i, [float(x) for x in v]) for (i, _), v in zip(held, vectors)], "qid long, qv array<double>")


def authentic(vectors: DataFrame, texts: dict[int, str], backend, prefix: str = "", id_col: str = "vec_id", field: str = "embedding") -> DataFrame:
    """(qid, found_itself): whether the nearest vector of each stored text, embedded again, is its own with a cosine of about 1."""
    first = exact_topk(vectors, text_probes(vectors.sparkSession, texts, backend, prefix), 1, id_col, field)
    return first.select("qid", ((F.col("qid") == F.col("id")) & (F.col("score") > 2 - 1e-4)).alias("found_itself"))


class InvertedFile:
    """Vectors by the nearest of some centroids; a probe looks into the nearest cells only.

    Centroids are learned by spherical k-means on at most ``sample`` vectors with
    the lowest hashes; every vector is indexed.
    """

    def __init__(self, centroids: np.ndarray, cells: DataFrame):
        self.centroids, self.cells = centroids, cells

    @classmethod
    def build(cls, vectors: DataFrame, cells: int = 16, sample: int = 20_000, id_col: str = "vec_id", field: str = "embedding", rounds: int = 12) -> InvertedFile:
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(field).alias("v")).filter(F.col("v").isNotNull())
        some = unit(np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()], dtype=np.float64))
        if not len(some):
            raise ValueError("no vectors to learn cells from")
        centroids = some[np.random.default_rng(5).permutation(len(some))[:cells]]
        for _ in range(rounds):
            near = (some @ centroids.T).argmax(1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, near, some)
            centroids = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, held = to_matrix(batch.column(1), centroids.shape[1])
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array((unit(held) @ centroids.T).argmax(1).astype(np.int32))], names=["id", "v", "cell"])

        kind = rows.schema["v"].dataType.simpleString()
        return cls(centroids, rows.mapInArrow(assign, f"id long, v {kind}, cell int"))

    def save(self, path: str) -> None:
        """Writes the index by cell, so that a search only reads the cells it looks into."""
        self.cells.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)

    def at(self, spark, path: str) -> InvertedFile:
        return InvertedFile(self.centroids, spark.read.parquet(path))

    def search(self, probes: DataFrame, k: int, cells: int = 4) -> DataFrame:
        """(qid, id, score, place) among the vectors of the ``cells`` nearest cells of each probe."""
        centroids = self.centroids
        parts = []
        for names, matrix in _blocks(probes):
            near = np.argsort(-(unit(matrix) @ centroids.T), axis=1, kind="stable")[:, :cells]
            looked = np.zeros((len(names), len(centroids)), bool)
            np.put_along_axis(looked, near, True, 1)
            wanted = np.flatnonzero(looked.any(0)).tolist()
            rows = self.cells.filter(F.col("cell").isin(wanted)).select("id", "v", "cell")
            parts.append(rows.mapInArrow(_cell_scan(names, matrix, looked, k), "qid long, id long, score double"))
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return _ranked(found, k).withColumn("score", F.col("score") + 1)


def _cell_scan(names: list, matrix: np.ndarray, looked: np.ndarray, k: int):
    own = unit(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(own), k)
        rows = max(1, SCORE_BYTES // (8 * len(own)))
        for batch in batches:
            some, held = to_matrix(batch.column(1), own.shape[1])
            ids, cells = (batch.column(i).take(pa.array(some)).to_numpy(zero_copy_only=False) for i in (0, 2))
            for at in range(0, len(ids), rows):
                scores = np.round(own @ unit(held[at : at + rows]).T, 12)
                best.add(np.where(looked[:, cells[at : at + rows]], scores, -np.inf), ids[at : at + rows])
        hit = np.isfinite(best.scores)
        if hit.any():
            q = np.repeat(np.array(names, np.int64)[:, None], hit.shape[1], 1)
            yield pa.RecordBatch.from_arrays([pa.array(q[hit]), pa.array(best.ids[hit]), pa.array(best.scores[hit])], names=["qid", "id", "score"])

    return run
