"""Embedding backends and the batched embedding of a text column."""

from __future__ import annotations

import json
import logging
import re
import time
import urllib.error
import urllib.request
import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.text import bucket, tokens
from shelfmark.functions.vector import bind, normalise

log = logging.getLogger(__name__)


class EmbeddingBackend(Protocol):
    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def describe(self) -> dict: ...


class Overloaded(RuntimeError):
    """The backend refused for too long; fewer workers or smaller batches help."""


class BatchTooLarge(RuntimeError):
    """The backend doesn't take batches of this size."""


class HttpBackend:
    """A model server with POST /embed and GET /info; it truncates and normalises."""

    name = "http"

    def __init__(self, url: str, timeout: float = 120.0, attempts: int = 5, wait: Callable[[float], None] = time.sleep):
        self.url, self.timeout, self.attempts, self.wait = url.rstrip("/"), timeout, attempts, wait

    def _call(self, path: str, body: dict | None = None):
        request = urllib.request.Request(self.url + path, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.loads(answer.read())

    def embed(self, texts: list[str]) -> list[list[float]]:
        for n in range(self.attempts):
            try:
                return self._call("/embed", {"inputs": texts, "truncate": True, "normalize": True})
            except urllib.error.HTTPError as e:
                if e.code == 413:
                    raise BatchTooLarge(f"{len(texts)} texts are too many for one call; lower the batch size") from e
                if e.code != 429:
                    raise RuntimeError(f"the backend answered {e.code}") from e
            self.wait(0.5 * 2**n)
        raise Overloaded(f"still overloaded after {self.attempts} attempts; lower the workers or the batch size")

    def describe(self) -> dict:
        try:
            info = self._call("/info")
        except (OSError, ValueError) as e:
            return {"name": self.name, "url": self.url, "error": str(e)}
        return {"name": self.name, "url": self.url, "model": info.get("model_id"), "revision": info.get("model_sha")}


_WORDS = re.compile(rb"[a-z0-9]+").findall


class LexicalBackend:
    """A bag of words, hashed into buckets and normalised; texts without a word are zero vectors."""

    name = "lexical"

    def __init__(self, dims: int = 768):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._unit(Counter(zlib.crc32(w) % self.dims for w in _WORDS(t.lower().encode()))) for t in texts]

    def _unit(self, counts: Counter[int]) -> list[float]:
        vector = np.zeros(self.dims)
        if counts:
            vector[list(counts)] = list(counts.values())
            vector /= np.sqrt(vector @ vector)
        return vector.tolist()

    def describe(self) -> dict:
        return {"name": self.name, "dims": self.dims}


_BACKENDS: dict[str, Callable[..., EmbeddingBackend]] = {"lexical": LexicalBackend, "http": HttpBackend}


def register_backend(name: str, factory: Callable[..., EmbeddingBackend]) -> None:
    _BACKENDS[name.strip().lower()] = factory


def get_backend(name: str | None = None, **how) -> EmbeddingBackend:
    own = (name or "lexical").strip().lower()
    if own not in _BACKENDS:
        raise ValueError(f"unknown backend {name!r}; known are {', '.join(sorted(_BACKENDS))}")
    return _BACKENDS[own](**how)


def embed(df: DataFrame, make: Callable[[], EmbeddingBackend], batch_size: int = 128, workers: int = 4, text_col: str = "title", field: str = "embedding", prefix: str = "") -> DataFrame:
    """``df`` with the vector of ``prefix`` and the text; rows stay in their partitions, in order.

    A backend is made once a task. Calls have ``batch_size`` texts, only a
    partition's last one fewer; ``workers`` of them are on the way at one time in
    a task, and as many wait, so the cluster has that many for each of its cores.
    A wrong number of vectors, or an error of the backend, fails the job. Null
    texts get a null vector and are never sent.
    """
    if batch_size < 1:
        raise ValueError(f"batch_size {batch_size}")
    if workers < 1:
        raise ValueError(f"workers {workers}")
    rows = df.drop(field)
    schema = T.StructType([*rows.schema.fields, T.StructField(field, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend, began, sent = make(), time.time(), 0
        held: deque[tuple[pa.RecordBatch, list, list[int]]] = deque()  # a batch, its vectors, how many are missing
        calls: deque = deque()  # what is on the way, and where its vectors go
        waiting: list[tuple[str, list, int, list[int]]] = []

        def ask(part: list):
            found = backend.embed([prefix + text for text, *_ in part])
            if len(found) != len(part):
                raise RuntimeError(f"the backend gave {len(found)} vectors, asked for {len(part)}")
            return found

        def settle() -> None:
            call, part = calls.popleft()
            for (_, vectors, i, missing), vector in zip(part, call.result()):
                vectors[i] = vector
                missing[0] -= 1

        def ready(all_: bool = False) -> Iterator[pa.RecordBatch]:
            while held and (all_ or not held[0][2][0]):
                batch, vectors, _ = held.popleft()
                columns = [batch.column(i) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(vectors, pa.list_(pa.float32()))], names=schema.names)

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                vectors, missing = [None] * len(texts), [sum(t is not None for t in texts)]
                held.append((batch, vectors, missing))
                waiting += [(t, vectors, i, missing) for i, t in enumerate(texts) if t is not None]
                while len(waiting) >= batch_size:
                    part, waiting = waiting[:batch_size], waiting[batch_size:]
                    calls.append((pool.submit(ask, part), part))
                    sent += len(part)
                    if len(calls) > 2 * workers:
                        settle()
                        yield from ready()
            if waiting:
                calls.append((pool.submit(ask, waiting), waiting))
                sent += len(waiting)
            while calls:
                settle()
                yield from ready()
            yield from ready(True)
        log.info("%d texts embedded, %.1f a second", sent, sent / max(1e-9, time.time() - began))

    return rows.mapInArrow(run, schema)


def embed_cached(df: DataFrame, cache: DataFrame, make: Callable[[], EmbeddingBackend], revision: str, prefix: str = "", text_col: str = "title", field: str = "embedding", **how) -> DataFrame:
    """As :func:`embed`, but a text that ``cache`` (text, revision, prefix, vector) has is not sent again, and a repeated one once."""
    known = cache.filter((F.col("revision") == revision) & (F.col("prefix") == prefix)).select(F.col("text").alias(text_col), F.col("vector").alias(field))
    new = df.select(text_col).filter(F.col(text_col).isNotNull()).distinct().join(known, text_col, "left_anti")
    fresh = embed(new, make, prefix=prefix, text_col=text_col, field=field, **how)
    return df.drop(field).join(known.unionByName(fresh.select(text_col, field)), text_col, "left")


def lexical_vectors(df: DataFrame, id_col: str, text_col: str, dims: int = 768, prefix: str = "") -> DataFrame:
    """(id, embedding) as :class:`LexicalBackend` computes them, in expressions only."""
    used = F.transform(tokens(F.concat(F.lit(prefix), F.col(text_col))), lambda w: bucket(w, dims))

    def dense(b: Column, u: Column) -> Column:
        """From the buckets ``b`` and the distinct ones in order: zeros up to each, then its count."""
        before = lambda j: F.when(j > 0, F.get(u, j - 1)).otherwise(-1)
        runs = F.transform(u, lambda x, j: F.concat(F.array_repeat(F.lit(0.0), x - before(j) - 1), F.array(F.size(F.filter(b, lambda y: y == x)).cast("double"))))
        return F.concat(F.flatten(runs), F.array_repeat(F.lit(0.0), F.lit(dims - 1) - F.coalesce(F.try_element_at(u, F.lit(-1)), F.lit(-1))))

    vector = bind(used, lambda b: bind(F.array_sort(F.array_distinct(b)), lambda u: normalise(dense(b, u))))
    return df.select(F.col(id_col), vector.cast("array<float>").alias("embedding"))
