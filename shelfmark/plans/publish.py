"""Versions of an index, and the pointer that names the published one.

A version ``<base>_v<n>[_<stamp>]`` is a folder of generations, each an immutable
Parquet folder, and a small file that names the current one. An alias is a small
file too. Both are replaced by a rename, so a reader sees the state before a load
or after it, and files that a reader has opened stay until the load after next.
"""

from __future__ import annotations

import logging
import re
import time
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.upsert import last_wins, merge
from shelfmark.sources.contract import Contract

log = logging.getLogger(__name__)


def next_version(names: list[str], base: str, now: datetime | None = None) -> str:
    """The name after the highest version of ``base``; names with another suffix don't count."""
    pattern = re.compile(re.escape(base) + r"_v(\d+)(?:_\d{8}-\d{4})?")
    last = max((int(m[1]) for m in map(pattern.fullmatch, names) if m), default=0)
    return f"{base}_v{last + 1}_{(now or datetime.now(timezone.utc)).strftime('%Y%m%d-%H%M')}"


@dataclass
class Loaded:
    """What a load did; rejected rows don't fail it."""

    target: str
    indexed: int
    rejected: int
    seconds: float = 0.0
    examples: list = field(default_factory=list)

    @property
    def rate(self) -> float:
        return self.indexed / self.seconds if self.seconds else 0.0


class Catalogue:
    """Versions and aliases below a root folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.mkdirs(self._path(f"{self.root}/_aliases"))

    def path(self, name: str) -> str:
        """The folder of a version's current generation."""
        now = self._read(f"{name}/_current")
        return f"{self.root}/{name}/{now}" if now else f"{self.root}/{name}"

    def names(self) -> list[str]:
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory())
        return sorted(n for n in found if not n.startswith("_"))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def read(self, name: str) -> DataFrame:
        """A version, or the one that an alias points to."""
        return self.spark.read.parquet(self.path(self.target(name) or name))

    def display(self, name: str, contract: Contract) -> DataFrame:
        """As :meth:`read` without the contract's hidden columns, which Parquet then never reads."""
        return self.read(name).drop(*contract.hidden)

    def target(self, alias: str) -> str | None:
        targets = self.targets(alias)
        if len(targets) > 1:
            raise ValueError(f"alias {alias} points to several versions: {targets}")
        return targets[0] if targets else None

    def targets(self, alias: str) -> list[str]:
        return sorted(self._read(f"_aliases/{alias}").split())

    def _read(self, name: str) -> str:
        """The text of a small file, empty if there is none."""
        at = self._path(f"{self.root}/{name}")
        if not self._fs.exists(at):
            return ""
        stream = self._fs.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def next_version(self, base: str, now: datetime | None = None) -> str:
        return next_version(self.names(), base, now)

    def write_target(self, base: str, alias: str) -> str:
        """Where an incremental load goes: the alias's version, else a folder named like the base, else version 1."""
        return self.target(alias) or (base if self.exists(base) else f"{base}_v1")

    def create(self, name: str, contract: Contract) -> bool:
        """An empty version of the contract; one that is there stays as it is."""
        if self.exists(name):
            return False
        self._advance(name, "", self.spark.createDataFrame([], contract.schema))
        return True

    def publish(self, alias: str, name: str) -> list[str]:
        """Points the alias to a version; the versions that it pointed to before, which stay for a rollback."""
        if not self.exists(name):
            raise ValueError(f"no version {name}")
        before = [t for t in self.targets(alias) if t != name]
        self._put(alias, name)
        return before

    rollback = publish

    def _put(self, alias: str, text: str) -> None:
        self._replace("_aliases", alias, text)

    def _replace(self, folder: str, name: str, text: str) -> None:
        """Writes a small file under another name and renames it over the old one."""
        jvm = self.spark.sparkContext._jvm
        own = self._path(f"{self.root}/{folder}/.{name}.{jvm.java.util.UUID.randomUUID()}")
        out = self._fs.create(own, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        overwrite[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(own, self._path(f"{self.root}/{folder}/{name}"), overwrite)

    def _advance(self, name: str, before: str, rows: DataFrame, files: int | None = None) -> None:
        """Makes ``rows`` the current generation of a version whose generation was ``before`` when they were read.

        The generation before stays for its readers; older ones are deleted. A
        version that has moved on meanwhile is a RuntimeError and stays as it is.
        """
        number = int(before[1:7]) + 1 if before else 1
        now = f"g{number:06d}-{uuid.uuid4().hex[:8]}"
        (rows.repartition(files) if files else rows).write.option("compression", "zstd").parquet(f"{self.root}/{name}/{now}")
        if self._read(f"{name}/_current") != before:
            self._fs.delete(self._path(f"{self.root}/{name}/{now}"), True)
            raise RuntimeError(f"{name} was changed by another load")
        self._replace(name, "_current", now)
        for s in self._fs.listStatus(self._path(f"{self.root}/{name}")):
            own = s.getPath().getName()
            if own.startswith("g") and own not in (now, before) and int(own[1:7]) < number:
                self._fs.delete(s.getPath(), True)

    def load(self, name: str, rows: DataFrame, contract: Contract, order: str = "seq", partitions: int | None = None) -> Loaded:
        """Upserts rows by the contract's key: valid ones replace their key's document, the last by ``order`` wins.

        Rows are written once before they are counted and merged, so what made
        them, such as calls of an embedding service, isn't done again.
        """
        began = time.time()
        extra = [order] if order in rows.columns else []
        body = rows.drop(*extra)
        contract.check_columns(body)
        seen, held = Observation(), f"{self.root}/_staged-{uuid.uuid4().hex}"
        marked = rows.withColumn("problems", contract.problems(body))
        good = F.size("problems") == 0
        marked.observe(seen, F.count_if(good).alias("indexed"), F.count_if(~good).alias("rejected")).write.parquet(held)
        try:
            staged = self.spark.read.schema(marked.schema).parquet(held)
            new = last_wins(staged.filter(good).drop("problems"), contract.key, *(extra or [c for c in body.columns if c != contract.key][:1])).drop(*extra)
            new = new.select(*[new[f.name].cast(f.dataType).alias(f.name) for f in contract.schema if f.name in new.columns])
            before = self._read(f"{name}/_current")
            if self.exists(name):
                new = merge(self.spark.read.parquet(self.path(name)), new, contract.key)
            if partitions:
                new = new.repartition(partitions, contract.key)
            self._advance(name, before, new)
            counts = seen.get
            examples = [r.asDict(recursive=True) for r in staged.filter(~good).limit(5).collect()] if counts["rejected"] else []
        finally:
            self._fs.delete(self._path(held), True)
        done = Loaded(name, counts["indexed"], counts["rejected"], time.time() - began, examples)
        log.info("%s: %d documents, %d rejected, %.0f a second", name, done.indexed, done.rejected, done.rate)
        return done

    def files(self, name: str) -> int:
        """Part files of a version."""
        return sum(s.getPath().getName().endswith(".parquet") for s in self._fs.listStatus(self._path(self.path(name))))

    def compact(self, name: str, files: int = 1) -> tuple[int, int]:
        """Rewrites a version in ``files`` files: (files before, after)."""
        n, before = self.files(name), self._read(f"{name}/_current")
        self._advance(name, before, self.spark.read.parquet(self.path(name)), files)
        return n, self.files(name)

    def count(self, name: str) -> int:
        return self.read(name).count()

    def view(self, alias: str, view: str | None = None) -> None:
        """The published version as a temporary view, for SQL."""
        self.read(alias).createOrReplaceTempView(view or alias)
