"""The two ingestion plans: a clean catalogue, and a catalogue with vectors behind two gates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.config import Settings
from shelfmark.operators.embed import EmbeddingBackend, embed, get_backend
from shelfmark.operators.gates import check_backend, check_recall
from shelfmark.operators.knn import rescored_topk
from shelfmark.operators.products import limit_emitted, to_documents
from shelfmark.plans.publish import Catalogue, Loaded
from shelfmark.sources.contract import product_contract
from shelfmark.sources.tables import RAW_COLUMNS, find_csv, numbered, read_csv


class GateFailed(RuntimeError):
    pass


@dataclass
class Outcome:
    loaded: Loaded | None
    target: str | None
    documents: int
    published: bool = False
    detached: tuple[str, ...] = ()
    reports: tuple = ()
    sample: tuple = ()


def documents(spark: SparkSession, csv: str, limit: int | None, require_title: bool, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Documents of a CSV file with ``seq``; ``transform`` replaces the usual projection."""
    raw = numbered(read_csv(spark, find_csv(spark, csv), RAW_COLUMNS))
    own = transform(raw) if transform else to_documents(raw, require_title)
    return limit_emitted(own, limit)


def ingest_catalogue(spark: SparkSession, csv: str, settings: Settings, limit: int | None = None, dry_run: bool = False) -> Outcome:
    """Cleans and upserts products; the index is compacted to one file a shard."""
    rows = documents(spark, csv, limit, False)
    if dry_run:
        return Outcome(None, None, rows.count())
    catalogue = Catalogue(spark, settings.warehouse)
    contract = product_contract()
    catalogue.create(settings.index, contract)
    loaded = catalogue.load(settings.index, rows, contract)
    catalogue.compact(settings.index, 1)
    return Outcome(loaded, settings.index, catalogue.count(settings.index))


def ingest_vectors(
    spark: SparkSession, csv: str, settings: Settings, dims: int = 768, limit: int | None = None, dry_run: bool = False, skip_checks: bool = False, recreate: bool = True,
    make: Callable[[], EmbeddingBackend] | None = None, search: Callable | None = None, max_files: int | None = None, most_rejected: int | None = None,
) -> Outcome:
    """Gate, embed, load, gate, publish. A failed gate raises GateFailed and leaves the alias alone.

    Vectors are written once before they are counted, sampled and searched.
    With ``most_rejected`` more rejected rows than that fail the load too.
    """
    make = make or (lambda: get_backend(settings.backend, **({"dims": dims} if settings.backend == "lexical" else {"url": settings.backend_url})))
    reports = []
    if not skip_checks:
        report = check_backend(spark, make(), settings.document_prefix, dims).first()
        reports.append(report)
        if not report["ok"]:
            raise GateFailed("; ".join(report["failures"]))
    rows = embed(documents(spark, csv, limit, True), make, settings.embed_batch, settings.workers, prefix=settings.document_prefix)
    if dry_run:
        head = rows.select("asin", F.size("embedding").alias("dims"), F.slice("embedding", 1, 5).alias("first")).limit(1).collect()
        return Outcome(None, None, rows.count(), reports=tuple(reports), sample=tuple(head))
    catalogue = Catalogue(spark, settings.warehouse)
    base, alias = settings.vector_index, settings.vector_alias
    target = catalogue.next_version(base) if recreate else catalogue.write_target(base, alias)
    contract = product_contract(dims)
    catalogue.create(target, contract)
    loaded = catalogue.load(target, rows, contract)
    if max_files:
        catalogue.compact(target, max_files)
    n = catalogue.count(target)
    if most_rejected is not None and loaded.rejected > most_rejected:
        raise GateFailed(f"{loaded.rejected} rejected rows, at most {most_rejected} are allowed")
    if not skip_checks:
        held = catalogue.read(target).withColumn("vec_id", F.xxhash64("asin"))
        report = check_recall(held, search or (lambda probes, k: rescored_topk(held, probes, k))).first()
        reports.append(report)
        if not report["ok"]:
            raise GateFailed("; ".join(report["failures"]))
    return Outcome(loaded, target, n, True, tuple(catalogue.publish(alias, target)), tuple(reports))
