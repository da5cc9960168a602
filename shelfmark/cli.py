"""Command line: ``python -m shelfmark.cli catalogue|vectors --csv PATH [options]``."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from shelfmark.config import Settings
from shelfmark.plans.ingest import GateFailed, ingest_catalogue, ingest_vectors
from shelfmark.shipping import ship


def parser() -> argparse.ArgumentParser:
    own = argparse.ArgumentParser(prog="shelfmark")
    own.add_argument("plan", choices=("catalogue", "vectors"))
    own.add_argument("--csv", required=True, help="a CSV file, or a folder with one")
    own.add_argument("--warehouse")
    own.add_argument("--dry-run", action="store_true")
    own.add_argument("--limit", type=int)
    own.add_argument("--embed-batch", type=int)
    own.add_argument("--backend")
    own.add_argument("--workers", type=int)
    own.add_argument("--dims", type=int, default=768)
    own.add_argument("--skip-checks", action="store_true")
    own.add_argument("--recreate", action="store_true")
    return own


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    given = {"warehouse": a.warehouse, "embed_batch": a.embed_batch, "backend": a.backend, "workers": a.workers}
    settings = replace(Settings.from_env(), **{k: v for k, v in given.items() if v is not None})
    spark = spark or SparkSession.builder.appName("shelfmark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    try:
        if a.plan == "catalogue":
            done = ingest_catalogue(spark, a.csv, settings, a.limit, a.dry_run)
        else:
            done = ingest_vectors(spark, a.csv, settings, a.dims, a.limit, a.dry_run, a.skip_checks, a.recreate)
    except GateFailed as e:
        sys.exit(str(e))
    print(f"{done.documents} documents" + (f" in {done.target}, {done.loaded.indexed} indexed, {done.loaded.rejected} rejected" if done.loaded else ""))
    return 0


if __name__ == "__main__":
    sys.exit(main())
