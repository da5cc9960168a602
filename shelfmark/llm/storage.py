"""Written tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs a re-read and never a recomputation.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a number, or a number and a small array, that are broadcast at most; larger sides are joined by shuffle.
BROADCAST_ROWS = 1_000_000

#: Spark's setting by which a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the session; an own one only where that is unset and Spark runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors see")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="shelfmark-shared-")
    return _own[app]


def new_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/shelfmark/{purpose}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table; a folder that is gone already, or a stopped session, is no error."""
    if spark.sparkContext._jsc is None:
        if path.startswith("file:"):
            shutil.rmtree(urlparse(path).path, ignore_errors=True)
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    return stage_at(df, purpose)[0]


def stage_at(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """As :func:`stage`, with the path, for callers that delete the table themselves."""
    spark = df.sparkSession
    path = new_path(spark, purpose)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the written table is all that is read again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def with_places(docs: DataFrame, purpose: str) -> DataFrame:
    """``docs`` as c0, c1, ... with the place of each row: ``_file`` (long, a hash of the path) and ``_row`` (long, the number in the file).

    A place is the same however a scan is split into tasks, and however often it
    is repeated. What isn't a scan of files, with filters and columns at most, is
    written to the shared folder first.
    """
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    path = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    placed = None
    if node.nodeName() == "LogicalRelation":
        with contextlib.suppress(AnalysisException):  # a format without row numbers
            placed = docs.select("*", *path)
    if placed is None:
        placed = stage(named, purpose).select("*", *path)
    return placed.toDF(*named.columns, "_file", "_row")


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to have at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
