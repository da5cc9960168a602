"""Sends this package to the executors, so that functions defined in it can be loaded there."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


#: Bytes of an Arrow batch between Spark and Python, unless the session has set its own; texts may be long.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file, once for each application, and bounds Arrow batches by bytes where the session doesn't."""
    if spark.conf.getAll.get(BATCH[0]) is None:
        spark.conf.set(*BATCH)
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="shelfmark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it from the driver
    held = os.path.join(folder, "pkg")
    shutil.copytree(root, os.path.join(held, "shelfmark"), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "shelfmark"), "zip", held))
    _sent.add(app)
