"""The catalogue as a stream: new CSV files are cleaned and upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.products import to_documents
from shelfmark.plans.publish import Catalogue
from shelfmark.sources.contract import product_contract
from shelfmark.sources.tables import RAW_COLUMNS


def csv_stream(spark: SparkSession, folder: str, columns: tuple[str, ...] = RAW_COLUMNS, files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as they come, all columns as text in the order of ``columns``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(folder)


def upsert_stream(spark: SparkSession, folder: str, warehouse: str, index: str, checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Takes what is there and ends; run again it takes what is new.

    A batch that is run again after a failure writes the same documents by the
    same keys, so the index holds each once.
    """
    catalogue, contract = Catalogue(spark, warehouse), product_contract()

    def load(batch: DataFrame, number: int) -> None:
        rows = to_documents(batch.withColumn("seq", F.monotonically_increasing_id()))
        catalogue.create(index, contract)
        catalogue.load(index, rows, contract)

    return csv_stream(spark, folder, files_per_batch=files_per_batch).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
