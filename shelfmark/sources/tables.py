"""Reading: raw CSV as text, dataset folders, and published Parquet versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_COLUMNS = ("asin", "title", "imgUrl", "productURL", "stars", "reviews", "price", "listPrice", "category_id", "isBestSeller")


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """All columns as text, by the names of the header; quotes may hold commas, quotes and line breaks.

    With ``columns`` those are selected, and ones that the file doesn't have are null.
    """
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header.columns])
    raw = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').csv(path)
    if columns is None:
        return raw
    return raw.select(*[F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns])


def find_csv(spark: SparkSession, folder: str, preferred: str = "amazon_products.csv") -> str:
    """The preferred file of a folder, else its first CSV file by name; FileNotFoundError without one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        raise FileNotFoundError(folder)
    if not system.getFileStatus(path).isDirectory():
        return folder
    names = sorted(s.getPath().getName() for s in system.listStatus(path))
    found = [n for n in names if n == preferred] or [n for n in names if n.endswith(".csv")]
    if not found:
        raise FileNotFoundError(f"no CSV file in {folder}")
    return f"{folder.rstrip('/')}/{found[0]}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; the predicate reaches the Parquet scan."""
    return df.filter(F.col(key) == F.lit(value))


def with_vector(df: DataFrame, field: str = "embedding") -> DataFrame:
    return df.filter(F.col(field).isNotNull())


def numbered(df: DataFrame) -> DataFrame:
    """With ``seq``, which rises in scan order."""
    return df.withColumn("seq", F.monotonically_increasing_id())
