"""Tables read one key at a time: few sorted files and an index of their ranges.

Rows are range-partitioned and sorted by (key, order), so a table is as many files as
it has partitions, however many keys there are, and a key that holds much of the
table spans several. ``index`` keeps the first and last (key, order) of every file;
reading one key looks there, opens only the files whose range holds it, and the
Parquet statistics inside them narrow it further. No folder is listed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_ranged(df: DataFrame, path: str, key: str, order: Sequence[str] = (), partitions: int | None = None) -> None:
    cols = [key, *order]
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *cols).sortWithinPartitions(*cols)
    # texts of one key are alike, which zstd finds over a whole page
    ranged.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
    spark = df.sparkSession
    at = F.struct(*cols)
    rows = spark.read.schema(df.schema).parquet(f"{path}/rows").select(*cols, F.input_file_name().alias("file"))
    index = rows.groupBy("file").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("rows"))
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/index")  # a row per file


def read_ranged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def read_key(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """The rows of one key; a null value gives the rows without one."""
    index = spark.read.parquet(f"{path}/index")
    first, last, v = F.col(f"first.{key}"), F.col(f"last.{key}"), F.lit(value)
    # nulls sort first
    holds = first.isNull() if value is None else (first.isNull() | (first <= v)) & (last >= v)
    files = [r["file"] for r in index.where(holds).select("file").collect()]
    rows = spark.read.parquet(*files) if files else spark.read.parquet(f"{path}/rows").limit(0)
    return rows.where(F.col(key).isNull() if value is None else F.col(key) == v)
