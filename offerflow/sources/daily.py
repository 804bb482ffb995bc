"""Offers stored by day, so that an age limit is a choice of folders.

``posted_ts`` gives the day; offers without a date share one folder that no age limit
reads. A day's rows are split over files by a hash, so a busy day is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.offers import fresh_only


def write_by_day(offers: DataFrame, path: str) -> None:
    dated = offers.withColumn("day", F.to_date("posted_ts"))
    (dated.repartitionByRange("day", F.xxhash64("job_url")).write.mode("overwrite").partitionBy("day").parquet(path))


def read_fresh(spark: SparkSession, path: str, ref_ts: str, max_days_old: int) -> DataFrame:
    """Offers at most so many days old at ``ref_ts``; other days' folders are not opened."""
    first = F.date_sub(F.to_date(F.lit(ref_ts)), int(max_days_old))
    return fresh_only(spark.read.parquet(path).where(F.col("day") >= first), ref_ts, max_days_old).drop("day")


def read_for(spark: SparkSession, path: str, ref_ts: str, searches: DataFrame) -> DataFrame:
    """Offers that some search's age limit lets pass: the longest limit decides, and a
    search without one asks for every offer."""
    row = searches.agg(F.max("max_days_old").alias("days"), F.count_if(F.col("max_days_old").isNull()).alias("open")).first()
    if row["open"] or row["days"] is None:
        return spark.read.parquet(path).drop("day")
    return read_fresh(spark, path, ref_ts, row["days"])
