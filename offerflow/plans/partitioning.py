"""Spreading CPU-heavy rows over the cluster.

AQE sizes shuffle partitions by bytes, which is right for byte-heavy data but
wrong for rows that are small yet expensive (a title exploded into n-grams,
a page parsed in Python): a few hundred kB of them coalesce into one task.
``spread`` hash-partitions such rows on a key into the session's
``spark.sql.shuffle.partitions`` (an explicit count, which AQE keeps), so the
parallelism follows the cluster size rather than the input file layout. When
the key is part of a later grouping key, that grouping needs no shuffle of
its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffle_partitions(df: DataFrame) -> int:
    try:
        return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    except Exception:  # noqa: BLE001 - unset or odd value: Spark's default
        return 200


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition ``df`` on ``keys`` into shuffle.partitions partitions."""
    return df.repartition(shuffle_partitions(df), *keys)


def spread_few(df: DataFrame, *keys: str) -> DataFrame:
    """``spread`` for a frame that reads fewer files than there are shuffle
    partitions; a frame of more files has tasks enough and stays where it is read."""
    return spread(df, *keys) if len(df.inputFiles()) < shuffle_partitions(df) else df
