"""Session helpers: a local session for tests and the shared scratch folder.

Library code never creates a session of its own; it takes the caller's.
Writes that must survive executor loss go below ``spark.checkpoint.dir``,
the shared folder the cluster names. Only when that setting is unset (local
tests, bench) do we point it at a fresh temporary folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "offerflow") -> SparkSession:
    """A local[N] session configured like the cluster profile (AQE on, UI off)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a temporary one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # Local runs (tests, bench): no cluster folder exists.
        configured = tempfile.mkdtemp(prefix="offerflow-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/offerflow/{name}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` computed once, into Parquet files of the scratch folder, each sorted by ``order``.

    As durable as a reliable checkpoint, which writes every row in full: values that
    repeat next to each other, as an offer's in all its pairs, are held about once here."""
    path = scratch_path(df.sparkSession, name)
    (df.sortWithinPartitions(*order) if order else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
