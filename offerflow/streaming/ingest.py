"""Offer files as a stream: each micro-batch runs the incremental pipeline
against state kept as a log in a shared folder.

``readStream`` (file source) -> ``foreachBatch`` -> for every ``batch_id`` present,
in order (null first): one run over the newest version of the history log,
which writes what the batch changes and notes (epoch, batch) in the commit. A
replay after a failure skips what is noted and goes on behind it, so every batch
of an epoch counts once and the rows are the same. An epoch writes as much as it
changes, whatever the history's size, and old versions are pruned.
Keep-last dedupe can replace an earlier row, so this is not
``dropDuplicates`` state: the state is a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.state import ORDER, seen_urls, stamp_import
from ..plans.pipeline import OFFER_COLS, run_on_log
from ..schemas import OFFER
from ..sources.history_log import HistoryLog

#: Versions that readers may still hold.
KEPT_VERSIONS = 4
#: Name of the batch of rows without a batch id.
NO_ID = "none"


def offer_stream_schema(df: DataFrame) -> T.StructType:
    return df.select(*OFFER_COLS).schema


def state_log(spark: SparkSession, state_dir: str) -> HistoryLog:
    by_name = {f.name: f for f in OFFER.fields}
    return HistoryLog(spark, state_dir, T.StructType([by_name[c] for c in OFFER_COLS]))


def seed_state(history: DataFrame, state_dir: str) -> None:
    """The stored history before any run, and its URLs."""
    if not set(ORDER) <= set(history.columns):
        history = stamp_import(history)
    state_log(history.sparkSession, state_dir).create(history, seen=seen_urls(history))


def read_state(spark: SparkSession, state_dir: str, version: int | None = None) -> DataFrame:
    return state_log(spark, state_dir).read(version)


def _batches(data: DataFrame, after: str | None):
    """(name, rows) of each batch id of a micro-batch behind ``after``, in order, null
    first, found one by one."""
    last = None
    if after is None and data.where("batch_id is null").limit(1).count():
        yield NO_ID, data.where("batch_id is null")
    elif after not in (None, NO_ID):
        last = int(after)
    while True:
        later = data if last is None else data.where(F.col("batch_id") > last)
        last = later.agg(F.min("batch_id")).first()[0]
        if last is None:
            return
        yield str(last), data.where(F.col("batch_id") == last)


def _run_epoch(batch_df: DataFrame, epoch_id: int, state_dir: str, groups, excludes, forgetful: bool) -> None:
    data = batch_df.select(*OFFER_COLS)
    log = state_log(batch_df.sparkSession, state_dir)
    if not log.exists():
        log.create(data.limit(0), merged=True)
    done = log.noted(epoch=epoch_id)
    for name, rows in _batches(data, done.info["upto"] if done else None):
        run_on_log(log, rows, groups, excludes, forgetful, epoch=epoch_id, upto=name)
    log.prune(KEPT_VERSIONS)


def stream_ingest(spark: SparkSession, source_dir: str, schema: T.StructType, state_dir: str,
                  checkpoint_dir: str, groups: Sequence[Sequence[str]], excludes: Sequence[str],
                  forgetful: bool = True, timeout_s: int | None = None) -> DataFrame:
    """Process every offer file available under ``source_dir``, however long it
    takes (or up to ``timeout_s``), and return the resulting current offers."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    query = (stream.writeStream
             .foreachBatch(lambda df, eid: _run_epoch(df, eid, state_dir, groups, excludes, forgetful))
             .option("checkpointLocation", checkpoint_dir)
             .trigger(availableNow=True)
             .start())
    query.awaitTermination() if timeout_s is None else query.awaitTermination(timeout_s)
    if query.isActive:
        query.stop()
        raise TimeoutError("stream_ingest did not finish in time")
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return read_state(spark, state_dir)
