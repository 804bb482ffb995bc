"""Exact dedup by content sort.

Texts (whole, after an optional normalisation) are range-partitioned by splitters
that Spark samples from their content, sorted inside each partition with
spilling, and compared in full with their neighbour. A row whose text differs
from the one before it starts a run; a run is a group of equal texts.

The order is (first ``HEAD`` characters, 64-bit hash, piece, text, identifier), so a
sampled splitter is of bounded size whatever the texts' lengths, and texts that
share a long beginning still spread. The hash only orders: two texts that
share it are told apart by the comparison of whole texts.

A group of copies may hold much of the table. Texts that weigh more than an even
share of a partition (there are at most as many as partitions) are cut into
pieces of about one share, which are sorted apart; the first text of each run of a
piece, compared in full with those of the other pieces, joins them. All steps are
DataFrame functions.

Defined results: a null text counts as empty, and empty texts equal one another;
one row per input row; of equal texts the row with the largest identifier stays
(``keep="smallest"``: the smallest), a null identifier only where the group has no
other; of rows that share that identifier too, exactly one stays; empty tables
give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerflow.llm.common import bounded, saved

HEAD = 64
#: Bytes of text in a partition, about, where the session's number of partitions is too small.
SHARE_BYTES = 128 << 20
_GROUP = ["head", "h", "piece"]


def _keyed(docs: DataFrame, normalise: Callable[[Column], Column] | None) -> DataFrame:
    text = F.col("text") if normalise is None else normalise(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.substring("text", 1, HEAD).alias("head"), F.xxhash64("text").alias("h"))


def _heavy(rows: DataFrame, least_parts: int) -> tuple[DataFrame, int]:
    """((h, pieces) of texts heavier than an even share, number of shares)."""
    weights = saved(rows.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 16).alias("bytes")),
                    "text-weights")
    total = weights.agg(F.sum("bytes")).first()[0] or 0
    parts = max(least_parts, -(-total // SHARE_BYTES))
    share = max(1, total // parts)
    return weights.where((F.col("n") > 1) & (F.col("bytes") > share)).select(
        "h", F.ceil(F.col("bytes") / share).cast("int").alias("pieces")), parts


def _ends(keep: str):
    """(order, aggregate) that put the identifier to keep first."""
    if keep == "largest":
        return lambda c: F.col(c).desc_nulls_last(), F.max
    return lambda c: F.col(c).asc_nulls_last(), F.min


def sorted_runs(rows: DataFrame, heavy: DataFrame, parts: int, keep: str) -> DataFrame:
    """Every row with its run, what the run keeps and its place in it. The only
    shuffle is the one by sampled splitters; the windows sort and compare inside it."""
    first, best = _ends(keep)
    piece = F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("pieces")))
    ranged = (rows.join(F.broadcast(heavy), "h", "left")  # at most one row per share
              .select("doc_id", "text", "head", "h", piece.cast("int").alias("piece"), F.col("pieces").isNotNull().alias("cut"))
              .repartitionByRange(parts, *_GROUP))
    beside = Window.partitionBy(*_GROUP).orderBy("text", first("doc_id"))
    starts = ranged.withColumn("starts", F.coalesce((F.lag("text").over(beside) != F.col("text")).cast("int"), F.lit(1)))
    runs = starts.select(
        "doc_id", *_GROUP, F.sum("starts").over(beside.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.sha2("text", 256).alias("text_sha256"), F.when(F.col("cut") & (F.col("starts") == 1), F.col("text")).alias("shown"))
    run = Window.partitionBy(*_GROUP, "run")
    return runs.select(*runs.columns, best("doc_id").over(run).alias("keep_id"), F.count("*").over(run).alias("group_size"),
                       F.row_number().over(run.orderBy(first("doc_id"))).alias("place"))


def exact_copies(docs: DataFrame, keep: str = "largest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    first, best = _ends(keep)
    rows = _keyed(docs, normalise)
    heavy, parts = _heavy(rows, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = saved(sorted_runs(rows, heavy, parts, keep), "sorted-texts")
    # Texts cut into pieces: their runs, one row each, meet on the whole text.
    same = Window.partitionBy("h", "shown")
    joined = runs.where("shown is not null").select(
        *_GROUP, "run", best("keep_id").over(same).alias("all_keep"), F.sum("group_size").over(same).alias("all_size"),
        (F.row_number().over(same.orderBy(first("keep_id"), "piece")) == 1).alias("ahead"))
    out = runs.join(bounded(joined, 4 * parts), [*_GROUP, "run"], "left")
    return out.select("doc_id", F.when(F.col("ahead").isNull(), F.col("keep_id")).otherwise(F.col("all_keep")).alias("keep_id"),
                      F.coalesce("all_size", "group_size").alias("group_size"),
                      ((F.col("place") == 1) & F.coalesce("ahead", F.lit(True))).alias("kept"), "text_sha256")
