"""Attempts at scoring: what is due in a run, and what came of it.

One row per (search, address): ``scored`` (never due again), ``failed`` (the scorer
raised or gave no score) or ``waiting`` (no description yet, or no CV). Failed and
waiting rows keep the offer and the digest of the text that is known of it (``text_id``), and are due in every
run until they are scored, or ``max_attempts`` times. A description that comes with
a later batch for the same address counts, although the offer itself is no longer
new then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import ORDER, join_null_safe, keep_one, new_offers

KEY = ["profile_id", "job_url"]
OFFER = [*ORDER, "title", "company", "location"]


def with_text_id(offers: DataFrame) -> DataFrame:
    """``text_id``: the description's digest, null for an empty one. Many pairs share a
    text, so they carry its digest through joins, and the text joins last."""
    return offers.withColumn("text_id", F.when(F.length("description") > 0, F.sha2("description", 256)))


def due(fresh: DataFrame, attempts: DataFrame, batch: DataFrame, max_attempts: int | None = None) -> DataFrame:
    """KEY, OFFER, ``text_id`` and ``attempts`` so far of all pairs that are due.

    ``fresh``: the run's new pairs (KEY, OFFER, text_id; the last one of an address counts);
    ``attempts``: the table so far; ``batch``: the run's valid offers with ``text_id``."""
    done = attempts.where("status = 'scored'").select(*KEY)
    pending = attempts.where("status <> 'scored'")
    if max_attempts is not None:
        spent = pending.where(F.col("attempts") >= max_attempts).select(*KEY)
        done, pending = done.unionByName(spent), pending.where(F.col("attempts") < max_attempts)
    now = new_offers(keep_one(fresh.select(*KEY, *OFFER, "text_id"), KEY), done, ["profile_id"])
    tried = pending.select(*KEY, F.col("attempts").alias("_tried"), F.col("text_id").alias("_text"))
    both = now.join(tried, KEY, "left").select(
        *KEY, *OFFER, "text_id", F.coalesce("_tried", F.lit(0)).alias("attempts"), "_text")
    again = join_null_safe(pending, now, KEY, "left_anti").select(
        *KEY, *OFFER, F.lit(None).cast("string").alias("text_id"), "attempts", F.col("text_id").alias("_text"))
    every = both.unionByName(again)
    # the newest text of the batch for an address that has none of its own
    lacking = every.where("text_id is null").select("job_url").distinct()
    texts = batch.where("text_id is not null").select(*ORDER, "job_url", "text_id").join(lacking, "job_url", "left_semi")
    late = keep_one(texts, ["job_url"]).select("job_url", F.col("text_id").alias("_late"))
    return every.join(late, "job_url", "left").select(
        *KEY, *OFFER, F.coalesce("text_id", "_late", "_text").alias("text_id"), "attempts")


def outcomes(todo: DataFrame, scored: DataFrame) -> DataFrame:
    """The table's new rows of all that was due. ``scored``: KEY, match_score and error of what was tried."""
    tried = scored.select(*KEY, F.lit(True).alias("_tried"), F.col("match_score").alias("_score"),
                          F.coalesce("error", F.when(F.col("match_score").isNull(), F.lit("no_score"))).alias("_error"))
    rows = todo.join(tried, KEY, "left")
    status = F.when(F.col("_tried").isNull(), F.lit("waiting")).when(F.col("_error").isNull(), F.lit("scored")).otherwise(F.lit("failed"))
    why = F.when(F.col("_tried").isNotNull(), F.col("_error")).when(
        F.col("text_id").isNull(), F.lit("no_description")).otherwise(F.lit("no_cv"))
    return rows.select(
        *KEY, status.alias("status"), (F.col("attempts") + F.col("_tried").isNotNull().cast("int")).alias("attempts"),
        why.alias("last_error"), *OFFER,
        # a scored pair is never due again: its text is not kept
        F.when(status != "scored", F.col("text_id")).alias("text_id"))


def from_results(results: DataFrame) -> DataFrame:
    """Stored results (profile_id, url) as rows of the table: already scored."""
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    return results.where(F.col("url").isNotNull()).select("profile_id", F.col("url").alias("job_url")).distinct().select(
        *KEY, F.lit("scored").alias("status"), F.lit(1).alias("attempts"), none("last_error", "string"),
        *[none(c, "long") for c in ORDER], *[none(c, "string") for c in OFFER if c not in ORDER], none("text_id", "string"))

