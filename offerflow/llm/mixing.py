"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) by tokens. The cell
weights are raked: scaled to the target of each source, then each language,
then each topic, and again, until the largest relative error of a marginal is at most
``TOLERANCE``. Targets that the occurring cells cannot meet end the sweeps when
the error no longer falls; the error that is left is logged as a warning. Where ``targets`` gives
none for a dimension, a share is the observed token share to a power (below 1
lifts rare values), normalised. A document's probability is its cell's raked
weight per token, scaled so that the largest is 1: expected tokens then meet
the marginals, and no document is taken twice. The draw is a hash of the id, so
it is the same on every run and partitioning.

Only narrow rows are shuffled; cell counts combine before the shuffle, so one
source with a third of all rows is one row per task. Up to ``LOCAL_CELLS`` cells are
raked in the driver; more are Spark tables, joined with their factors on their
keys.

Defined results: null sources, languages and topics are a value of their own;
documents without tokens weigh nothing and have their cell's probability (1 in
a cell without tokens); null ids draw as id -1; targets for values that do not
occur are left out and the rest normalised; an empty table gives no rows.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerflow.llm.common import few_files, saved, unused

log = logging.getLogger(__name__)

DIMENSIONS = ("source", "lang", "topic")
POWER = 0.7
#: Sweeps at least.
SWEEPS = 8
#: Largest relative error of a marginal that counts as met.
TOLERANCE = 1e-6
#: Sweeps in which the error must fall by a hundredth, or the targets count as out of reach.
PATIENCE = 100
#: Cells that are raked in the driver, at most (some 20 MB).
LOCAL_CELLS = 100_000
#: Stands for null in cells and targets.
NONE = "(none)"


def n_tokens(text="text"):
    """Column: words of a text (runs of characters other than ASCII white space)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def with_topics(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """Documents with a topic: the label of the vector with their id, if any."""
    one = topics.groupBy(F.col("vec_id").alias("doc_id")).agg(F.min("label").cast("string").alias("topic"))
    return docs.join(one, "doc_id", "left")


def counted(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) with NONE for null values."""
    rows = docs.select("doc_id", "source", "lang", n_tokens().alias("tokens"))
    return with_topics(rows, topics).select("doc_id", *(
        F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in DIMENSIONS), "tokens")


def target_shares(cells: DataFrame, dimension: str, targets: dict[str, float] | None, power: float) -> DataFrame:
    """(value, share) of a dimension, shares adding to 1 over the values that occur."""
    seen = cells.groupBy(dimension).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    if targets is None:
        raw = seen.select(dimension, F.pow(F.col("tokens").cast("double"), F.lit(power)).alias("raw"))
    else:
        wanted = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], f"{dimension} string, raw double")
        raw = seen.join(wanted, dimension).select(dimension, "raw")
    raw = saved(raw, "raw-share")
    total = raw.agg(F.sum("raw")).first()[0]  # one number
    return raw.select(dimension, (F.col("raw") / F.lit(total)).alias("share"))


def settled(errors: list[float], least: int) -> bool:
    """Whether the sweeps with these largest relative errors were enough."""
    if len(errors) < least:
        return False
    return errors[-1] <= TOLERANCE or (len(errors) > PATIENCE and not errors[-1] < 0.99 * errors[-1 - PATIENCE])


def rake_here(now: pa.Table, least: int) -> tuple[pa.Table, list[float]]:
    """``now`` with raked weights, and the largest relative error after each sweep."""
    now = now.sort_by([(d, "ascending") for d in DIMENSIONS])
    weight = now["weight"].to_numpy().copy()
    places, shares = [], []
    for d in DIMENSIONS:
        values, first, place = np.unique(np.array(now[d].to_pylist(), object), return_index=True, return_inverse=True)
        places.append((place, len(values)))
        shares.append(now[f"share_{d}"].to_numpy()[first])

    def factors(d):
        return shares[d] / np.bincount(places[d][0], weight, places[d][1])

    errors: list[float] = []
    with np.errstate(all="ignore"):
        while len(weight) and not settled(errors, least):
            for d in range(len(DIMENSIONS)):
                weight = weight * factors(d)[places[d][0]]
            errors.append(float(max(np.abs(1 / factors(d) - 1).max() for d in range(len(DIMENSIONS)))))
    return now.set_column(now.column_names.index("weight"), "weight", pa.array(weight)), errors


def rake_tables(now: DataFrame, least: int) -> tuple[DataFrame, list[float]]:
    """The same over Spark tables, one aggregate per sweep for the error."""
    errors: list[float] = []
    while not settled(errors, least):
        for d in DIMENSIONS:
            sums = now.groupBy(d).agg(F.sum("weight").alias("sum"))
            now = now.join(sums, d).withColumn("weight", F.col("weight") * F.col(f"share_{d}") / F.col("sum")).drop("sum")
        now = saved(now, "raked")  # the plan stays one sweep deep
        off = F.abs(F.col("sum") / F.col("share") - 1)
        sides = now.select(F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col(d).alias("v"), F.col(f"share_{d}").alias("share"))
                                               for d in DIMENSIONS))).alias("side"), "weight")
        sums = sides.groupBy("side.d", "side.v").agg(F.sum("weight").alias("sum"), F.max("side.share").alias("share"))
        errors.append(sums.agg(F.max(off)).first()[0])  # one number
    return now, errors


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER,
         sweeps: int = SWEEPS, local_cells: int = LOCAL_CELLS) -> tuple[DataFrame, list[float]]:
    """(source, lang, topic, tokens, weight): weights adding to 1 whose marginals
    are the targets, as far as the cells that occur allow; and the largest
    relative error of a marginal after each sweep. ``sweeps`` are made at least."""
    now = cells.where("tokens > 0")
    for d in DIMENSIONS:
        now = now.join(target_shares(cells, d, (targets or {}).get(d), power).withColumnRenamed("share", f"share_{d}"), d)
    now = saved(now.withColumn("weight", F.col("tokens").cast("double")), "raked")
    n = now.count()
    if n <= local_cells:
        table, errors = rake_here(now.toArrow(), sweeps)
        now = saved(cells.sparkSession.createDataFrame(table), "raked") if n else now
    else:
        now, errors = rake_tables(now, sweeps)
    if errors and not errors[-1] <= TOLERANCE:
        log.warning("raking: targets out of reach, marginals off by up to %.3g after %d sweeps", errors[-1], len(errors))
    else:
        log.info("raking: %d sweeps, marginals off by up to %.3g", len(errors), errors[-1] if errors else 0.0)
    return now.select(*DIMENSIONS, "tokens", "weight"), errors


def mixture(docs: DataFrame, topics: DataFrame, targets: dict[str, dict[str, float]] | None = None,
            power: float = POWER, sweeps: int = SWEEPS) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, selected) of every document."""
    rows = saved(counted(docs, topics), "counted")
    cells = saved(few_files(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), rows.count()), "mix-cells")
    raked = rake(cells, targets, power, sweeps)[0].withColumn("ratio", F.col("weight") / F.col("tokens"))
    top = raked.agg(F.max("ratio")).first()[0]  # one number
    rates = raked.select(*DIMENSIONS, F.round(F.col("ratio") / F.lit(top), 9).alias("rate"))
    # Every occurring cell has a rate; one that targets leave out has 0, one without tokens 1.
    rates = cells.join(rates, list(DIMENSIONS), "left").select(
        *DIMENSIONS, F.coalesce("rate", F.when(F.col("tokens") > 0, 0.0).otherwise(1.0)).alias("probability"))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string").cast("binary")), 1, 8), 16, 10).cast("double")
    return rows.join(rates, list(DIMENSIONS)).select(
        "doc_id", *DIMENSIONS, "tokens", "probability", (draw / float(1 << 32) < F.col("probability")).alias("selected"))


def sampled(docs: DataFrame, topics: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The drawn documents, all columns. Rows that share an id and a cell draw alike."""
    i, s, lang, n = unused(docs, "gone_id", "gone_source", "gone_lang", "gone_tokens")
    gone = mixture(docs, topics, targets).where("not selected").select(
        F.coalesce("doc_id", F.lit(-1)).alias(i), F.col("source").alias(s), F.col("lang").alias(lang), F.col("tokens").alias(n)).distinct()
    same = ((F.coalesce(docs["doc_id"], F.lit(-1)) == F.col(i)) & (F.coalesce(docs["source"], F.lit(NONE)) == F.col(s))
            & (F.coalesce(docs["lang"], F.lit(NONE)) == F.col(lang)))
    return docs.join(gone, same, "left_anti")
