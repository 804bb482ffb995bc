"""Whole runs composed from the operators: one incremental run (a micro-batch
over persisted state) and the flagship "new matched offers with score"."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.offers import valid_offers
from ..operators.scoring import score_band_col, score_offers
from ..operators.search import match_predicate
from ..operators.state import dedupe_batch, merge_history, new_offers, seen_urls, union_sources
from ..sources.history_log import HistoryLog

# The search of fixture profile 1 (FIXTURES.md 2.2), used by the flagship.
FLAGSHIP_GROUPS = [["the", "la", "de"], ["tion", "ing", "er"]]
FLAGSHIP_EXCLUDES = ["heed"]
FLAGSHIP_SKILLS = ["the", "and", "de", "pour", "python", "sql"]

OFFER_COLS = ["seq", "batch_id", "source_rank", "title", "company", "location", "job_url", "site",
              "description", "posted_at"]


@dataclass
class RunState:
    """State between runs: the merged current offers and the seen-URL ledger.

    forgetful=True reproduces the reference: the seen set is rebuilt from the
    merged offers, so a URL dropped by a dedupe pass is seen as new again.
    forgetful=False keeps an append-only ledger of every matched URL.
    """

    current: DataFrame
    seen: DataFrame
    forgetful: bool = True
    merged: bool = False  # current is the output of a merge (unique URLs and keys)


def initial_state(history: DataFrame, forgetful: bool = True) -> RunState:
    cur = history.select(*OFFER_COLS)
    return RunState(cur, seen_urls(cur), forgetful)


def incremental_run(batch: DataFrame, state: RunState, groups: Sequence[Sequence[str]],
                    excludes: Sequence[str], materialize: bool = False) -> tuple[DataFrame, RunState]:
    """validate -> title match -> drop seen URLs -> dedupe -> merge history.

    The returned state is lazy; materialise it before the next run
    (``fold_runs`` checkpoints it; ``run_on_log`` writes changes to a log), so that a
    chain of runs never grows one plan."""
    b = valid_offers(batch.select(*OFFER_COLS))
    matched = b.where(match_predicate("title", groups, excludes, "word"))
    fresh = dedupe_batch(new_offers(matched, state.seen))
    if materialize:
        # the run's new offers (batch-sized) are read by several joins of the
        # merge: compute them once, into the shared checkpoint folder
        fresh = fresh.checkpoint(eager=True)
    current = merge_history(state.current, fresh, history_is_merged=state.merged)
    if state.forgetful:
        seen = seen_urls(current)
    else:
        # the ledger records every matched URL of the run, also those the
        # in-batch dedupe dropped, so a rerun of the same batch finds nothing new
        seen = union_sources(state.seen, seen_urls(matched)).distinct()
    return fresh, RunState(current, seen, state.forgetful, merged=True)


def run_on_log(log: HistoryLog, batch: DataFrame, groups, excludes, forgetful: bool = True, **info) -> DataFrame:
    """One incremental run over a history log: the run's new offers. Writes what the
    batch changes; ``info`` is noted with the commit."""
    matched = valid_offers(batch.select(*OFFER_COLS)).where(match_predicate("title", groups, excludes, "word"))
    seen = seen_urls(log.read()) if forgetful else log.seen()
    fresh = dedupe_batch(new_offers(matched, seen)).checkpoint(eager=True)  # read by the merge and the caller
    ledger = None if forgetful else new_offers(seen_urls(matched), seen)
    log.append(fresh, ledger, **info)
    log.compact()
    return fresh


def fold_runs(batches: Sequence[DataFrame], state: RunState, groups, excludes,
              cut_every: int = 1) -> tuple[list[DataFrame], RunState]:
    """Apply incremental_run batch after batch. The plan of a fold grows with
    each run, so the state lineage is cut with a reliable checkpoint (shared
    checkpoint folder) every ``cut_every`` runs."""
    outs = []
    for i, b in enumerate(batches, 1):
        fresh, state = incremental_run(b, state, groups, excludes, materialize=True)
        outs.append(fresh)
        if cut_every and i % cut_every == 0 and i < len(batches):
            cur = state.current.checkpoint(eager=True)
            seen = seen_urls(cur) if state.forgetful else state.seen.checkpoint(eager=True)
            state = RunState(cur, seen, state.forgetful, merged=True)
    return outs, state


def flagship(offers: DataFrame) -> DataFrame:
    """New matched offers with score: batches 1-3 against the batch-0 history."""
    hist = offers.where(F.col("batch_id") == 0)
    batch = offers.where(F.col("batch_id") > 0)
    matched = valid_offers(batch).where(match_predicate("title", FLAGSHIP_GROUPS, FLAGSHIP_EXCLUDES, "word"))
    fresh = dedupe_batch(new_offers(matched, seen_urls(hist)))
    pairs = fresh.withColumn("skills", F.array(*[F.lit(s) for s in FLAGSHIP_SKILLS]))
    scored = score_offers(pairs)
    return scored.select(
        "seq", "job_url", "title", "company", "location",
        "match_score",
        F.array_join("missing_skills", ",").alias("missing_skills"),
        score_band_col("match_score").alias("band"),
    )
