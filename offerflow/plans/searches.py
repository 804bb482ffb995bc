"""One run over a whole table of saved searches, batch after batch.

Per search: valid offers whose title matches, at the search's place and age, of
an address that this search has not seen; repeats dropped; the search's history
merged; what is new and has a description scored. The history of all searches is
one table scoped by ``profile_id``. It holds narrow rows (no descriptions): the
offer's text joins the few new pairs from the batch only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.attempts import due, outcomes, with_text_id
from ..operators.offers import place_and_age, rejected_offers, valid_offers
from ..operators.scoring import ScorerFn, dead_letter, score_offers, scored_ok, to_result
from ..operators.search import compiled_profiles, match_profiles
from ..operators.state import dedupe_batch, merge_history, new_offers, seen_urls
from ..sources.attempt_log import AttemptLog

SCOPE = ["profile_id"]
STATE_COLS = ["profile_id", "seq", "batch_id", "source_rank", "title", "company", "location", "job_url"]
#: What a scorer reads beside the pair: the offer's text, the search's CV and skills.
WIDE = ["description", "cv_text", "skills", "prompt"]


@dataclass
class SearchRun:
    """What one run gives: refused offers, new pairs, verdicts, failures (with the offer's
    text), and the state after it."""

    rejects: DataFrame
    fresh: DataFrame
    results: DataFrame
    failed: DataFrame
    current: DataFrame


def wanted_pairs(offers: DataFrame, searches: DataFrame, ref_ts: str) -> DataFrame:
    """(search, offer) rows of STATE_COLS: title, place and age of the search are met."""
    pairs = match_profiles(offers, compiled_profiles(searches))
    limits = searches.select("profile_id", F.col("location").alias("search_location"), "remote_only", "max_days_old")
    narrow = offers.select(*[c for c in STATE_COLS if c != "profile_id"], "is_remote", "posted_ts")
    return place_and_age(pairs.join(limits, "profile_id").join(narrow, "seq"), ref_ts).select(*STATE_COLS)


def run_searches(batch: DataFrame, current: DataFrame, searches: DataFrame, resumes: DataFrame, ref_ts: str,
                 history_is_merged: bool = True, scorer: ScorerFn | None = None, attempts: AttemptLog | None = None,
                 max_attempts: int | None = None) -> SearchRun:
    """One batch of offers against every saved search.

    ``current`` holds STATE_COLS. The new pairs and the scored rows are
    checkpointed, as several readers follow and a scorer may cost money or answer
    anew each time; the returned state is lazy. Pairs carry their text's digest: the
    texts join in front of the scorer, each shuffled once, and are stored with no pair.
    Failures get theirs back when they are read. With ``attempts``, pairs whose
    scoring failed or that had no description are due again, and pairs that are
    scored never are; the run's outcomes are committed to it."""
    good = with_text_id(valid_offers(batch))
    pairs = wanted_pairs(good, searches, ref_ts)
    fresh = dedupe_batch(new_offers(pairs, seen_urls(current, scope=SCOPE), SCOPE), scope=SCOPE).checkpoint(eager=True)
    after = merge_history(current, fresh, history_is_merged, SCOPE).select(*STATE_COLS)
    texts = good.where("text_id is not null").select("text_id", "description")
    if attempts is None:
        todo = fresh.join(good.where("text_id is not null").select("seq", "text_id", "description"), "seq")
        with_text = todo
    else:
        todo = due(fresh.join(good.select("seq", "text_id"), "seq"), attempts.pairs(), good, max_attempts).checkpoint(eager=True)
        texts = texts.unionByName(attempts.texts())
        with_text = todo.join(_texts_of(texts, todo), "text_id")
    scored = score_offers(with_text.join(resumes.select("profile_id", "cv_text"), "profile_id")
                          .join(searches.select("profile_id", "skills"), "profile_id"), scorer)
    scored = scored.drop(*[c for c in WIDE if c in scored.columns]).checkpoint(eager=True)
    if attempts is not None:
        attempts.upsert(outcomes(todo, scored), texts)
    failed = dead_letter(scored)
    return SearchRun(rejected_offers(batch), fresh, to_result(scored_ok(scored)), failed.join(_texts_of(texts, failed), "text_id"), after)


def _texts_of(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(text_id, description), once each, of the texts that pairs name."""
    return texts.join(pairs.select("text_id").distinct(), "text_id", "left_semi").dropDuplicates(["text_id"])


def fold_searches(batches: Sequence[DataFrame], current: DataFrame, searches: DataFrame, resumes: DataFrame,
                  ref_ts: str, scorer: ScorerFn | None = None, attempts: AttemptLog | None = None,
                  max_attempts: int | None = None) -> list[SearchRun]:
    """Batch after batch; the state is checkpointed between runs. ``current`` may be
    any history: the first run merges it whole."""
    current = current.select(*STATE_COLS).checkpoint(eager=True)  # read by the seen check and the merge
    runs = []
    for batch in batches:
        run = run_searches(batch, current, searches, resumes, ref_ts, bool(runs), scorer, attempts, max_attempts)
        run.current = current = run.current.checkpoint(eager=True)
        runs.append(run)
    return runs
