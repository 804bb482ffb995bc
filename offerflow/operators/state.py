"""Arrival-ordered dedupe, history merge and the seen-URL check.

Rows carry their arrival order as data: ``(batch_id, source_rank, seq)``,
unique per row. Keep-first / keep-last per key is done in two levels so that
a hot key (one key holding a third of all rows) never lands in one task:

1. ``groupBy(key).agg(max(order))`` - partial aggregation combines map side,
   so a hot key costs one row per map task in the shuffle;
2. semi join of the rows with the winning (key, order) - the order is unique,
   so that shuffle is skew free.

Null keys form one group, as in pandas ``drop_duplicates``. Rows without an
order (an imported history) sort first and are never lost: both joins compare
nulls as equal. ``stamp_import`` gives imported rows an order of their own.
Join strategies are left to adaptive execution, which knows the sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_key

ORDER = ("batch_id", "source_rank", "seq")


def _cols(keys) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


#: Arrival numbers: batch ids and source ranks take these signed ranges, numbers any LONG.
BATCH_RANGE, SOURCE_RANGE = 1 << 52, 1 << 9


def arrival(batch: str = "batch_id", source: str = "source_rank", seq: str = "seq") -> Column:
    """(batch_id, source_rank, seq) as one DECIMAL(38) that orders alike, nulls first.

    A decimal is a fixed-width buffer, so its maximum is kept by a hash aggregate, where
    a struct's would be sorted. Ids outside the ranges are an error, never misplaced."""

    def part(c: str, half: int) -> Column:
        v = F.col(c).cast("long")
        return (F.when(v.isNull(), F.lit(-half)).when((v > -half) & (v < half), v)
                .otherwise(F.raise_error(F.concat(F.lit(f"{c} out of range: "), v.cast("string"))).cast("long")))

    pair = part(batch, BATCH_RANGE) * (2 * SOURCE_RANGE) + part(source, SOURCE_RANGE)
    number = F.coalesce(F.col(seq).cast("long"), F.lit(-(1 << 63)))
    wide = lambda c: c.cast("decimal(19,0)")
    return (wide(pair) * F.lit(1 << 62).cast("decimal(19,0)") * F.lit(4).cast("decimal(1,0)") + wide(number)).cast("decimal(38,0)")


def keep_one(df: DataFrame, keys: Sequence, keep: str = "last", order: Sequence[str] = ORDER) -> DataFrame:
    """One row per key: the last (or first) in arrival order."""
    o = arrival() if tuple(order) == ORDER else F.struct(*[F.col(c) for c in order])
    pick = F.max("_o") if keep == "last" else F.min("_o")
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(_cols(keys), names)], o.alias("_o"))
    winners = keyed.groupBy(*names).agg(pick.alias("_o"))
    return join_null_safe(keyed, winners, [*names, "_o"], "left_semi").drop(*names, "_o")


def stamp_import(history: DataFrame) -> DataFrame:
    """Arrival order for imported rows: before every run (batch -1), in file order."""
    return history.drop(*ORDER).select("*", F.lit(-1).cast("long").alias("batch_id"),
                                       F.lit(0).cast("long").alias("source_rank"),
                                       F.monotonically_increasing_id().alias("seq"))


def dedupe_keys(title: str = "title", company: str = "company", location: str = "location") -> list[Column]:
    """(lower+strip title, lower+strip company, raw location)."""
    return [norm_key(title), norm_key(company), F.col(location)]


def dedupe_batch(df: DataFrame, placeholder_companies: Sequence[str] | None = None,
                 scope: Sequence[str] = ()) -> DataFrame:
    """Keep the last row per (title, company, location) key; URL is no key.

    ``scope``: columns (such as the search) within which rows are repeats.

    ``placeholder_companies``: constant companies some sources write; when
    given, rows with such a company keep their own URL as extra key so that
    different employers are not merged.
    """
    keys = [*scope, *dedupe_keys()]
    if placeholder_companies:
        keys.append(F.when(F.col("company").isin(*placeholder_companies), F.col("job_url")))
    return keep_one(df, keys, "last")


def dedupe_url_first(df: DataFrame) -> DataFrame:
    return keep_one(df, ["job_url"], "first")


def dedupe_title_company_first(df: DataFrame) -> DataFrame:
    """Legacy second pass: first row per (lower+strip title, lower+strip company)."""
    return keep_one(df, [norm_key("title"), norm_key("company")], "first")


def dedupe_legacy(df: DataFrame) -> DataFrame:
    """Legacy two passes (URL first, then title+company first); they do not commute."""
    return dedupe_title_company_first(dedupe_url_first(df))


def union_sources(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; missing columns become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def join_null_safe(big: DataFrame, small: DataFrame, cols: Sequence[str], how: str, also=None,
                   more: Sequence[str] = ()) -> DataFrame:
    """Semi / anti join of big with small on cols, nulls comparing equal (as pandas keys do).

    ``also``: a further condition, given the small side with its columns ``more``."""
    s = small.select(*[F.col(c).alias(f"_s_{c}") for c in cols], *more)
    cond = None
    for c in cols:
        e = big[c].eqNullSafe(s[f"_s_{c}"])
        cond = e if cond is None else cond & e
    return big.join(s, cond & also(s) if also else cond, how)


_KEY_COLS = ["_key0", "_key1", "_key2"]


def _keyed(df: DataFrame) -> DataFrame:
    return df.select("*", *[k.alias(c) for k, c in zip(dedupe_keys(), _KEY_COLS)])


def merge_history(history: DataFrame, new: DataFrame, history_is_merged: bool = False,
                  scope: Sequence[str] = ()) -> DataFrame:
    """history ++ new, keep last per URL, then last per (title, company, location),
    each within the columns of ``scope`` (one history per search, say).

    With ``history_is_merged`` (the history is itself the output of a merge,
    so its URLs and its keys are unique) a history row that shares neither a
    URL nor a key with any new row cannot interact with anything and
    survives as is. Only the touched rows (found by semi joins against the
    batch-sized new side) go through the two passes together with the new
    rows. The history is scanned without any shuffle instead of being
    re-deduplicated whole every run; the rows are the same as the full form.
    """
    if not set(ORDER) <= set(history.columns):
        history = stamp_import(history)
    if not history_is_merged:
        return _both_passes(union_sources(history, new), scope)
    touched, untouched = _touched(history, new, scope)
    return union_sources(untouched, _both_passes(union_sources(touched, new), scope))


def _both_passes(rows: DataFrame, scope: Sequence[str]) -> DataFrame:
    return keep_one(keep_one(rows, [*scope, "job_url"], "last"), [*scope, *dedupe_keys()], "last")


def _touched(history: DataFrame, new: DataFrame, scope: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a merged history that share a URL or a key with a new row, and the others."""
    url_key, all_keys = [*scope, "job_url"], [*scope, *_KEY_COLS]
    hk, nk = _keyed(history), _keyed(new)
    urls, keys = nk.select(*url_key), nk.select(*all_keys)
    not_url = join_null_safe(hk, urls, url_key, "left_anti")
    untouched = join_null_safe(not_url, keys, all_keys, "left_anti")
    touched = union_sources(join_null_safe(hk, urls, url_key, "left_semi"),
                            join_null_safe(not_url, keys, all_keys, "left_semi"))
    return touched.drop(*_KEY_COLS), untouched.drop(*_KEY_COLS)


def merge_changes(history: DataFrame, new: DataFrame, scope: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """What merging ``new`` into a merged history changes: (rows added, whole; rows
    dropped, with the columns that decide).

    Only those columns are read of the history and shuffled: rows that are equal in
    them fare alike, so the batch's whole rows are picked by them at the end. What is
    decided is checkpointed, as it is small (the batch's size) and read once more."""
    decide = [*dict.fromkeys([*scope, *ORDER, "job_url", "title", "company", "location"])]
    touched, _ = _touched(history.select(*decide), new.select(*decide), scope)
    both = union_sources(touched.withColumn("_new", F.lit(False)),
                         new.select(*decide).withColumn("_new", F.lit(True))).checkpoint(eager=True)
    kept = _both_passes(both, scope).checkpoint(eager=True)
    dropped = join_null_safe(both.where("not _new"), kept.where("not _new"), ORDER, "left_anti")
    return join_null_safe(new, kept.where("_new"), decide, "left_semi"), dropped.drop("_new")


def append_history(history: DataFrame, new: DataFrame) -> DataFrame:
    return union_sources(history, new)


def seen_urls(history: DataFrame, url: str = "job_url", scope: Sequence[str] = ()) -> DataFrame:
    return history.select(*scope, F.col(url).alias("job_url")).where(F.col("job_url").isNotNull()).distinct()


# Rows with a null URL never match the seen set. In a shuffle join they would
# all hash into one partition, so the join key gives each of them its own
# value: NUL + a hash of the row (a URL never holds NUL, so no false match).

def _url_key(df: DataFrame) -> Column:
    u = F.col("job_url")
    return F.when(u.isNull(), F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(c) for c in df.columns]).cast("string"))
                  ).otherwise(u)


def _seen_keys(seen: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return seen.select(*scope, F.col("job_url").alias("_url_key")).where(F.col("_url_key").isNotNull())


def new_offers(offers: DataFrame, seen: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Offers whose URL is not in the seen set (anti join; a null URL stays),
    with ``scope`` not in the seen set of the same search."""
    keyed = offers.withColumn("_url_key", _url_key(offers))
    return keyed.join(_seen_keys(seen, scope), [*scope, "_url_key"], "left_anti").drop("_url_key")


def known_offers(offers: DataFrame, seen: DataFrame) -> DataFrame:
    has = offers.where(F.col("job_url").isNotNull())
    return has.join(seen.select("job_url"), "job_url", "left_semi")


def with_seen_flag(offers: DataFrame, seen: DataFrame) -> DataFrame:
    """Adds ``is_seen`` in one pass (for counters), instead of anti + semi."""
    s = _seen_keys(seen).distinct().withColumn("is_seen", F.lit(True))
    keyed = offers.withColumn("_url_key", _url_key(offers))
    out = keyed.join(s, "_url_key", "left").drop("_url_key")
    return out.withColumn("is_seen", F.coalesce(F.col("is_seen"), F.lit(False)))


def first_seen_in_batch(offers: DataFrame, seen: DataFrame, filter_history: bool = True) -> DataFrame:
    """Legacy stateful loop: URL not in history and not earlier in the batch."""
    base = new_offers(offers, seen) if filter_history else offers
    return dedupe_url_first(base)


def distinct_candidates(cards: DataFrame) -> DataFrame:
    return cards.dropDuplicates(["title", "job_url"])
