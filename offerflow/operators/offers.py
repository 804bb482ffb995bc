"""Row-level offer operators: contract check, defaults, freshness, place,
description guards and the per-source newest-first limit. All are column
expressions (no shuffle) except :func:`newest_per_site`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip, n_cut, py_strip
from .pages import GUEST_TEXT, NO_TEXT, WALL_TEXT

REQUIRED = ("title", "company", "location", "job_url", "site")
URL_RE = r"^https?://[^/?#]+"
MAX_URL = 2083

# Defaults for a missing column (current generation).
DEFAULTS = {"title": "Unknown", "company": "Unknown", "site": "JobSpy"}

# The stored text of a listing without sign-in, and how error texts start.
GUEST_LISTING_TEXT = "Guest Mode - opis niedostępny bez logowania"
ERROR_PREFIX = "Błąd:"


def reject_reason_col() -> Column:
    """First failed rule of the offer contract, null when the row is valid."""
    expr = None
    for c in REQUIRED:
        cond = F.col(c).isNull()
        reason = F.lit(f"missing_{c}")
        expr = F.when(cond, reason) if expr is None else expr.when(cond, reason)
    expr = expr.when(~F.col("job_url").rlike(URL_RE), F.lit("bad_url"))
    expr = expr.when(F.length("job_url") > MAX_URL, F.lit("url_too_long"))
    return expr


def validate_offers(df: DataFrame) -> DataFrame:
    """Adds ``reject_reason``; a bad row never costs its neighbours."""
    return df.withColumn("reject_reason", reject_reason_col())


def valid_offers(df: DataFrame) -> DataFrame:
    return df.where(reject_reason_col().isNull())


def rejected_offers(df: DataFrame) -> DataFrame:
    return validate_offers(df).where(F.col("reject_reason").isNotNull())


def offer_defaults(df: DataFrame, search_location: str | Column, null_is_missing: bool = True) -> DataFrame:
    """Missing column -> default; with ``null_is_missing`` a null value too."""
    loc = F.lit(search_location) if isinstance(search_location, str) else search_location
    defaults = dict(DEFAULTS, location=loc)
    out = df
    for c, d in defaults.items():
        dv = d if isinstance(d, Column) else F.lit(d)
        if c not in df.columns:
            out = out.withColumn(c, dv)
        elif null_is_missing:
            out = out.withColumn(c, F.coalesce(F.col(c), dv))
    return out


def fresh_only(df: DataFrame, ref_ts: str, max_days_old: int | Column, ts: str = "posted_ts") -> DataFrame:
    """At most 24 * max_days_old hours old at ``ref_ts`` (a parameter)."""
    days = max_days_old if isinstance(max_days_old, Column) else F.lit(int(max_days_old))
    hours = (days * 24).cast("int")
    lower = F.lit(ref_ts).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), hours)
    return df.where(F.col(ts) >= lower)


def place_filter(df: DataFrame, location: str, remote_only: bool, mode: str = "current") -> DataFrame:
    """current: remote_only picks remote offers, else offers at the place.
    local_plus_remote (legacy): offers at the place, plus remote ones when set."""
    at_place = F.col("location") == F.lit(location)
    remote = F.coalesce(F.col("is_remote"), F.lit(False))
    if mode == "local_plus_remote":
        cond = (at_place | remote) if remote_only else at_place
    else:
        cond = remote if remote_only else at_place
    return df.where(cond)


def place_label_col(location: str | Column = "location") -> Column:
    loc = F.col(location) if isinstance(location, str) else location
    return F.when(F.coalesce(F.col("is_remote"), F.lit(False)), F.lit("Remote")).otherwise(loc)


def has_description(df: DataFrame) -> DataFrame:
    return df.where(F.length("description") > 0)


def clip_description(df: DataFrame, n: int = 8000) -> DataFrame:
    return df.withColumn("n_cut", n_cut("description", n)).withColumn("description", clip("description", n))


def newest_per_site(df: DataFrame, n: int = 50, part=("profile_id", "site")) -> DataFrame:
    """At most n newest offers per (search, site). Plans as a WindowGroupLimit,
    which cuts each group to n rows map side before the shuffle, so a hot
    group never reaches one task whole."""
    order = [F.col("posted_ts").desc_nulls_last(), F.col("job_url")]
    if "seq" in df.columns:
        order.append(F.col("seq"))  # arrival order breaks remaining ties
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def description_status_col(desc: str = "description") -> Column:
    """``missing`` (null, blank, or the text for a page without one), ``signin_wall``,
    ``guest_mode``, ``error`` (any other text that starts as error texts do), else ``ok``.

    Only whole stored texts count: an offer that speaks of errors or of signing in is ok."""
    d = py_strip(F.col(desc))
    head, tail = NO_TEXT.split("{site}")
    return (F.when(d.isNull() | (d == ""), F.lit("missing"))
            .when(d.rlike(f"^{head}[^\\n]*{tail.replace('.', '[.]')}$"), F.lit("missing"))
            .when(d == WALL_TEXT, F.lit("signin_wall"))
            .when(d.isin(GUEST_TEXT, GUEST_LISTING_TEXT), F.lit("guest_mode"))
            .when(d.startswith(ERROR_PREFIX), F.lit("error"))
            .otherwise(F.lit("ok")))


def description_status(df: DataFrame, desc: str = "description") -> DataFrame:
    """``status`` column; description kept only when status is ok."""
    st = description_status_col(desc)
    return df.withColumn("status", st).withColumn(
        desc, F.when(F.col("status") == "ok", F.col(desc)))


def place_and_age(pairs: DataFrame, ref_ts: str) -> DataFrame:
    """Pairs of an offer and a search that meet the search's own place and age.

    Needs the search's columns as ``search_location``, ``remote_only`` and
    ``max_days_old``. A search for remote work takes remote offers, any other the
    offers at its place; no place is anywhere, no age limit is any age. An offer
    without a date passes no age limit."""
    remote = F.coalesce(F.col("is_remote"), F.lit(False))
    place = F.coalesce(F.col("search_location"), F.lit(""))
    here = F.when(F.coalesce(F.col("remote_only"), F.lit(False)), remote).otherwise(
        (place == "") | (F.col("location") == place))
    oldest = F.lit(ref_ts).cast("timestamp_ntz") - F.make_dt_interval(F.col("max_days_old"))
    young = F.col("max_days_old").isNull() | F.coalesce(F.col("posted_ts") >= oldest, F.lit(False))
    return pairs.where(here & young)


def with_posted_ts(df: DataFrame) -> DataFrame:
    """``posted_ts`` from the text ``posted_at`` (null where it is no date)."""
    return df.withColumn("posted_ts", F.expr("try_cast(posted_at AS timestamp_ntz)"))
