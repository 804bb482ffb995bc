"""Registered queries (one per operator of SURVEY section 2) and their
DuckDB oracles. Each query takes (spark, sf_dir) and reads the driver tables
in full; each oracle is plain SQL over the same raw tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import offers as ofr
from ..operators import report as rpt
from ..operators import scoring as sc
from ..operators import search as se
from ..operators import state as st
from ..sources import fixtures as fx
from ..sources import site_pages as sp
from . import oracle_sql as O
from .pipeline import FLAGSHIP_EXCLUDES, FLAGSHIP_GROUPS, flagship, fold_runs, initial_state

# The addresses, markers, texts and numbers inside the SQL below are fixed values
# too: they state by themselves what the library's tables of fixed values must give.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# shared SQL pieces
# ---------------------------------------------------------------------------

P1_MATCH = (
    "(title IS NOT NULL AND NOT contains(lower(title), 'heed')"
    f" AND regexp_matches(lower(title), {O.word_re_sql(['the', 'la', 'de'])})"
    f" AND (contains(lower(title), 'tion') OR regexp_matches(lower(title), {O.word_re_sql(['ing', 'er'])})))"
)
P1_SUBSTR = ("(title IS NOT NULL AND NOT contains(lower(title), 'heed')"
             " AND (contains(lower(title), 'the') OR contains(lower(title), 'la') OR contains(lower(title), 'de'))"
             " AND (contains(lower(title), 'tion') OR contains(lower(title), 'ing') OR contains(lower(title), 'er')))")
VALID = ("(title IS NOT NULL AND company IS NOT NULL AND location IS NOT NULL AND job_url IS NOT NULL"
         " AND site IS NOT NULL AND regexp_matches(job_url, '^https?://[^/?#]+') AND length(job_url) <= 2083)")
HIST_URLS = "hist AS (SELECT DISTINCT job_url FROM offers WHERE batch_id = 0 AND job_url IS NOT NULL)"
NEWB = "newb AS (SELECT * FROM offers WHERE batch_id > 0)"
FLAG_SKILLS = O._list(["the", "and", "de", "pour", "python", "sql"])

# Each title is lower-cased and cut into words once; a short keyword of word characters is a member of that list.
MATCHED_PAIRS = (
    "titles AS MATERIALIZED (SELECT seq, lower(title) AS lt, "
    f"list_distinct(regexp_split_to_array(lower(title), '{O.NOT_WORD}+')) AS words FROM offers WHERE title IS NOT NULL),\n"
    "pairs AS MATERIALIZED (SELECT c.profile_id, o.seq FROM titles o, compiled c WHERE "
    "NOT coalesce(list_bool_or(list_transform(c.excludes, lambda e: contains(o.lt, e))), false) "
    "AND coalesce(list_bool_and(list_transform(c.groups, lambda g: coalesce(list_bool_or(list_transform(g, lambda kw: "
    "CASE WHEN length(kw) <= 3 THEN list_contains(o.words, kw) ELSE contains(o.lt, kw) END)), false))), true))"
)


def _score_sql(desc: str, skills: str) -> tuple[str, str, str]:
    d = f"lower({desc})"
    hits = f"len(list_filter({skills}, lambda s: contains({d}, lower(s))))"
    n = f"len({skills})"
    score = f"CAST(CASE WHEN {n} = 0 THEN 0 ELSE ({hits} * 200 + {n}) // ({n} * 2) END AS INTEGER)"
    missing = f"array_to_string(list_filter({skills}, lambda s: NOT contains({d}, lower(s))), ',')"
    advice = (f"CASE WHEN {score} >= 70 THEN 'Strong fit: apply.' WHEN {score} >= 45 THEN "
              f"'Partial fit: close the missing skills first.' ELSE 'Weak fit: skip unless the role interests you.' END")
    return score, missing, advice


def _band_sql(score: str) -> str:
    return (f"CASE WHEN {score} >= 70 THEN 'green' WHEN {score} >= 45 THEN 'yellow' "
            f"WHEN {score} IS NOT NULL THEN 'red' END")


def offers_df(spark, sf):
    return fx.offers(spark, sf)


def _p1(df):
    return df.where(se.match_predicate("title", FLAGSHIP_GROUPS, FLAGSHIP_EXCLUDES, "word"))


# ---------------------------------------------------------------------------
# flagship
# ---------------------------------------------------------------------------

_fs_score, _fs_missing, _ = _score_sql("description", FLAG_SKILLS)
register("flagship", O.with_(O.OFFERS, HIST_URLS,
         f"m AS (SELECT * FROM offers WHERE batch_id > 0 AND {VALID} AND {P1_MATCH}"
         " AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.job_url = offers.job_url))",
         f"d AS {O.keep_last_sql('m', O.DEDUPE_KEYS)}") + f"""
SELECT seq, job_url, title, company, location, {_fs_score} AS match_score,
       {_fs_missing} AS missing_skills, {_band_sql(_fs_score)} AS band
FROM d WHERE length(description) > 0""")(lambda spark, sf: flagship(offers_df(spark, sf)))


# ---------------------------------------------------------------------------
# 2.2 projections, filters, predicates
# ---------------------------------------------------------------------------

@register("match_words", O.with_(O.OFFERS) + f"SELECT seq, job_url, title FROM offers WHERE {P1_MATCH}")
def q_match_words(spark, sf):
    return se.match_words(offers_df(spark, sf), FLAGSHIP_GROUPS, FLAGSHIP_EXCLUDES).select("seq", "job_url", "title")


@register("match_substring", O.with_(O.OFFERS) + f"SELECT seq, title FROM offers WHERE {P1_SUBSTR}")
def q_match_substring(spark, sf):
    return se.match_substring(offers_df(spark, sf), FLAGSHIP_GROUPS, FLAGSHIP_EXCLUDES).select("seq", "title")


@register("build_search", O.with_(O.PROFILES) + """
SELECT profile_id, """ + O.strip_sql(
    "'(' || array_to_string(list_transform(job_titles, lambda x: '\"' || x || '\"'), ' OR ') || ')'"
    " || CASE WHEN len(experience_levels) > 0 THEN ' AND (' || array_to_string(list_transform("
    "experience_levels, lambda x: '\"' || x || '\"'), ' OR ') || ')' ELSE '' END"
    " || CASE WHEN len(exclude_keywords) > 0 THEN ' ' || array_to_string(list_transform("
    "exclude_keywords, lambda x: '-' || x), ' ') ELSE '' END") + " AS search_text FROM profiles")
def q_build_search(spark, sf):
    return se.build_search(fx.profiles(spark, sf)).select("profile_id", "search_text")


_W = r"[\p{L}\p{N}_]"
_COMPILE_SQL = f"""
SELECT profile_id,
  array_to_string(list_transform(groups, lambda g: array_to_string(g, ',')), '|') AS groups_txt,
  array_to_string(excludes, ',') AS excludes_txt
FROM (
  SELECT profile_id,
    list_transform(regexp_extract_all(search_text, '-({_W}+)', 1), lambda x: lower(x)) AS excludes,
    CASE WHEN len(regexp_extract_all(search_text, '\\((.*?)\\)', 1)) > 0 THEN
      list_transform(regexp_extract_all(search_text, '\\((.*?)\\)', 1), lambda g:
        list_transform(string_split(g, ' OR '), lambda k:
          lower(replace(replace({O.strip_sql('k')}, '"', ''), '''', ''))))
    ELSE list_filter([list_transform(list_filter(string_split_regex({O.strip_sql(
        f"regexp_replace(search_text, '-({_W}+)', '', 'g')")}, '{tx.PY_SPACE}+'),
        lambda w: w NOT IN ('AND', 'OR', '(', ')', '')), lambda w: lower(w))], lambda g: len(g) > 0)
    END AS groups
  FROM (SELECT profile_id, search_text FROM ({ORACLES['build_search'].replace('WITH ', 'WITH ', 1)})))
"""


@register("compile_search", _COMPILE_SQL)
def q_compile_search(spark, sf):
    c = se.compile_search(se.build_search(fx.profiles(spark, sf)))
    return c.select(
        "profile_id",
        F.array_join(F.transform("groups", lambda g: F.array_join(g, ",")), "|").alias("groups_txt"),
        F.array_join("excludes", ",").alias("excludes_txt"),
    )


@register("seniority_flag", O.with_(O.LEVELLED, O.COMPILED) + """
SELECT profile_id, coalesce(list_has_any(flatten(groups), """ + O._list(se.JUNIOR_WORDS_CURRENT) +
          """), false) AS is_junior FROM compiled""")
def q_seniority(spark, sf):
    return se.seniority_flag(se.compiled_profiles(fx.levelled_profiles(spark, sf))).select("profile_id", "is_junior")


def _linked_pages(spark, sf):
    """The crawled pages and the derived listing pages of the six sites."""
    cols = ["page_id", "url", "html"]
    return fx.table(spark, sf, "pages").select(*cols).unionByName(sp.listing_pages(spark, sf).select(*cols))


def _page_links_df(spark, sf):
    from ..operators.pages import page_links
    return page_links(_linked_pages(spark, sf))


# Crawled pages: their markup holds plain double-quoted links. Listing pages: the link of each form, from its number.
PAGE_LINKS_SQL = sp.SITE_DOCS_SQL + f""",
listing_links AS (
  SELECT doc_id, s, v, list_filter(CASE s
    WHEN 0 THEN CASE v WHEN 3 THEN [li || '?trk=1', li] WHEN 0 THEN [li || '?trk=1'] ELSE [li] END
    WHEN 1 THEN CASE v WHEN 3 THEN ['/about'] ELSE ['/job-offer/' || n] END
    WHEN 2 THEN CASE v WHEN 1 THEN ['/pl/job/' || n || '/job-apply'] ELSE ['/pl/job/' || n] END
    WHEN 3 THEN CASE v WHEN 0 THEN ['/companies/jobs/' || n || '?a=1&b=2']
      WHEN 1 THEN ['https://bulldogjob.pl/companies/jobs/' || n] WHEN 2 THEN ['/companies/jobs/page,2']
      ELSE ['/companies/jobs/' || n] END
    WHEN 4 THEN CASE v WHEN 3 THEN [] ELSE ['/szczegoly/praca/' || n] END
    ELSE CASE v WHEN 0 THEN [pr || '?s=1'] WHEN 1 THEN [pr] WHEN 2 THEN ['/o/' || n || '?s=2']
      ELSE ['/o/' || n || '?s=2', pr || '?s=1'] END END, lambda x: x IS NOT NULL) AS l
  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS n, 'https://linkedin.example.org/jobs/view/' || doc_id AS li,
          'https://it.pracuj.pl/o/' || doc_id AS pr FROM site_docs)),
page_links AS (
  SELECT page_id, url AS page_url, i - 1 AS pos, l[i] AS href
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS l FROM pages
        UNION ALL SELECT doc_id + {sp.LISTING_ID}, {O._list(sp.LISTING_URLS)}[s + 1], l FROM listing_links) p,
       range(1, len(l) + 1) r(i))"""


@register("validate_offers", O.with_(O.OFFERS, O.PLACED) + """
SELECT seq, CASE WHEN title IS NULL THEN 'missing_title' WHEN company IS NULL THEN 'missing_company'
  WHEN location IS NULL THEN 'missing_location' WHEN job_url IS NULL THEN 'missing_job_url'
  WHEN site IS NULL THEN 'missing_site' WHEN NOT regexp_matches(job_url, '^https?://[^/?#]+') THEN 'bad_url'
  WHEN length(job_url) > 2083 THEN 'url_too_long' END AS reject_reason FROM placed""")
def q_validate(spark, sf):
    return ofr.validate_offers(fx.placed_offers(spark, sf)).select("seq", "reject_reason")


@register("validate_links", O.with_(PAGE_LINKS_SQL) + """
SELECT page_id, pos, CASE WHEN href IS NULL THEN 'missing_job_url'
  WHEN NOT regexp_matches(href, '^https?://[^/?#]+') THEN 'bad_url'
  WHEN length(href) > 2083 THEN 'url_too_long' END AS reject_reason
FROM page_links""")
def q_validate_links(spark, sf):
    links = _page_links_df(spark, sf)
    as_offers = links.select("page_id", "pos", F.col("page_url").alias("title"), F.lit("pages").alias("company"),
                             F.lit("").alias("location"), F.col("href").alias("job_url"), F.lit("pages").alias("site"))
    return ofr.validate_offers(as_offers).select("page_id", "pos", "reject_reason")


@register("offer_defaults", O.with_(O.OFFERS) + """
SELECT seq, 'Unknown' AS title, coalesce(CASE WHEN seq % 11 = 0 THEN NULL ELSE company END, 'Unknown') AS company,
       'JobSpy' AS site, coalesce(location, 'Katowice') AS location FROM offers""")
def q_defaults(spark, sf):
    api = offers_df(spark, sf).select(
        "seq", F.when(F.col("seq") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("company")).alias("company"),
        "location", "job_url")
    return ofr.offer_defaults(api, "Katowice").select("seq", "title", "company", "site", "location")


@register("fresh_only", O.with_(O.OFFERS) + """
SELECT seq, posted_at FROM offers WHERE posted_ts >= TIMESTAMP '2024-03-01 00:00:00' - INTERVAL 336 HOUR""")
def q_fresh(spark, sf):
    return ofr.fresh_only(offers_df(spark, sf), fx.REF_TS, 14).select("seq", "posted_at")


@register("fresh_by_day", O.with_(O.OFFERS, O.PROFILES) + """
SELECT 'one' AS asked, seq FROM offers WHERE posted_ts >= TIMESTAMP '2024-03-01 00:00:00' - INTERVAL 336 HOUR
UNION ALL SELECT 'searches', seq FROM offers WHERE posted_ts >= TIMESTAMP '2024-03-01 00:00:00' - to_days((SELECT max(max_days_old) FROM profiles
  WHERE max_days_old < 60))""")
def q_fresh_by_day(spark, sf):
    """The offers stored by day, read for one age limit and for a table of searches."""
    from ..session import scratch_path
    from ..sources import daily
    path = scratch_path(spark, "offers_by_day")
    daily.write_by_day(offers_df(spark, sf).select("seq", "job_url", "posted_ts"), path)
    one = daily.read_fresh(spark, path, fx.REF_TS, 14).select(F.lit("one").alias("asked"), "seq")
    some = daily.read_for(spark, path, fx.REF_TS, fx.profiles(spark, sf).where("max_days_old < 60"))
    return one.unionByName(some.select(F.lit("searches").alias("asked"), "seq"))


@register("place_filter", O.with_(O.OFFERS) + """
SELECT 'current' AS mode, seq FROM offers WHERE location = 'fr'
UNION ALL SELECT 'remote_only', seq FROM offers WHERE is_remote
UNION ALL SELECT 'local_plus_remote', seq FROM offers WHERE location = 'de' OR is_remote""")
def q_place(spark, sf):
    o = offers_df(spark, sf)
    a = ofr.place_filter(o, "fr", False).select(F.lit("current").alias("mode"), "seq")
    b = ofr.place_filter(o, "fr", True).select(F.lit("remote_only").alias("mode"), "seq")
    c = ofr.place_filter(o, "de", True, "local_plus_remote").select(F.lit("local_plus_remote").alias("mode"), "seq")
    return a.unionByName(b).unionByName(c)


@register("place_label", O.with_(O.OFFERS) +
          "SELECT seq, CASE WHEN is_remote THEN 'Remote' ELSE location END AS place_label FROM offers")
def q_place_label(spark, sf):
    return offers_df(spark, sf).select("seq", ofr.place_label_col().alias("place_label"))


@register("has_description", O.with_(O.OFFERS) + "SELECT seq FROM offers WHERE length(description) > 0")
def q_has_desc(spark, sf):
    return ofr.has_description(offers_df(spark, sf)).select("seq")


@register("clip_description", O.with_(O.OFFERS) + """
SELECT seq, CAST(length(substr(description, 1, 8000)) AS BIGINT) AS clip_len,
       CAST(greatest(length(description) - 8000, 0) AS BIGINT) AS n_cut,
       md5(substr(description, 1, 8000)) AS clip_md5 FROM offers""")
def q_clip(spark, sf):
    c = ofr.clip_description(offers_df(spark, sf))
    return c.select("seq", F.length("description").cast("long").alias("clip_len"), "n_cut",
                    F.md5("description").alias("clip_md5"))


@register("canonical_url", O.with_(O.OFFERS) + "SELECT seq, split_part(raw_url, '?', 1) AS canonical FROM offers")
def q_canonical(spark, sf):
    return offers_df(spark, sf).select("seq", tx.canonical_url("raw_url").alias("canonical"))


@register("absolute_url", O.with_(PAGE_LINKS_SQL) + """
SELECT page_id, pos, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://justjoin.it' || href END AS abs_url,
       'https://theprotocol.it' || href AS always_url FROM page_links""")
def q_absolute(spark, sf):
    links = _page_links_df(spark, sf)
    return links.select("page_id", "pos", tx.absolute_url("href", "https://justjoin.it").alias("abs_url"),
                        tx.absolute_url("href", "https://theprotocol.it", always=True).alias("always_url"))


@register("clean_listing_title", O.with_(O.OFFERS) + "SELECT seq, " +
          O.strip_sql("split_part(CASE WHEN seq % 2 = 0 THEN split_part(description, chr(10), 1) || ' 9 000 PLN gross' "
                      "ELSE split_part(description, chr(10), 1) END, 'PLN', 1)") + " AS listing_title FROM offers")
def q_listing_title(spark, sf):
    first = F.substring_index("description", "\n", 1)
    card = F.when(F.col("seq") % 2 == 0, F.concat(first, F.lit(" 9 000 PLN gross\n9 000 PLN"))).otherwise(
        F.col("description"))
    return offers_df(spark, sf).withColumn("card", card).select("seq", tx.clean_listing_title("card").alias(
        "listing_title"))


# RE2 has no look-around, so the oracle evaluates the letter-joining rule
# per space between whitespace-separated pieces: the space goes when the
# piece before ends in a lone ASCII letter and the piece after starts with one.
_NW = r"[^\p{L}\p{N}_]"
_CLEAN_SQL = f"""
SELECT conv_id, turn, {O.strip_sql("array_to_string(list_transform(range(1, len(w) + 1), lambda i: w[i] || "
    "CASE WHEN i < len(w) AND regexp_matches(w[i], '(^|" + _NW + ")[A-Za-z]$') "
    "AND regexp_matches(w[i + 1], '^[A-Za-z]($|" + _NW + ")') THEN '' WHEN i < len(w) THEN ' ' ELSE '' END), '')")}
  AS clean
FROM (SELECT conv_id, turn, string_split(regexp_replace(coalesce(text, ''), '{tx.PY_SPACE}+', ' ', 'g'), ' ') AS w
      FROM conversations)"""


@register("clean_text", _CLEAN_SQL)
def q_clean_text(spark, sf):
    conv = fx.table(spark, sf, "conversations")
    return conv.select("conv_id", "turn", tx.clean_text("text").alias("clean"))


_sb_score, _, _ = _score_sql("description", FLAG_SKILLS)


@register("score_band", O.with_(O.OFFERS) + f"""
SELECT seq, {_sb_score} AS match_score, {_band_sql(_sb_score)} AS band,
  CASE WHEN coalesce({_sb_score}, 0) >= 70 THEN 'green' WHEN coalesce({_sb_score}, 0) >= 45 THEN 'yellow'
       ELSE 'red' END AS band_legacy
FROM offers WHERE length(description) > 0""")
def q_score_band(spark, sf):
    pairs = offers_df(spark, sf).withColumn("skills", F.array(*[F.lit(s) for s in
                                                                ["the", "and", "de", "pour", "python", "sql"]]))
    s = sc.score_offers(pairs)
    return s.select("seq", "match_score", sc.score_band_col("match_score").alias("band"),
                    sc.score_band_col("match_score", legacy=True).alias("band_legacy"))


@register("description_status", O.with_(O.OFFERS) + """
SELECT seq, CASE WHEN k IN (0, 1, 2, 3, 4) THEN ['signin_wall', 'guest_mode', 'guest_mode', 'missing', 'error'][k + 1]
    WHEN d IS NULL OR length(""" + O.strip_sql("d") + """) = 0 THEN 'missing' ELSE 'ok' END AS status,
  CASE WHEN k > 4 AND length(""" + O.strip_sql("d") + """) > 0 THEN md5(d) END AS description_md5
FROM (SELECT seq, seq % 13 AS k, CASE seq % 13 WHEN 5 THEN 'Error: please sign in to ' || description
        WHEN 6 THEN '' ELSE description END AS d FROM offers)""")
def q_desc_status(spark, sf):
    k, desc = F.col("seq") % 13, F.col("description")
    texts = ["Błąd: LinkedIn wyświetlił ekran logowania. Nie można pobrać opisu.",
             "Opis dostępny bezpośrednio na LinkedIn (Guest Mode).", "Guest Mode - opis niedostępny bez logowania",
             "Brak opisu dla Pracuj.pl.", "Błąd: timeout"]
    stored = F.when(k == 5, F.concat(F.lit("Error: please sign in to "), desc)).when(k == 6, F.lit(""))
    for i, text in enumerate(texts):
        stored = stored.when(k == i, F.lit(text))
    return ofr.description_status(offers_df(spark, sf).withColumn("description", stored.otherwise(desc))).select(
        "seq", "status", F.md5("description").alias("description_md5"))



# ---------------------------------------------------------------------------
# 2.4 joins
# ---------------------------------------------------------------------------

@register("new_offers", O.with_(O.OFFERS, HIST_URLS) + """
SELECT seq, job_url FROM offers o WHERE batch_id > 0
  AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.job_url = o.job_url)""")
def q_new_offers(spark, sf):
    o = offers_df(spark, sf)
    return st.new_offers(o.where("batch_id > 0"), st.seen_urls(o.where("batch_id = 0"))).select("seq", "job_url")


@register("known_offers", O.with_(O.OFFERS, HIST_URLS) + """
SELECT seq, job_url FROM offers o WHERE batch_id > 0
  AND EXISTS (SELECT 1 FROM hist h WHERE h.job_url = o.job_url)""")
def q_known_offers(spark, sf):
    o = offers_df(spark, sf)
    return st.known_offers(o.where("batch_id > 0"), st.seen_urls(o.where("batch_id = 0"))).select("seq", "job_url")


@register("match_profiles", O.with_(O.OFFERS, O.PROFILES, O.COMPILED, MATCHED_PAIRS) +
          "SELECT profile_id, seq FROM pairs")
def q_match_profiles(spark, sf):
    return se.match_profiles(offers_df(spark, sf), se.compiled_profiles(fx.profiles(spark, sf)))


def _topics_sql(groups: str, rule_set: str = "current") -> str:
    spec = se.TOPIC_RULES[rule_set]
    first = f"coalesce({groups}[1], []::VARCHAR[])"
    if rule_set in se.NO_GROUP_KEYWORDS:
        first = f"CASE WHEN len({groups}) > 0 THEN {first} ELSE {O._list(se.NO_GROUP_KEYWORDS[rule_set])} END"
    if spec["first_hit"]:
        whens = " ".join(f"WHEN contains(lower(kw), '{tok}') THEN '{topic}'" for tok, topic in spec["rules"])
        per_kw = f"list_filter([CASE {whens} END], lambda z: z IS NOT NULL)"
    else:
        parts = ", ".join(f"CASE WHEN contains(lower(kw), '{tok}') THEN '{topic}' END" for tok, topic in spec["rules"])
        per_kw = f"list_filter([{parts}], lambda z: z IS NOT NULL)"
    found = f"list_distinct(flatten(list_transform({first}, lambda kw: {per_kw})))"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE {O._list(spec['default'])} END"


TOPICS = f"topics AS (SELECT profile_id, unnest({_topics_sql('groups')}) AS topic FROM compiled)"


@register("keyword_topics", O.with_(O.PROFILES, O.COMPILED, TOPICS) + "SELECT profile_id, topic FROM topics")
def q_topics(spark, sf):
    return se.keyword_topics(se.compiled_profiles(fx.profiles(spark, sf)))


def _slug_sql(site: str) -> str:
    mapping, default = se.SLUG_MAPS[site]
    whens = " ".join(f"WHEN topic = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE '{default}' END"


@register("topic_slugs", O.with_(O.PROFILES, O.COMPILED, TOPICS) + " UNION ALL ".join(
    f"SELECT profile_id, topic, '{site}' AS site, {_slug_sql(site)} AS slug FROM topics" for site in se.SLUG_MAPS))
def q_slugs(spark, sf):
    return se.topic_slugs(se.keyword_topics(se.compiled_profiles(fx.profiles(spark, sf))))


def _matched_offer_pairs(spark, sf):
    o = offers_df(spark, sf)
    pairs = se.match_profiles(o, se.compiled_profiles(fx.profiles(spark, sf)))
    return pairs.join(o, "seq")


@register("offer_cv_pairs", O.with_(O.OFFERS, O.PROFILES, O.COMPILED, MATCHED_PAIRS, O.RESUMES) + """
SELECT p.profile_id, p.seq, CAST(length(r.cv_text) AS BIGINT) AS cv_len FROM pairs p JOIN resumes r USING (profile_id)""")
def q_pairs(spark, sf):
    return sc.offer_cv_pairs(_matched_offer_pairs(spark, sf), fx.resumes(spark, sf)).select(
        "profile_id", "seq", F.length("cv_text").cast("long").alias("cv_len"))


# ---------------------------------------------------------------------------
# 2.5 dedupe, merge, sets
# ---------------------------------------------------------------------------

@register("dedupe_batch", O.with_(O.OFFERS, NEWB) +
          f"SELECT seq, title, company, location FROM {O.keep_last_sql('newb', O.DEDUPE_KEYS)}")
def q_dedupe_batch(spark, sf):
    return st.dedupe_batch(offers_df(spark, sf).where("batch_id > 0")).select("seq", "title", "company", "location")


@register("dedupe_url_first", O.with_(O.OFFERS, NEWB) +
          f"SELECT seq, job_url FROM {O.keep_last_sql('newb', ['job_url'], 'first')}")
def q_dedupe_url(spark, sf):
    return st.dedupe_url_first(offers_df(spark, sf).where("batch_id > 0")).select("seq", "job_url")


@register("dedupe_title_company_first", O.with_(
    O.OFFERS, NEWB, f"p1 AS {O.keep_last_sql('newb', ['job_url'], 'first')}") +
    f"SELECT seq, title, company FROM {O.keep_last_sql('p1', [O.norm_sql('title'), O.norm_sql('company')], 'first')}")
def q_dedupe_tc(spark, sf):
    return st.dedupe_legacy(offers_df(spark, sf).where("batch_id > 0")).select("seq", "title", "company")


@register("merge_history", O.with_(
    O.OFFERS, f"p1 AS {O.keep_last_sql('offers', ['job_url'])}") +
    f"SELECT seq, job_url FROM {O.keep_last_sql('p1', O.DEDUPE_KEYS)}")
def q_merge(spark, sf):
    o = offers_df(spark, sf)
    return st.merge_history(o.where("batch_id = 0"), o.where("batch_id > 0")).select("seq", "job_url")


@register("append_history", O.with_(O.OFFERS) + "SELECT seq, batch_id FROM offers")
def q_append(spark, sf):
    o = offers_df(spark, sf)
    return st.append_history(o.where("batch_id = 0"), o.where("batch_id > 0")).select("seq", "batch_id")


@register("first_seen_in_batch", O.with_(
    O.OFFERS, HIST_URLS,
    "n AS (SELECT * FROM offers o WHERE batch_id > 0 AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.job_url = o.job_url))")
    + f"SELECT seq, job_url FROM {O.keep_last_sql('n', ['job_url'], 'first')}")
def q_first_seen(spark, sf):
    o = offers_df(spark, sf)
    return st.first_seen_in_batch(o.where("batch_id > 0"), st.seen_urls(o.where("batch_id = 0"))).select(
        "seq", "job_url")


@register("union_sources", O.with_(O.OFFERS) + """
SELECT seq, source_rank, posted_at FROM offers WHERE source_rank = 0
UNION ALL SELECT seq, source_rank, NULL AS posted_at FROM offers WHERE source_rank = 1""")
def q_union(spark, sf):
    o = offers_df(spark, sf)
    api = o.where("source_rank = 0").select("seq", "source_rank", "posted_at")
    sites = o.where("source_rank = 1").select("seq", "source_rank")
    return st.union_sources(api, sites).select("seq", "source_rank", "posted_at")


@register("distinct_candidates", O.with_(O.OFFERS) + "SELECT DISTINCT title, job_url FROM offers")
def q_distinct(spark, sf):
    return st.distinct_candidates(offers_df(spark, sf).select("title", "job_url"))


def _flags(spark, sf):
    o = offers_df(spark, sf)
    b = st.with_seen_flag(o.where("batch_id > 0"), st.seen_urls(o.where("batch_id = 0")))
    return b.withColumn("is_match", se.match_predicate("title", FLAGSHIP_GROUPS, FLAGSHIP_EXCLUDES))


FLAGS_SQL = ("flags AS (SELECT o.*, EXISTS (SELECT 1 FROM hist h WHERE h.job_url = o.job_url) AS is_seen, "
             f"{P1_MATCH} AS is_match FROM offers o WHERE batch_id > 0)")


@register("site_funnel", O.with_(O.OFFERS, HIST_URLS, FLAGS_SQL) + """
SELECT site, count(*) AS processed, count_if(is_seen) AS filtered_history, count_if(NOT is_seen AND is_match) AS added
FROM flags GROUP BY ROLLUP (site)""")
def q_funnel(spark, sf):
    return rpt.site_funnel(_flags(spark, sf))


@register("session_report", O.with_(
    O.OFFERS, HIST_URLS, FLAGS_SQL,
    "nm AS (SELECT * FROM flags WHERE is_match AND NOT is_seen)",
    f"surv AS (SELECT seq FROM {O.keep_last_sql('nm', O.DEDUPE_KEYS)})") + """
SELECT count_if(is_match) AS found, count_if(is_match AND is_seen) AS dropped_history,
  count_if(is_match AND NOT is_seen AND source_rank = 0) AS new_api,
  count_if(is_match AND NOT is_seen AND source_rank = 1) AS new_sites,
  count_if(is_match AND NOT is_seen AND seq IN (SELECT seq FROM surv)) AS total_after_dedupe
FROM flags""")
def q_session(spark, sf):
    f = _flags(spark, sf)
    new = f.where(F.col("is_match") & ~F.col("is_seen"))
    surv = st.dedupe_batch(new).select("seq", F.lit(True).alias("is_survivor"))
    f2 = f.join(surv, "seq", "left").withColumn("is_survivor", F.coalesce("is_survivor", F.lit(False)))
    return rpt.session_report(f2)


# ---------------------------------------------------------------------------
# 2.6 windows
# ---------------------------------------------------------------------------

@register("newest_per_site", O.with_(O.OFFERS, O.PROFILES, O.COMPILED, MATCHED_PAIRS) + """
SELECT profile_id, site, seq FROM (
  SELECT p.profile_id, o.site, o.seq, row_number() OVER (PARTITION BY p.profile_id, o.site
         ORDER BY o.posted_ts DESC NULLS LAST, o.job_url, o.seq) AS rn
  FROM pairs p JOIN offers o USING (seq)) WHERE rn <= 50""")
def q_newest(spark, sf):
    return ofr.newest_per_site(_matched_offer_pairs(spark, sf)).select("profile_id", "site", "seq")


# ---------------------------------------------------------------------------
# 2.9 scoring
# ---------------------------------------------------------------------------

def _scored_pairs(spark, sf):
    o = offers_df(spark, sf)
    pairs = se.match_profiles(o, se.compiled_profiles(fx.profiles(spark, sf)))
    # the narrow (profile_id, seq) pairs meet the search-sized tables first;
    # the offer text joins last, once per pair (pairs are already partitioned
    # by seq, so at scale only the offer side moves)
    pairs = sc.offer_cv_pairs(pairs, fx.resumes(spark, sf))
    skills = fx.profiles(spark, sf).select("profile_id", "skills")
    pairs = pairs.join(skills, "profile_id")
    return sc.score_offers(pairs.join(sc.with_scoring_text(o), "seq"))


_ps_score, _ps_missing, _ps_advice = _score_sql("o.description", "pr.skills")
SCORED_SQL = (f"scored AS (SELECT p.profile_id, p.seq, o.title, o.company, o.location, o.job_url, "
              f"{_ps_score} AS match_score, {_ps_missing} AS missing_skills, {_ps_advice} AS advice "
              "FROM pairs p JOIN offers o USING (seq) JOIN profiles pr USING (profile_id) "
              "JOIN resumes r USING (profile_id) WHERE length(o.description) > 0)")


@register("score_offers", O.with_(O.OFFERS, O.PROFILES, O.COMPILED, MATCHED_PAIRS, O.RESUMES, SCORED_SQL) +
          "SELECT profile_id, seq, match_score, missing_skills, advice FROM scored")
def q_score(spark, sf):
    s = _scored_pairs(spark, sf)
    return s.select("profile_id", "seq", "match_score", F.array_join("missing_skills", ",").alias("missing_skills"),
                    "advice")


@register("to_result", O.with_(O.OFFERS, O.PROFILES, O.COMPILED, MATCHED_PAIRS, O.RESUMES, SCORED_SQL) + """
SELECT profile_id, seq, company, title, job_url AS url, location, match_score, missing_skills, advice FROM scored""")
def q_to_result(spark, sf):
    r = sc.to_result(_scored_pairs(spark, sf))
    return r.select("profile_id", "seq", "company", "title", "url", "location",
                    F.col("analysis.match_score").alias("match_score"),
                    F.array_join("analysis.missing_skills", ",").alias("missing_skills"),
                    F.col("analysis.advice").alias("advice"))


_PROMPT_HEAD, _rest = sc.PROMPT_TEMPLATE.split("{description}")
_PROMPT_MID, _PROMPT_TAIL = _rest.split("{cv}")


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@register("render_prompt", O.with_(O.OFFERS, O.PROFILES, O.COMPILED, MATCHED_PAIRS, O.RESUMES) + f"""
SELECT p.profile_id, p.seq, md5({_sql_str(_PROMPT_HEAD)} || coalesce(substr(o.description, 1, 8000), '')
   || {_sql_str(_PROMPT_MID)} || coalesce(r.cv_text, '') || {_sql_str(_PROMPT_TAIL)}) AS prompt_md5
FROM pairs p JOIN offers o USING (seq) JOIN resumes r USING (profile_id) WHERE o.description IS NOT NULL""")
def q_prompt(spark, sf):
    pairs = sc.offer_cv_pairs(_matched_offer_pairs(spark, sf), fx.resumes(spark, sf))
    return sc.render_prompt(pairs.where(F.col("description").isNotNull())).select(
        "profile_id", "seq", F.md5("prompt").alias("prompt_md5"))


@register("analysis_backlog", O.with_(
    O.OFFERS, "done AS (SELECT DISTINCT job_url FROM offers WHERE batch_id = 0 AND length(description) > 0)") + """
SELECT seq FROM offers o WHERE batch_id > 0 AND length(description) > 0
  AND NOT EXISTS (SELECT 1 FROM done d WHERE d.job_url = o.job_url)""")
def q_backlog(spark, sf):
    o = offers_df(spark, sf)
    results = o.where("batch_id = 0 AND length(description) > 0").select(F.col("job_url").alias("url"))
    return sc.analysis_backlog(o.where("batch_id > 0"), results).select("seq")


def _report_block_sql() -> str:
    def esc(x):
        out = x
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            out = f"replace({out}, {_sql_str(a)}, {_sql_str(b)})"
        return out
    color = ("CASE WHEN match_score >= 70 THEN '#28a745' WHEN match_score >= 45 THEN '#ffc107' "
             "ELSE '#dc3545' END")
    s = lambda c: esc(f"coalesce(CAST({c} AS VARCHAR), '')")
    return (f"'<section><h3>' || {s('title')} || '</h3><p>' || {s('company')} || '</p><p style=\"color:' || {color} || '\">' || "
            f"coalesce(CAST(match_score AS VARCHAR), '') || ' of 100</p><p>' || {s('advice')} || '</p><p><a href=\"' || {s('url')} || "
            f"'\">To the offer</a></p></section>'")


_RH_A, _RH_B = rpt.REPORT_HEAD.split("{n}")


@register("report_html", O.with_(O.OFFERS, O.PROFILES, O.COMPILED, MATCHED_PAIRS, O.RESUMES, SCORED_SQL,
                                 "res AS (SELECT *, job_url AS url FROM scored)") + f"""
SELECT profile_id, -1::BIGINT AS ord, {_sql_str(_RH_A)} || CAST(count(*) AS VARCHAR) || {_sql_str(_RH_B)} AS html
FROM res GROUP BY profile_id
UNION ALL SELECT profile_id, seq AS ord, {_report_block_sql()} AS html FROM res
UNION ALL SELECT profile_id, {1 << 62}::BIGINT AS ord, {_sql_str(rpt.REPORT_TAIL)} AS html FROM res GROUP BY profile_id""")
def q_report(spark, sf):
    from ..session import stored
    res = sc.to_result(_scored_pairs(spark, sf)).select(
        "profile_id", "seq", "title", "company", "url", F.col("analysis.match_score").alias("match_score"),
        F.col("analysis.advice").alias("advice"))
    return rpt.report_lines(stored(res, "report_results", "seq"))


# ---------------------------------------------------------------------------
# 2.10 incremental runs (three runs folded over the batch-0 history)
# ---------------------------------------------------------------------------

def _fold_sql() -> str:
    ctes = [O.OFFERS, "cur0 AS (SELECT * FROM offers WHERE batch_id = 0)"]
    for k in (1, 2, 3):
        ctes.append(f"seen{k - 1} AS (SELECT DISTINCT job_url FROM cur{k - 1} WHERE job_url IS NOT NULL)")
        ctes.append(f"m{k} AS (SELECT * FROM offers o WHERE batch_id = {k} AND {VALID} AND {P1_MATCH} "
                    f"AND NOT EXISTS (SELECT 1 FROM seen{k - 1} s WHERE s.job_url = o.job_url))")
        ctes.append(f"n{k} AS {O.keep_last_sql(f'm{k}', O.DEDUPE_KEYS)}")
        ctes.append(f"u{k} AS (SELECT * FROM cur{k - 1} UNION ALL SELECT * FROM n{k})")
        ctes.append(f"v{k} AS {O.keep_last_sql(f'u{k}', ['job_url'])}")
        ctes.append(f"cur{k} AS {O.keep_last_sql(f'v{k}', O.DEDUPE_KEYS)}")
    return O.with_(*ctes) + "SELECT seq, batch_id, job_url FROM cur3"


@register("incremental_run", _fold_sql())
def q_incremental(spark, sf):
    o = offers_df(spark, sf)
    state = initial_state(o.where("batch_id = 0"), forgetful=True)
    _, final = fold_runs([o.where(F.col("batch_id") == k) for k in (1, 2, 3)], state,
                         FLAGSHIP_GROUPS, FLAGSHIP_EXCLUDES)
    return final.current.select("seq", "batch_id", "job_url")


def _searches_sql() -> str:
    """Three batches against every search: one history per search, the rows of batch 0 that it wants."""
    keys = ["profile_id", *O.DEDUPE_KEYS]
    ctes = [O.OFFERS, O.PLACED, O.PROFILES, O.COMPILED,
            MATCHED_PAIRS.replace("FROM offers WHERE title", f"FROM placed WHERE {VALID} AND title"), f"""
wanted AS MATERIALIZED (SELECT p.profile_id, o.* FROM pairs p JOIN placed o USING (seq) JOIN profiles s USING (profile_id)
  WHERE CASE WHEN s.remote_only THEN o.is_remote ELSE s.location = '' OR o.location = s.location END
    AND o.posted_ts >= TIMESTAMP '{fx.REF_TS}' - to_days(s.max_days_old))""",
            "cur0 AS (SELECT * FROM wanted WHERE batch_id = 0)"]
    for k in (1, 2, 3):
        ctes.append(f"m{k} AS (SELECT * FROM wanted w WHERE batch_id = {k} AND NOT EXISTS (SELECT 1 FROM cur{k - 1} c "
                    "WHERE c.profile_id = w.profile_id AND c.job_url = w.job_url))")
        ctes.append(f"n{k} AS MATERIALIZED {O.keep_last_sql(f'm{k}', keys)}")
        ctes.append(f"u{k} AS (SELECT * FROM cur{k - 1} UNION ALL SELECT * FROM n{k})")
        ctes.append(f"v{k} AS {O.keep_last_sql(f'u{k}', ['profile_id', 'job_url'])}")
        ctes.append(f"cur{k} AS MATERIALIZED {O.keep_last_sql(f'v{k}', keys)}")
    score, missing, _ = _score_sql("o.description", "s.skills")
    news = " UNION ALL ".join(f"SELECT * FROM n{k}" for k in (1, 2, 3))
    return O.with_(*ctes, O.RESUMES) + f"""
SELECT 'result' AS outcome, profile_id, batch_id, seq, job_url AS detail, {score} AS match_score
FROM ({news}) o JOIN profiles s USING (profile_id) JOIN resumes r USING (profile_id) WHERE length(o.description) > 0
UNION ALL SELECT 'rejected', NULL, batch_id, seq, CASE WHEN title IS NULL THEN 'missing_title'
  WHEN company IS NULL THEN 'missing_company' WHEN location IS NULL THEN 'missing_location'
  WHEN job_url IS NULL THEN 'missing_job_url' WHEN site IS NULL THEN 'missing_site'
  WHEN NOT regexp_matches(job_url, '^https?://[^/?#]+') THEN 'bad_url' ELSE 'url_too_long' END, NULL
FROM placed WHERE batch_id > 0 AND NOT coalesce({VALID}, false)
UNION ALL SELECT 'current', profile_id, batch_id, seq, job_url, NULL FROM cur3"""


@register("run_searches", _searches_sql())
def q_run_searches(spark, sf):
    """Three batches over the whole search table: results, refused offers and the final history."""
    from .searches import fold_searches, wanted_pairs
    o, searches = fx.placed_offers(spark, sf), fx.profiles(spark, sf)
    start = wanted_pairs(ofr.valid_offers(o.where("batch_id = 0")), searches, fx.REF_TS)
    runs = fold_searches([o.where(F.col("batch_id") == k) for k in (1, 2, 3)], start, searches,
                         fx.resumes(spark, sf), fx.REF_TS)
    none = F.lit(None).cast("int").alias("match_score")
    parts = [runs[-1].current.select(F.lit("current").alias("outcome"), "profile_id", "batch_id", "seq",
                                     F.col("job_url").alias("detail"), none)]
    for run in runs:
        parts.append(run.results.select(F.lit("result").alias("outcome"), "profile_id", "batch_id", "seq",
                                        F.col("url").alias("detail"), F.col("analysis.match_score").alias("match_score")))
        parts.append(run.rejects.select(F.lit("rejected").alias("outcome"), F.lit(None).cast("long").alias("profile_id"),
                                        "batch_id", "seq", F.col("reject_reason").alias("detail"), none))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def flaky_scorer(pdf):
    """A user scorer that fails some offers the first time, some twice, some always; scores follow the text's length."""
    import pandas as pd

    bad = (((pdf["seq"] % 3 == 0) & (pdf["attempts"] == 0)) | ((pdf["seq"] % 5 == 1) & (pdf["attempts"] < 2)) | (pdf["seq"] % 7 == 2))
    return pd.DataFrame({"match_score": (pdf["description"].str.len() % 101).where(~bad), "missing_skills": [[] for _ in range(len(pdf))],
                         "advice": "ok", "error": pd.Series("try " + (pdf["attempts"] + 1).astype(str)).where(bad, None)})


def _retry_sql() -> str:
    ctes = ORACLES["run_searches"]
    head = ctes[:ctes.index("\nSELECT 'result' AS outcome")]
    empty = ("SELECT NULL::BIGINT AS profile_id, NULL AS job_url, NULL AS status, 0 AS attempts, NULL AS last_error, "
             "NULL::BIGINT AS seq, NULL AS description, NULL::INTEGER AS match_score, 0 AS run WHERE false")
    parts = [f"l0 AS ({empty})"]
    for k in (1, 2, 3):
        fails = "(seq % 3 = 0 AND attempts = 0) OR (seq % 5 = 1 AND attempts < 2) OR seq % 7 = 2"
        parts.append(f"f{k} AS {O.keep_last_sql(f'n{k}', ['profile_id', 'job_url'])}")
        parts.append(f"t{k} AS {O.keep_last_sql(f'(SELECT * FROM placed WHERE {VALID} AND batch_id = {k} AND length(description) > 0)', ['job_url'])}")
        parts.append(f"""e{k} AS (SELECT profile_id, job_url, coalesce(f.seq, l.seq) AS seq, coalesce(l.attempts, 0) AS attempts,
            coalesce(nullif(f.description, ''), t.description, l.description) AS text
          FROM f{k} f FULL JOIN l{k - 1} l USING (profile_id, job_url) LEFT JOIN t{k} t USING (job_url)
          WHERE coalesce(l.status, '') <> 'scored')""")
        parts.append(f"""o{k} AS MATERIALIZED (SELECT profile_id, job_url, CASE WHEN text IS NULL OR cv_text IS NULL THEN 'waiting' WHEN {fails} THEN 'failed'
            ELSE 'scored' END AS status, CASE WHEN text IS NULL OR cv_text IS NULL THEN attempts ELSE attempts + 1 END AS attempts,
            CASE WHEN text IS NULL THEN 'no_description' WHEN cv_text IS NULL THEN 'no_cv' WHEN {fails} THEN 'try ' || (attempts + 1) END AS last_error, seq,
            CASE WHEN text IS NULL OR cv_text IS NULL OR {fails} THEN text END AS description,
            CASE WHEN text IS NOT NULL AND cv_text IS NOT NULL AND NOT ({fails}) THEN length(text) % 101 END AS match_score, {k} AS run
          FROM e{k} LEFT JOIN resumes USING (profile_id))""")
        parts.append(f"l{k} AS MATERIALIZED (SELECT * FROM l{k - 1} l WHERE NOT EXISTS (SELECT 1 FROM o{k} o WHERE o.profile_id = l.profile_id "
                     f"AND o.job_url = l.job_url) UNION ALL SELECT * FROM o{k})")
    results = " UNION ALL ".join(f"SELECT 'result', run, profile_id, job_url, seq, NULL, NULL, NULL, match_score FROM o{k} WHERE status = 'scored'"
                                 for k in (1, 2, 3))
    return head + ",\n" + ",\n".join(parts) + f"""
SELECT 'pair' AS outcome, 0 AS run, profile_id, job_url, seq, status, attempts, last_error, NULL AS match_score FROM l3 UNION ALL {results}"""


@register("retry_ledger", _retry_sql())
def q_retry_ledger(spark, sf):
    """Three batches over the whole search table with a scorer that fails now and then: every pair's last
    state, and the results in the run that gave them."""
    from ..session import scratch_path
    from ..sources.attempt_log import AttemptLog
    from .searches import fold_searches, wanted_pairs
    o, searches = fx.placed_offers(spark, sf), fx.profiles(spark, sf)
    start = wanted_pairs(ofr.valid_offers(o.where("batch_id = 0")), searches, fx.REF_TS)
    log = AttemptLog(spark, scratch_path(spark, "attempts"))
    log.create()
    runs = fold_searches([o.where(F.col("batch_id") == k) for k in (1, 2, 3)], start, searches,
                         fx.resumes(spark, sf), fx.REF_TS, flaky_scorer, log)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    out = log.pairs().select(F.lit("pair").alias("outcome"), F.lit(0).alias("run"), "profile_id", "job_url", "seq", "status",
                            "attempts", "last_error", none("match_score", "int"))
    for k, run in enumerate(runs, 1):
        out = out.unionByName(run.results.select(
            F.lit("result").alias("outcome"), F.lit(k).alias("run"), "profile_id", F.col("url").alias("job_url"), "seq",
            none("status", "string"), none("attempts", "int"), none("last_error", "string"),
            F.col("analysis.match_score").alias("match_score")))
    return out


# ---------------------------------------------------------------------------
# 2.8 crawl plan
# ---------------------------------------------------------------------------

def _search_plan_sql() -> str:
    loc = "coalesce(location, '')"
    lloc = f"lower({loc})"
    rem = "coalesce(remote_only, false)"
    junior = f"coalesce(list_has_any(flatten(groups), {O._list(se.JUNIOR_WORDS_CURRENT)}), false)"
    first = "coalesce(groups[1], []::VARCHAR[])"
    kws = f"CASE WHEN len({first}) > 0 THEN {first} ELSE ['Data'] END"
    geo = f"CASE WHEN contains({loc}, 'Katowice') THEN '90009829' ELSE '105072130' END"
    qp = "replace(url_encode(kw), '%20', '+')"
    nfj = _slug_sql("NoFluffJobs")
    tp = _slug_sql("TheProtocol")
    return O.with_(O.LEVELLED, O.COMPILED, f"tp AS (SELECT *, unnest({_topics_sql('groups')}) AS topic FROM compiled)") + f"""
SELECT DISTINCT profile_id, site, url FROM (
  SELECT profile_id, 'LinkedIn' AS site, 'https://www.linkedin.com/jobs/search/?keywords=' || {qp} || '&geoId=' || {geo}
     || '&f_TPR=r2592000&f_E=1%2C2&f_F=it&refresh=true' || CASE WHEN {rem} THEN '&f_WT=2' ELSE '' END AS url
  FROM (SELECT *, unnest({kws}) AS kw FROM compiled)
  UNION ALL
  SELECT profile_id, 'JustJoinIT', 'https://justjoin.it/job-offers/' || CASE WHEN {loc} = '' OR {rem} THEN 'all-locations'
     ELSE {lloc} END || '/' || topic || CASE WHEN {junior} THEN '?experience-level=junior' ELSE '' END FROM tp
  UNION ALL
  SELECT profile_id, 'NoFluffJobs', 'https://nofluffjobs.com/pl/' || CASE WHEN {rem} THEN 'remote/' WHEN {lloc} <> ''
     THEN {lloc} || '/' ELSE '' END || {nfj} || CASE WHEN {junior} THEN '?criteria=seniority%3Dtrainee,junior' ELSE '' END
  FROM tp
  UNION ALL
  SELECT profile_id, 'TheProtocol', 'https://theprotocol.it/filtry/' || {tp} || ';sp'
     || CASE WHEN {junior} THEN '/trainee,assistant,junior;p' ELSE '' END
     || CASE WHEN {rem} THEN '/remote;wm' WHEN {loc} <> '' THEN '/' || {lloc} || ';wp' ELSE '' END FROM tp
  UNION ALL
  SELECT profile_id, 'BulldogJob', 'https://bulldogjob.pl/companies/jobs/s/' || array_to_string(list_filter([
     CASE WHEN {rem} THEN 'remote,true' WHEN {loc} <> '' THEN 'city,' || {loc} END,
     CASE WHEN {junior} THEN 'experienceLevel,intern,junior' END], lambda z: z IS NOT NULL), '/') FROM compiled
  UNION ALL
  SELECT profile_id, 'Pracuj.pl', 'https://it.pracuj.pl/praca/' || CASE WHEN {rem} THEN 'praca%20zdalna;wm,home-office'
     WHEN {loc} <> '' THEN {lloc} || ';wp' ELSE '' END || '?rd=0' || CASE WHEN {junior} THEN '&et=1%2C3%2C17' ELSE '' END
  FROM compiled)"""


@register("search_plan", _search_plan_sql())
def q_search_plan(spark, sf):
    return se.search_plan(se.compiled_profiles(fx.levelled_profiles(spark, sf)))


# ---------------------------------------------------------------------------
# 2.9 verdicts and dead letters
# ---------------------------------------------------------------------------

def _raw_verdicts(o: DataFrame) -> DataFrame:
    """Model-like raw replies derived from each offer (score from the doc id),
    covering the traps: int, text, .0, .5, out of range, null skills, not JSON."""
    k, s = F.col("seq") % 8, (F.col("seq") % 101).cast("string")
    tail = F.lit(', "missing_skills": ["sql"], "advice": "ok"}')
    raw = (F.when(k == 0, F.concat(F.lit('{"match_score": '), s, tail))
           .when(k == 1, F.concat(F.lit('{"match_score": "'), s, F.lit('"'), tail))
           .when(k == 2, F.concat(F.lit('{"match_score": '), s, F.lit(".0"), tail))
           .when(k == 3, F.concat(F.lit('{"match_score": '), s, F.lit(".5"), tail))
           .when(k == 4, F.concat(F.lit('{"match_score": '), (F.col("seq") % 101 + 100).cast("string"), tail))
           .when(k == 5, F.concat(F.lit('{"match_score": '), s, F.lit(', "missing_skills": null, "advice": "ok"}')))
           .when(k == 6, F.concat(F.lit("not json "), F.col("seq").cast("string")))
           .otherwise(F.concat(F.lit('{"missing_skills": [], "advice": "none"}'))))
    return o.select("seq", raw.alias("raw"))


RAW_SQL = """raw AS (SELECT seq, CASE seq % 8
  WHEN 0 THEN '{"match_score": ' || CAST(seq % 101 AS VARCHAR) || ', "missing_skills": ["sql"], "advice": "ok"}'
  WHEN 1 THEN '{"match_score": "' || CAST(seq % 101 AS VARCHAR) || '", "missing_skills": ["sql"], "advice": "ok"}'
  WHEN 2 THEN '{"match_score": ' || CAST(seq % 101 AS VARCHAR) || '.0, "missing_skills": ["sql"], "advice": "ok"}'
  WHEN 3 THEN '{"match_score": ' || CAST(seq % 101 AS VARCHAR) || '.5, "missing_skills": ["sql"], "advice": "ok"}'
  WHEN 4 THEN '{"match_score": ' || CAST(seq % 101 + 100 AS VARCHAR) || ', "missing_skills": ["sql"], "advice": "ok"}'
  WHEN 5 THEN '{"match_score": ' || CAST(seq % 101 AS VARCHAR) || ', "missing_skills": null, "advice": "ok"}'
  WHEN 6 THEN 'not json ' || CAST(seq AS VARCHAR)
  ELSE '{"missing_skills": [], "advice": "none"}' END AS raw FROM offers)"""

PARSE_SQL = """parsed AS (SELECT seq,
  CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.match_score') END AS s_txt,
  json_valid(raw) AS ok_json,
  CASE WHEN json_valid(raw) THEN json_extract(raw, '$.missing_skills') END AS skills_j,
  CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.advice') END AS advice
  FROM raw),
typed AS (SELECT *, TRY_CAST(trim(s_txt) AS DECIMAL(20,6)) AS dec FROM parsed),
verdicts AS (SELECT seq,
  CASE WHEN dec = floor(dec) AND abs(dec) <= 2147483647 THEN CAST(dec AS INTEGER) END AS match_score,
  ok_json, s_txt, skills_j, advice FROM typed)"""


@register("parse_verdict", O.with_(O.OFFERS, RAW_SQL, PARSE_SQL) + """
SELECT seq, match_score, CASE WHEN NOT ok_json THEN 'not_json' WHEN s_txt IS NULL THEN 'missing_score'
  WHEN match_score IS NULL THEN 'score_not_integer' WHEN match_score < 0 OR match_score > 100 THEN 'score_out_of_range'
  WHEN skills_j IS NULL OR json_type(skills_j) = 'NULL' THEN 'missing_skills_null'
  WHEN advice IS NULL THEN 'missing_advice' END AS verdict_error,
  array_to_string(from_json(skills_j, '["VARCHAR"]'), ',') AS missing_skills, advice FROM verdicts""")
def q_parse_verdict(spark, sf):
    return sc.parse_verdict(_raw_verdicts(offers_df(spark, sf))).select(
        "seq", "match_score", "verdict_error", F.array_join("missing_skills", ",").alias("missing_skills"), "advice")


def stub_scorer(pdf):
    """A user scorer for the plug point: fails rows whose description holds no
    full stop, scores the others by description length."""
    import pandas as pd

    desc = pdf["description"].fillna("")
    has_dot = desc.str.contains(".", regex=False)
    return pd.DataFrame({
        "match_score": (desc.str.len() % 101).where(has_dot),
        "missing_skills": [[] for _ in range(len(pdf))],
        "advice": desc.str.slice(0, 20).where(has_dot),
        "error": pd.Series(["no_sentence"] * len(pdf)).where(~has_dot.to_numpy(), None).to_numpy(),
    })


@register("dead_letter", O.with_(O.OFFERS) + """
SELECT seq, 'no_sentence' AS error FROM offers
WHERE batch_id > 0 AND length(description) > 0 AND NOT contains(description, '.')""")
def q_dead_letter(spark, sf):
    o = offers_df(spark, sf).where("batch_id > 0").select("seq", "title", "description")
    scored = sc.score_offers(o.withColumn("cv_text", F.lit("")), scorer=stub_scorer)
    return sc.dead_letter(scored).select("seq", "error")


@register("score_offers_plugin", O.with_(O.OFFERS) + """
SELECT seq, CAST(length(description) % 101 AS INTEGER) AS match_score FROM offers
WHERE batch_id > 0 AND length(description) > 0 AND contains(description, '.')""")
def q_score_plugin(spark, sf):
    o = offers_df(spark, sf).where("batch_id > 0").select("seq", "title", "description")
    scored = sc.score_offers(o.withColumn("cv_text", F.lit("")), scorer=stub_scorer)
    return sc.scored_ok(scored).select("seq", "match_score")


# ---------------------------------------------------------------------------
# 2.3 pages
# ---------------------------------------------------------------------------

def _pages(spark, sf):
    return fx.table(spark, sf, "pages")


def _link_site_sql(href: str) -> str:
    from ..operators.pages import LINK_RULES
    whens = []
    for site, keep, stop in LINK_RULES:
        cond = f"contains({href}, '{keep}')" + (f" AND NOT contains({href}, '{stop}')" if stop else "")
        whens.append(f"WHEN {cond} THEN '{site}'")
    return "CASE " + " ".join(whens) + " END"


@register("page_links", O.with_(PAGE_LINKS_SQL) +
          f"SELECT page_id, page_url, pos, href, {_link_site_sql('href')} AS site FROM page_links")
def q_page_links(spark, sf):
    return _page_links_df(spark, sf)


@register("src_pages", "SELECT page_id, url, CAST(length(html) AS BIGINT) AS html_len FROM pages")
def q_src_pages(spark, sf):
    return _pages(spark, sf).select("page_id", "url", F.length("html").cast("long").alias("html_len"))


@register("links_to_details", O.with_(
    PAGE_LINKS_SQL,
    f"""det AS (SELECT page_id AS detail_page_id, split_part(url, '?', 1) AS job_url FROM pages
      UNION ALL SELECT doc_id + {2 * sp.LISTING_ID}, CASE WHEN s = 0 AND v = 2 THEN '{sp.WALL_URL}'
        ELSE {O._list(sp.DETAIL_URLS)}[s + 1] END || doc_id FROM site_docs)""") + """
SELECT l.page_id, l.pos, l.job_url, d.detail_page_id FROM (
  SELECT page_id, pos, CASE WHEN starts_with(href, 'http') THEN href
    ELSE regexp_extract(page_url, '^(https?://[^/?#]+)', 1) || href END AS job_url FROM page_links) l
LEFT JOIN det d ON d.job_url = split_part(l.job_url, '?', 1)""")
def q_links_details(spark, sf):
    from ..operators.pages import links_to_details
    details = _pages(spark, sf).select("page_id", "url").unionByName(
        sp.detail_pages(spark, sf).select("page_id", "url"))
    return links_to_details(_page_links_df(spark, sf), details)


def _elements(spark, sf):
    from ..operators.pages import parse_elements
    return parse_elements(_pages(spark, sf))


def _decode_sql(x: str) -> str:
    """The character references found in the test pages, decoded as the HTML
    parser does (``&amp`` is also valid without its semicolon)."""
    out = x
    for ent, ch in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">")):
        out = f"replace({out}, '{ent}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace({out}, '&amp;?', '&', 'g')"


def _text_nodes_sql(html: str) -> str:
    """Visible text of an HTML fragment: script/style bodies, comments and
    declarations removed, split at tags, each piece decoded and stripped,
    empty pieces dropped, joined with newlines."""
    cleaned = (f"regexp_replace({html}, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
               f"|<![^>]*>', '<>', 'g')")
    pieces = f"string_split_regex({cleaned}, '<[^>]*>')"
    return (f"array_to_string(list_filter(list_transform({pieces}, lambda x: {O.strip_sql(_decode_sql('x'))}), "
            f"lambda x: x <> ''), chr(10))")


@register("block_text", f"""
SELECT page_id, CAST(length(t) AS BIGINT) AS text_len, md5(t) AS text_md5
FROM (SELECT page_id, {_text_nodes_sql('html')} AS t FROM pages)""")
def q_block_text(spark, sf):
    e = _elements(spark, sf)
    return e.where(F.col("tag") == "#document").select("page_id", F.length("text").cast("long").alias("text_len"),
                                                       F.md5("text").alias("text_md5"))


def _longest_block_sql() -> str:
    """Oracle for the test pages' markup: blocks are the body divs, the
    article, and each paragraph. A ``<p><b>`` paragraph is never closed, so
    it runs to the end of the article; other paragraphs end at ``</p>``."""
    t = _text_nodes_sql
    p_text = (f"CASE WHEN starts_with(ps[k], '<b>') THEN {t('array_to_string(ps[k:], ' + chr(39) + '<p>' + chr(39) + ')')}"
              f" ELSE {t('split_part(ps[k], ' + chr(39) + '</p>' + chr(39) + ', 1)')} END")
    return f"""
WITH a AS (SELECT page_id, html,
             coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '') AS art,
             regexp_matches(html, '(?s)<article>') AS has_art FROM pages),
cand AS (
  SELECT page_id, 0 AS ord, {t('d')} AS text
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<div[^>]*>(.*?)</div>', 1)) AS d FROM a)
  UNION ALL SELECT page_id, 1, {t('art')} FROM a WHERE has_art
  UNION ALL SELECT page_id, 1 + k, {p_text}
  FROM (SELECT page_id, ps, unnest(range(2, len(ps) + 1)) AS k
        FROM (SELECT page_id, string_split(art, '<p>') AS ps FROM a WHERE has_art))),
ok AS (SELECT page_id, text, row_number() OVER (PARTITION BY page_id ORDER BY length(text) DESC, ord) AS rn
       FROM cand WHERE length(text) > 200 AND length(text) < 15000 AND NOT contains(text, '©'))
SELECT p.page_id, coalesce(ok.text, '') AS description FROM pages p LEFT JOIN ok ON ok.page_id = p.page_id AND rn = 1"""


@register("longest_block", _longest_block_sql())
def q_longest_block(spark, sf):
    from ..operators.pages import longest_block
    return longest_block(_elements(spark, sf), tags=("div", "article", "p"), lo=200, hi=15000,
                         stop_phrases=("©",))


@register("page_description", f"""
SELECT page_id, coalesce({_text_nodes_sql("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")}, '')
  AS description FROM pages""")
def q_page_description(spark, sf):
    from ..operators.pages import DESCRIPTION_RULES, page_description
    return page_description(_elements(spark, sf), DESCRIPTION_RULES["TheProtocol"])


# Oracle for blocks without nested divs: section divs in document order,
# else the offer-view fallback, else "".
_SEC = "regexp_extract_all(html, '(?s)<div[^>]*data-test=\"section-[^\"]*\"[^>]*>(.*?)</div>', 1)"
_FB = ("regexp_extract(html, '(?s)<div[^>]*(id=\"offer-view\"|class=\"offer-view\")[^>]*>(.*?)</div>', 2)")


_D = O.strip_sql("text")


@register("join_sections", O.with_(sp.SITE_DOCS_SQL) + f"""
SELECT page_id, CASE WHEN len({_SEC}) > 0
  THEN array_to_string(list_transform({_SEC}, lambda b: {_text_nodes_sql('b')}), chr(10) || chr(10))
  WHEN regexp_matches(html, '(?s)<div[^>]*(id="offer-view"|class="offer-view")[^>]*>')
  THEN {_text_nodes_sql(_FB)} ELSE '' END AS description FROM pages
UNION ALL SELECT doc_id + {2 * sp.LISTING_ID},
  CASE WHEN s <> 5 THEN '' WHEN v = 0 THEN {_D} || chr(10) || chr(10) || 'second' ELSE {_D} END FROM site_docs""")
def q_join_sections(spark, sf):
    from ..operators.pages import join_sections, parse_elements
    cols = ["page_id", "html"]
    pages = _pages(spark, sf).select(*cols).unionByName(sp.detail_pages(spark, sf).select(*cols))
    return join_sections(parse_elements(pages, ("div",)))


_DESCRIBED_SQL = f"""described AS (SELECT *, CASE
    WHEN s = 0 THEN CASE WHEN v < 2 THEN d ELSE '' END
    WHEN s = 1 THEN CASE WHEN v IN (0, 2) AND length(d) > 200 AND length(d) < 15000 AND NOT contains(d, 'Sign in') THEN d
      ELSE '' END
    WHEN s = 5 AND v = 0 THEN d || chr(10) || chr(10) || 'second'
    WHEN s = 5 OR v < 3 THEN d ELSE '' END AS found
  FROM (SELECT *, {_D} AS d, {O._list(sp.SITES)}[s + 1] AS site FROM site_docs))"""


@register("site_descriptions", O.with_(sp.SITE_DOCS_SQL, _DESCRIBED_SQL) + f"""
SELECT page_id, site, generation, md5(description) AS description_md5 FROM (
  SELECT doc_id + {2 * sp.LISTING_ID} AS page_id, site, 'current' AS generation, CASE WHEN s = 0 AND v = 2
    THEN 'Błąd: LinkedIn wyświetlił ekran logowania. Nie można pobrać opisu.' ELSE found END AS description FROM described
  UNION ALL SELECT doc_id + {2 * sp.LISTING_ID}, site, 'legacy',
    CASE WHEN s = 0 THEN 'Opis dostępny bezpośrednio na LinkedIn (Guest Mode).'
         WHEN found = '' OR (s = 1 AND contains(found, 'Offers with salary')) THEN 'Brak opisu dla ' || site || '.'
         ELSE found END FROM described)""")
def q_site_descriptions(spark, sf):
    from ..operators.pages import site_descriptions
    details = sp.detail_pages(spark, sf)
    both = [site_descriptions(details, legacy=g == "legacy").withColumn("generation", F.lit(g))
            for g in ("current", "legacy")]
    return both[0].unionByName(both[1]).select("page_id", "site", "generation",
                                               F.md5("description").alias("description_md5"))


_T1, _CO, _LA = O.strip_sql("t1"), O.strip_sql("source"), O.strip_sql("lang")
_CARD_ROWS_SQL = f"""cards AS (
  SELECT *, {_T1} AS t, {_CO} AS co, {_LA} AS la, CAST(doc_id AS VARCHAR) AS n FROM site_docs),
offered AS (
  SELECT doc_id, g, {O._list(sp.SITES)}[s + 1] AS site, CASE s
      WHEN 0 THEN 'https://linkedin.example.org/jobs/view/' || n
      WHEN 1 THEN 'https://justjoin.it/job-offer/' || n WHEN 2 THEN 'https://nofluffjobs.com/pl/job/' || n
      WHEN 3 THEN 'https://bulldogjob.pl/companies/jobs/' || n || CASE WHEN v = 0 THEN '?a=1&b=2' ELSE '' END
      WHEN 4 THEN 'https://theprotocol.it/szczegoly/praca/' || n
      ELSE 'https://it.pracuj.pl/o/' || n || CASE WHEN g = 'current' THEN '' WHEN v = 2 THEN '?s=2' ELSE '?s=1' END
    END AS job_url,
    CASE WHEN s = 0 AND v = 2 THEN CASE g WHEN 'current' THEN 'Unknown' ELSE 'Nieznane' END
      WHEN s = 1 AND v = 0 THEN {O.strip_sql("t1 || CASE g WHEN 'current' THEN ' 20 000' ELSE ' 20 000 PLNs' END")}
      WHEN s = 1 AND g = 'current' THEN {O.strip_sql("split_part(t1, 'PLN', 1)")}
      WHEN s = 4 AND v = 2 THEN t || 'x' ELSE t END AS title,
    CASE s WHEN 0 THEN CASE WHEN v <> 2 THEN co WHEN g = 'current' THEN 'Unknown' ELSE 'Nieznana' END
      WHEN 1 THEN 'JJIT Listing' WHEN 2 THEN 'NFJ Listing' WHEN 3 THEN 'BulldogJob' WHEN 4 THEN 'TheProtocol'
      ELSE 'Pracuj.pl Listing' END AS company,
    CASE WHEN s = 0 AND g = 'legacy' AND v <> 2 THEN la ELSE 'Katowice' END AS location
  FROM cards, (VALUES ('current'), ('legacy')) t(g)
  WHERE s = 0 OR (s = 1 AND v < 3) OR (s = 2 AND v IN (0, 3)) OR (s = 3 AND v < 2) OR (s = 4 AND v IN (0, 2))
     OR (s = 5 AND (v IN (0, 3) OR (v = 2 AND g = 'legacy'))))"""


@register("site_cards", O.with_(sp.SITE_DOCS_SQL, _CARD_ROWS_SQL) + f"""
SELECT doc_id + {sp.LISTING_ID} AS page_id, g AS generation, site, job_url, title, company, location FROM offered""")
def q_site_cards(spark, sf):
    from ..operators.pages import SITE_CARD_RULES, SITE_CARD_RULES_LEGACY, card_offers, page_cards
    listing = sp.listing_pages(spark, sf)
    both = [card_offers(page_cards(listing, rules=rules), rules=rules, search_place="Katowice").withColumn(
        "generation", F.lit(g)) for g, rules in (("current", SITE_CARD_RULES), ("legacy", SITE_CARD_RULES_LEGACY))]
    return both[0].unionByName(both[1]).select("page_id", "generation", "site", "job_url", "title", "company", "location")


CRAWLS = ((1, "page_id % 5 < 2"), (2, "true"))  # an early crawl of some pages, a later one of all


def _crawl_sql(select: str) -> str:
    """Two crawls of the plan's listing pages; the second knows the first one's addresses."""
    plan = _search_plan_sql()
    head, body = plan[:plan.index("\nSELECT DISTINCT profile_id, site, url FROM (")], plan[plan.index("\nSELECT DISTINCT profile_id"):]
    pairs = MATCHED_PAIRS.replace("FROM offers WHERE title", "FROM site_cards WHERE title")
    ctes = [f"plan AS MATERIALIZED ({body})", sp.SITE_DOCS_SQL, _DESCRIBED_SQL, _CARD_ROWS_SQL, f"""
numbered AS (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY url) - 1 AS k, count(*) OVER (PARTITION BY site) AS n
  FROM (SELECT DISTINCT site, url FROM plan)),
own AS (SELECT doc_id, doc_id // 6 AS turn, {O._list(sp.SITES)}[s + 1] AS site FROM site_docs),
pages_of AS MATERIALIZED (SELECT o.doc_id, o.doc_id + {sp.LISTING_ID} AS page_id, o.site, u.url FROM own o JOIN numbered u ON u.site = o.site AND u.k = o.turn % u.n
  WHERE o.turn % 9 <> 8),
site_cards AS MATERIALIZED (SELECT f.doc_id AS seq, p.page_id, p.site, p.url, f.job_url, f.title, f.company FROM offered f JOIN pages_of p USING (doc_id)
  WHERE f.g = 'current')""", pairs, """
matched AS MATERIALIZED (SELECT m.profile_id, c.page_id, c.seq, c.site, c.job_url, c.title, c.company, coalesce(s.location, '') AS location
  FROM pairs m JOIN site_cards c USING (seq) JOIN plan p ON p.profile_id = m.profile_id AND p.site = c.site AND p.url = c.url JOIN profiles s ON s.profile_id = m.profile_id)"""]
    known = "SELECT NULL::BIGINT AS profile_id, NULL AS job_url WHERE false"
    for k, pages in CRAWLS:
        ctes.append(f"seen{k} AS ({known})")
        ctes.append(f"cards{k} AS (SELECT * FROM site_cards WHERE {pages})")
        ctes.append(f"matches{k} AS MATERIALIZED (SELECT m.*, EXISTS (SELECT 1 FROM seen{k} x WHERE x.profile_id = m.profile_id AND x.job_url = m.job_url) AS is_seen, "
                    f"NOT ({VALID}) AS refused FROM matched m WHERE {pages})")
        # the last repeat of a search's offer stays
        ctes.append(f"fresh{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, {', '.join(O.DEDUPE_KEYS)} ORDER BY page_id DESC) AS rn "
                    f"FROM matches{k} WHERE NOT is_seen AND NOT refused) WHERE rn = 1)")
        ctes.append(f"added{k} AS MATERIALIZED (SELECT f.*, CASE WHEN d.s = 0 AND d.v = 2 THEN 'signin_wall' WHEN {O.strip_sql('d.found')} = '' THEN 'missing' "
                    f"ELSE 'ok' END AS status, d.found FROM fresh{k} f JOIN described d ON d.doc_id = f.seq)")
        known = f"SELECT profile_id, job_url FROM added{k}"
    return head + ",\n" + ",\n".join(ctes) + "\n" + " UNION ALL ".join(select.format(k=k) for k, _ in CRAWLS)


def _crawls(spark, sf):
    from .crawl import crawl_offers
    searches = fx.levelled_profiles(spark, sf)
    plan = se.search_plan(se.compiled_profiles(searches)).checkpoint()  # the pages' addresses and the crawls read it
    listing, details = sp.asked_listing_pages(spark, sf, plan), sp.detail_pages(spark, sf)
    seen = None
    for k, pages in CRAWLS:
        crawl = crawl_offers(listing.where(pages), details, searches, seen, plan)
        crawl.offers = crawl.offers.checkpoint()
        seen = crawl.offers.select("profile_id", "job_url")
        yield k, crawl


@register("site_offers", _crawl_sql("""
SELECT {k} AS crawl, profile_id, page_id, site, job_url, title, company, location, status, CASE WHEN status = 'ok' THEN md5(found) END AS description_md5 FROM added{k}"""))
def q_site_offers(spark, sf):
    """Listing pages of every search's plan through cards, match, seen check, detail pages and status, in two crawls."""
    out = [c.offers.select(F.lit(k).alias("crawl"), "profile_id", "page_id", "site", "job_url", "title", "company", "location", "status",
                           F.md5("description").alias("description_md5")) for k, c in _crawls(spark, sf)]
    return out[0].unionByName(out[1])


@register("crawl_funnel", _crawl_sql("""
SELECT {k} AS crawl, site, sum(cards) AS cards, sum(matched) AS matched, sum(seen) AS seen, sum(refused) AS refused, sum(added) AS added, sum(described) AS described FROM (
  SELECT site, 1 AS cards, 0 AS matched, 0 AS seen, 0 AS refused, 0 AS added, 0 AS described FROM cards{k}
  UNION ALL SELECT site, 0, 1, is_seen::INTEGER, (NOT is_seen AND refused)::INTEGER, 0, 0 FROM matches{k}
  UNION ALL SELECT site, 0, 0, 0, 0, 1, (status = 'ok')::INTEGER FROM added{k}) GROUP BY ROLLUP (site)"""))
def q_crawl_funnel(spark, sf):
    from .crawl import crawl_funnel
    out = [crawl_funnel(c).select(F.lit(k).alias("crawl"), "*") for k, c in _crawls(spark, sf)]
    return out[0].unionByName(out[1])


# A card rule for the test pages: every link is a card, title by h2, span,
# else the link text (the JustJoinIT fallback chain without its marker).
ANCHOR_CARDS = dict(site="Anchors", container=[("a", "href", None, "any")], link=None,
                    title=[("h2", None, None, "eq"), ("span", None, None, "eq")], title_self=True,
                    company_const="Anchors")


# Oracle reading of the anchor cards: the test pages' links hold plain text
# (no nested tags or entities at any sf), so href and text come from one
# regex, in document order.
ANCHOR_SQL = """anchors AS (
  SELECT page_id, i - 1 AS link_no, h[i] AS href, t[i] AS title
  FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h,
               regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2) AS t FROM pages) p,
       range(1, len(h) + 1) r(i))"""


def _anchor_cards(spark, sf, more=None):
    from ..operators.pages import page_cards
    from pyspark.sql import Window
    pages = _pages(spark, sf).select("page_id", "html")
    cards = page_cards(pages if more is None else pages.unionByName(more), ANCHOR_CARDS)
    w = Window.partitionBy("page_id").orderBy("pos")  # cards of one page: bounded by the page
    return cards.withColumn("link_no", (F.row_number().over(w) - 1).cast("long"))


@register("page_cards", O.with_(ANCHOR_SQL) +
          "SELECT page_id, link_no, href, " + O.strip_sql("title") + " AS title, 'Anchors' AS company FROM anchors")
def q_page_cards(spark, sf):
    return _anchor_cards(spark, sf).select("page_id", "link_no", "href", "title", "company")


@register("link_title", O.with_(ANCHOR_SQL, sp.SITE_DOCS_SQL) + "SELECT page_id, link_no, " +
          O.strip_sql("split_part(split_part(title, chr(10), 1), 'PLN', 1)") + f""" AS title FROM anchors
UNION ALL SELECT doc_id + {sp.LISTING_ID}, 0,
  {O.strip_sql("split_part(t1 || CASE WHEN v = 0 THEN ' 20 000' ELSE '' END, 'PLN', 1)")} FROM site_docs WHERE s = 1""")
def q_link_title(spark, sf):
    listing = sp.listing_pages(spark, sf).where("site = 'JustJoinIT'").select("page_id", "html")
    cards = _anchor_cards(spark, sf, listing)
    return cards.select("page_id", "link_no", tx.clean_listing_title("title").alias("title"))


# A seventh site, as rows only: every link of the crawled pages is a card, its text the title; articles are descriptions.
NEW_SITE = "Example"
NEW_SITE_ROWS = [(NEW_SITE, "container", 0, "a", "href", "any", None), (NEW_SITE, "title", 0, "h2", None, "none", None),
                 (NEW_SITE, "title", 1, "span", None, "none", None), (NEW_SITE, "setting", 0, None, "title_self", None, "true"),
                 (NEW_SITE, "setting", 0, None, "company_const", None, "Example Listing"),
                 (NEW_SITE, "description", 0, "article", None, "none", None)]


def _seven_sites(spark, sf):
    from ..operators.site_rules import RULE, builtin_rules
    rules = builtin_rules(spark).unionByName(spark.createDataFrame(NEW_SITE_ROWS, RULE))
    crawled = _pages(spark, sf).select("page_id", F.lit(NEW_SITE).alias("site"), "html")
    cols = ["page_id", "site", "html"]
    return (rules, sp.listing_pages(spark, sf).select(*cols).unionByName(crawled),
            sp.detail_pages(spark, sf).select(*cols).unionByName(crawled))


@register("site_rules", O.with_(ANCHOR_SQL, sp.SITE_DOCS_SQL, _CARD_ROWS_SQL, _DESCRIBED_SQL) + f"""
SELECT 'card' AS kind, doc_id + {sp.LISTING_ID} AS page_id, site, job_url, title, company, location FROM offered WHERE g = 'current'
UNION ALL SELECT 'card', page_id, '{NEW_SITE}', href, {O.strip_sql('title')}, 'Example Listing', 'Katowice' FROM anchors
UNION ALL SELECT 'description', doc_id + {2 * sp.LISTING_ID}, site, NULL, md5(found), NULL, NULL FROM described
UNION ALL SELECT 'description', page_id, '{NEW_SITE}', NULL, md5(description), NULL, NULL FROM ({ORACLES['page_description']})""")
def q_site_rules(spark, sf):
    """Cards and descriptions of seven sites by a table of rules; the seventh is added as rows."""
    from ..operators.site_rules import cards_by_rules, descriptions_by_rules, offers_of_cards
    rules, listing, details = _seven_sites(spark, sf)
    cards = offers_of_cards(cards_by_rules(listing, rules), rules, "Katowice")
    none = lambda c: F.lit(None).cast("string").alias(c)
    texts = descriptions_by_rules(details, rules)
    return cards.select(F.lit("card").alias("kind"), "page_id", "site", "job_url", "title", "company", "location").unionByName(
        texts.select(F.lit("description").alias("kind"), "page_id", "site", none("job_url"), F.md5("description").alias("title"),
                     none("company"), none("location")))


def title_plugin(page_id, url, html):
    """Extractor plug-in example: the <h1> text of a page."""
    import re
    m = re.search(r"<h1[^>]*>(.*?)</h1>", html or "", re.S)
    return [(page_id, url, m.group(1).strip() if m else None)]


@register("extractor_plugin", """
SELECT page_id, url, CASE WHEN regexp_matches(html, '(?s)<h1[^>]*>(.*?)</h1>')
  THEN """ + O.strip_sql("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)") + """ END AS h1 FROM pages""")
def q_extractor(spark, sf):
    from ..operators.pages import run_extractor
    return run_extractor(_pages(spark, sf), title_plugin, "page_id long, url string, h1 string")


# ---------------------------------------------------------------------------
# 2.1 sources and sinks (round trips through the shared folder)
# ---------------------------------------------------------------------------

@register("src_history", O.with_(
    O.OFFERS, "imported AS (SELECT * REPLACE (-1 AS batch_id) FROM offers WHERE batch_id = 0)",
    "both_ AS (SELECT * FROM imported UNION ALL SELECT * FROM offers WHERE batch_id = 1)",
    f"p1 AS {O.keep_last_sql('both_', ['job_url'])}") +
    f"SELECT title, job_url, md5(description) AS description_md5, batch_id FROM {O.keep_last_sql('p1', O.DEDUPE_KEYS)}")
def q_src_history(spark, sf):
    """The history as JSON arrays of up to 1,000 offers a file, read back, in file order, and merged with a batch."""
    from ..session import scratch_path
    from ..sources import io
    path = scratch_path(spark, "history_json")
    cols = ["title", "company", "location", "job_url", "site", "description", "posted_at"]
    offers = offers_df(spark, sf)
    files = (offers.where("batch_id = 0").groupBy(
        F.lpad(F.floor(F.col("seq") / 1000).cast("string"), 12, "0").alias("part"))
             .agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("seq", *cols))), lambda o: F.struct(
                 *[o[c].alias(c) for c in cols]))).alias("value")))
    files.repartition("part").write.mode("overwrite").partitionBy("part").text(path)
    good, rejects = io.import_history(spark, path)
    if not rejects.isEmpty():
        raise ValueError("the history written here holds records that cannot be read")
    merged = st.merge_history(good, offers.where("batch_id = 1").select(*good.columns))
    return merged.select("title", "job_url", F.md5("description").alias("description_md5"), "batch_id")


@register("snk_history", ORACLES["merge_history"])
def q_snk_history(spark, sf):
    """The raw history as a log's first version, a batch merged into it, read back."""
    log = _history_log(spark, sf, "history")
    log.append(_logged_offers(spark, sf).where("batch_id > 0"))
    return log.read().select("seq", "job_url")


def _logged_offers(spark, sf):
    from .pipeline import OFFER_COLS
    return offers_df(spark, sf).select(*OFFER_COLS)


def _history_log(spark, sf, name: str):
    from ..session import scratch_path
    from ..sources.history_log import HistoryLog
    o = _logged_offers(spark, sf)
    log = HistoryLog(spark, scratch_path(spark, name), o.schema)
    log.create(o.where("batch_id = 0"))
    return log


LOG_BATCHES = 20


def _log_sql() -> str:
    """The history merged with 20 batches, one after another."""
    ctes = [O.OFFERS, "c0 AS (SELECT * FROM offers WHERE batch_id = 0)"]
    for k in range(LOG_BATCHES):
        ctes.append(f"u{k} AS (SELECT * FROM c{k} UNION ALL SELECT * FROM offers WHERE batch_id > 0 AND seq // 4 % {LOG_BATCHES} = {k})")
        ctes.append(f"v{k} AS {O.keep_last_sql(f'u{k}', ['job_url'])}")
        ctes.append(f"c{k + 1} AS MATERIALIZED {O.keep_last_sql(f'v{k}', O.DEDUPE_KEYS)}")
    return O.with_(*ctes) + f"SELECT seq, batch_id, job_url FROM c{LOG_BATCHES}"


@register("history_log", _log_sql())
def q_history_log(spark, sf):
    """20 batches, each written as what it changes, with compaction on the way and old versions pruned."""
    log = _history_log(spark, sf, "history_log")
    new = _logged_offers(spark, sf).where("batch_id > 0")
    for k in range(LOG_BATCHES):
        log.append(new.where(F.floor(F.col("seq") / 4) % LOG_BATCHES == k))
        log.compact()
    log.prune()
    return log.read().select("seq", "batch_id", "job_url")


@register("seen_ledger", O.with_(O.OFFERS, HIST_URLS) + """
SELECT seq, job_url, EXISTS (SELECT 1 FROM hist h WHERE h.job_url = o.job_url) AS is_seen FROM offers o WHERE batch_id > 0""")
def q_seen_ledger(spark, sf):
    """The history's addresses committed in four parts; new and known offers by the buckets whose filters answer."""
    from ..session import scratch_path
    from ..sources.seen_ledger import SeenLedger
    o = offers_df(spark, sf)
    ledger = SeenLedger(spark, scratch_path(spark, "seen_ledger"))
    for k in range(4):
        ledger.add(o.where((F.col("batch_id") == 0) & (F.floor(F.col("seq") / 4) % 4 == k)))
    batch = o.where("batch_id > 0")
    parts = [part.select("seq", "job_url", F.lit(seen).alias("is_seen"))
             for part, seen in ((ledger.new_offers(batch), False), (ledger.known_offers(batch), True))]
    return parts[0].unionByName(parts[1])


@register("snk_working_set", ORACLES["flagship"])
def q_snk_working(spark, sf):
    from ..session import scratch_path
    from ..sources import io
    path = scratch_path(spark, "working_set")
    fs = flagship(offers_df(spark, sf))
    io.write_working_set(fs, path)
    return spark.read.schema(fs.schema).json(path)


@register("snk_results", O.with_(O.OFFERS, O.PROFILES, O.COMPILED, MATCHED_PAIRS, O.RESUMES, SCORED_SQL) + """
SELECT o.batch_id, profile_id, seq, s.company, s.title, s.job_url AS url, s.location, match_score, missing_skills, advice
FROM scored s JOIN offers o USING (seq)""")
def q_snk_results(spark, sf):
    """Two appends by batch, the second one repeating a batch of the first."""
    from ..session import scratch_path
    from ..sources import io
    path = scratch_path(spark, "results")
    res = sc.to_result(_scored_pairs(spark, sf))
    io.append_results(res.where("batch_id < 2"), path)
    io.append_results(res.where("batch_id > 0"), path)
    back = spark.read.parquet(path)
    return back.select(F.col("batch_id").cast("long"), "profile_id", "seq", "company", "title", "url", "location",
                       F.col("analysis.match_score").alias("match_score"),
                       F.array_join("analysis.missing_skills", ",").alias("missing_skills"),
                       F.col("analysis.advice").alias("advice"))


@register("src_results", O.with_(O.OFFERS, O.PROFILES, O.COMPILED, MATCHED_PAIRS, O.RESUMES, SCORED_SQL) +
          "SELECT DISTINCT job_url AS url FROM scored")
def q_src_results(spark, sf):
    """The results as JSON lines, one for each pair, read back."""
    from ..session import scratch_path
    from ..sources import io
    path = scratch_path(spark, "results_json")
    io.write_results(sc.to_result(_scored_pairs(spark, sf)), path, "seq")
    back = io.read_results(spark, path, array=False)
    return back.select("url").where(F.col("url").isNotNull()).distinct()


@register("src_profiles", O.with_(O.PROFILES) + """
SELECT profile_id, 'Katowice' AS location, false AS remote_only, 14 AS max_days_old,
       CAST(len(job_titles) AS INTEGER) AS n_titles, CAST(len(exclude_keywords) AS INTEGER) AS n_excludes FROM profiles""")
def q_src_profiles(spark, sf):
    from ..session import scratch_path
    from ..sources import io
    path = scratch_path(spark, "profiles_json")
    fx.profiles(spark, sf).select("profile_id", "job_titles", "exclude_keywords").write.mode("overwrite").json(path)
    p = io.read_profiles(spark, path)
    return p.select("profile_id", "location", "remote_only", "max_days_old",
                    F.size("job_titles").alias("n_titles"), F.size("exclude_keywords").alias("n_excludes"))


@register("src_resumes", O.with_(O.PROFILES, O.RESUMES) +
          "SELECT profile_id, md5(regexp_replace(cv_text, '\\n+$', '')) AS cv_md5 FROM resumes")
def q_src_resumes(spark, sf):
    """CVs in few sorted files with an index; how one is read is tested."""
    from ..session import scratch_path
    from ..sources import io, ranged
    path = scratch_path(spark, "resumes")
    ranged.write_ranged(fx.resumes(spark, sf).select("profile_id", io.cv_text("cv_text").alias("cv_text")), path, "profile_id")
    return ranged.read_ranged(spark, path).select("profile_id", F.md5("cv_text").alias("cv_md5"))


@register("snk_report", f"SELECT profile_id, html FROM ({ORACLES['report_html']})")
def q_snk_report(spark, sf):
    """The lines read back, lost and doubled ones included; their order, and reading one search, is tested."""
    from ..session import scratch_path
    from ..sources import ranged
    path = scratch_path(spark, "report")
    ranged.write_ranged(q_report(spark, sf), path, "profile_id", ["ord"])
    return ranged.read_ranged(spark, path).select("profile_id", "html")


# ---------------------------------------------------------------------------
# 2.10 streaming
# ---------------------------------------------------------------------------

@register("stream_ingest", ORACLES["incremental_run"])
def q_stream(spark, sf):
    from ..session import scratch_path
    from ..streaming.ingest import offer_stream_schema, seed_state, stream_ingest
    from .pipeline import OFFER_COLS
    o = offers_df(spark, sf).select(*OFFER_COLS)
    src, state_dir, ckpt = (scratch_path(spark, n) for n in ("stream_src", "stream_state", "stream_ckpt"))
    seed_state(o.where("batch_id = 0"), state_dir)
    o.where("batch_id > 0").write.mode("overwrite").parquet(src)
    out = stream_ingest(spark, src, offer_stream_schema(o), state_dir, ckpt, FLAGSHIP_GROUPS, FLAGSHIP_EXCLUDES)
    return out.select("seq", "batch_id", "job_url")



def _search_plan_legacy_sql() -> str:
    loc = "coalesce(location, '')"
    lloc = f"lower({loc})"
    rem = "coalesce(remote_only, false)"
    junior = f"coalesce(list_has_any(flatten(groups), {O._list(se.JUNIOR_WORDS_LEGACY)}), false)"
    first = "coalesce(groups[1], []::VARCHAR[])"
    kw = (f"CASE WHEN len(groups) = 0 THEN 'Data' WHEN length(array_to_string({first}, ' ')) > 50 "
          f"THEN {first}[1] ELSE array_to_string({first}, ' ') END")
    kato = f"contains({loc}, 'Katowice')"
    qp = f"replace(url_encode({kw}), '%20', '+')"

    def sorted_join(rule_set, sep):
        return f"array_to_string(list_sort({_topics_sql('groups', rule_set)}), '{sep}')"

    def topics(rule_set):
        return f"(SELECT *, unnest({_topics_sql('groups', rule_set)}) AS t FROM compiled)"

    return O.with_(O.LEVELLED, O.COMPILED) + f"""
SELECT DISTINCT profile_id, site, url FROM (
  SELECT profile_id, 'LinkedIn' AS site, 'https://www.linkedin.com/jobs/search/?keywords=' || {qp} || '&geoId='
     || CASE WHEN {kato} THEN '90009829' ELSE '105072130' END
     || '&f_TPR=r2592000&f_E=1%2C2&f_F=it&origin=JOB_SEARCH_PAGE_JOB_FILTER&refresh=true'
     || CASE WHEN {kato} THEN '&f_PP=103855053' ELSE '' END || CASE WHEN {rem} THEN '&f_WT=2' ELSE '' END AS url
  FROM compiled WHERE {kato} OR {loc} = '' OR {rem}
  UNION ALL
  SELECT profile_id, 'JustJoinIT', 'https://justjoin.it/job-offers/' || CASE WHEN {loc} = '' OR {rem}
     THEN 'all-locations' ELSE {lloc} END || '/' || t || '?' || array_to_string(list_filter([
       CASE WHEN {rem} THEN 'workplaceType=remote' END, CASE WHEN {junior} THEN 'experience-level=junior' END,
       CASE WHEN NOT {rem} AND {loc} <> '' THEN 'radius=0' END, 'orderBy=DESC', 'sortBy=published'],
       lambda z: z IS NOT NULL), '&') FROM {topics('legacy_justjoinit')}
  UNION ALL
  SELECT profile_id, 'NoFluffJobs', 'https://nofluffjobs.com/pl/' || CASE WHEN {rem} THEN 'remote/' WHEN {lloc} <> ''
     THEN {lloc} || '/' ELSE '' END || t || CASE WHEN {junior} THEN '?criteria=seniority%3Dtrainee,junior' ELSE '' END
  FROM {topics('legacy_nofluffjobs')}
  UNION ALL
  SELECT profile_id, 'TheProtocol', 'https://theprotocol.it/filtry/' || t || ';sp'
     || CASE WHEN {junior} THEN '/trainee,assistant,junior;p' ELSE '' END
     || CASE WHEN {rem} THEN '/remote;wm' WHEN {loc} <> '' THEN '/' || {lloc} || ';wp' ELSE '' END
  FROM {topics('legacy_theprotocol')}
  UNION ALL
  SELECT profile_id, 'BulldogJob', 'https://bulldogjob.pl/companies/jobs/s/' || array_to_string(list_filter([
     CASE WHEN {rem} THEN 'remote,true' WHEN {loc} <> '' THEN 'city,' || {loc} END,
     'role,' || {sorted_join('legacy_bulldogjob', ',')},
     CASE WHEN {junior} THEN 'experienceLevel,intern,junior' END], lambda z: z IS NOT NULL), '/') FROM compiled
  UNION ALL
  SELECT profile_id, 'Pracuj.pl', 'https://it.pracuj.pl/praca/' || CASE WHEN {rem} THEN 'praca%20zdalna;wm,home-office'
     WHEN {loc} <> '' THEN {lloc} || ';wp' ELSE '' END || '?' || array_to_string(list_filter([
       'rd=0', CASE WHEN {junior} THEN 'et=1%2C3%2C17' END, 'its=' || {sorted_join('legacy_pracujpl', '%2C')},
       CASE WHEN NOT {rem} THEN 'wm=full-office%2Chybrid' END], lambda z: z IS NOT NULL), '&')
  FROM compiled)"""


@register("search_plan_legacy", _search_plan_legacy_sql())
def q_search_plan_legacy(spark, sf):
    return se.search_plan(se.compiled_profiles(fx.levelled_profiles(spark, sf)), legacy=True)
