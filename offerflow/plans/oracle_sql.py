"""SQL building blocks for the DuckDB oracles (same derivations as
``sources.fixtures``, written in plain SQL over the raw driver tables)."""

from __future__ import annotations

from ..functions.text import NOT_WORD, PY_SPACE
from ..sources.fixtures import FIXTURE_PROFILES, OFFER_BASE_URL


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_SPACE}+|{PY_SPACE}+$', '', 'g')"


def norm_sql(x: str) -> str:
    return strip_sql(f"lower({x})")


def word_re_sql(alts: list[str]) -> str:
    """Unicode whole-word alternation (RE2 has ASCII \\b only)."""
    return f"'(^|{NOT_WORD})({'|'.join(alts)})({NOT_WORD}|$)'"


_URL_ID = "(doc_id - CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END)"

OFFERS = f"""offers AS (
  SELECT doc_id AS seq, doc_id % 4 AS batch_id, doc_id % 2 AS source_rank,
    split_part(text, chr(10), 1) AS title,
    source AS company, lang AS location,
    '{OFFER_BASE_URL}' || CAST({_URL_ID} AS VARCHAR) || '?ref=' || CAST(doc_id % 3 AS VARCHAR) AS raw_url,
    '{OFFER_BASE_URL}' || CAST({_URL_ID} AS VARCHAR) AS job_url,
    'site' || CAST(doc_id % 7 AS VARCHAR) AS site,
    CASE WHEN doc_id % 29 = 0 THEN NULL ELSE text END AS description,
    CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS TIMESTAMP) AS posted_ts,
    strftime(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER), '%Y-%m-%d') AS posted_at,
    doc_id % 5 = 0 AS is_remote
  FROM documents)"""


def _list(xs: list[str]) -> str:
    if not xs:
        return "[]::VARCHAR[]"
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _fixture_values() -> str:
    rows = []
    for pid, titles, levels, excl, loc, remote, days, skills in FIXTURE_PROFILES:
        rows.append(f"({pid}::BIGINT, {_list(titles)}, {_list(levels)}, {_list(excl)}, '{loc}', "
                    f"{'true' if remote else 'false'}, {days}, {_list(skills)})")
    return ",\n    ".join(rows)


PROFILES = f"""profiles AS (
  SELECT * FROM (VALUES
    {_fixture_values()}
  ) t(profile_id, job_titles, experience_levels, exclude_keywords, location, remote_only, max_days_old, skills)
  UNION ALL
  SELECT item_id + 100, list_filter(w, lambda x: length(x) >= 10), []::VARCHAR[], list_filter(w, lambda x: length(x) = 9),
         CASE WHEN item_id % 2 = 0 THEN 'Katowice' ELSE 'Warszawa' END,
         item_id % 3 = 0, 14, list_filter(w, lambda x: length(x) = 5)
  FROM (SELECT item_id, list_transform(list_filter(list_zip(a, range(1, len(a) + 1)), lambda p: list_position(a, p[1]) = p[2]),
                                       lambda p: p[1]) AS w
        FROM (SELECT item_id, regexp_extract_all(lower(text), '(\\p{{L}}+)', 1) AS a FROM benchmark)))"""

COMPILED = """compiled AS (
  SELECT *,
    list_filter([list_transform(job_titles, lambda x: lower(x)),
                 list_transform(experience_levels, lambda x: lower(x))], lambda g: len(g) > 0) AS groups,
    list_transform(exclude_keywords, lambda x: lower(x)) AS excludes
  FROM profiles)"""

PLACED = """placed AS (
  SELECT * REPLACE (CASE WHEN seq % 47 <> 11 THEN title END AS title, CASE WHEN seq % 53 <> 13 THEN company END AS company,
    CASE WHEN seq % 59 = 17 THEN NULL WHEN seq % 3 = 0 THEN 'Katowice' ELSE 'Warszawa' END AS location,
    CASE WHEN seq % 61 <> 19 THEN site END AS site,
    CASE WHEN seq % 37 = 5 THEN NULL WHEN seq % 41 = 7 THEN 'ftp://jobs.example.org/x'
         WHEN seq % 43 = 9 THEN job_url || '/' || repeat('x', 2083) ELSE job_url END AS job_url)
  FROM offers)"""

#: The searches with levels for every third (takes the place of PROFILES).
LEVELLED = PROFILES.replace("profiles AS (", "plain_profiles AS (", 1) + """,
profiles AS (SELECT * REPLACE (CASE WHEN profile_id % 3 = 0 THEN ['Junior', 'Regular'] ELSE experience_levels END
  AS experience_levels) FROM plain_profiles)"""

RESUMES = """resumes AS (
  SELECT p.profile_id, b.text AS cv_text FROM profiles p
  JOIN benchmark b ON b.item_id = CASE WHEN p.profile_id >= 100 THEN p.profile_id - 100 ELSE p.profile_id END)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def kw_hit_sql(title: str, kw: str) -> str:
    """Current-generation keyword test on a lowered title."""
    return (f"CASE WHEN length({kw}) <= 3 THEN regexp_matches({title}, "
            f"'(^|{NOT_WORD})' || regexp_escape({kw}) || '({NOT_WORD}|$)') "
            f"ELSE contains({title}, {kw}) END")


def search_match_sql(title: str, groups: str, excludes: str, mode: str = "word") -> str:
    t = f"lower({title})"
    hit = kw_hit_sql(t, "kw") if mode == "word" else f"contains({t}, kw)"
    return (
        f"({title} IS NOT NULL"
        f" AND NOT coalesce(list_bool_or(list_transform({excludes}, lambda e: contains({t}, e))), false)"
        f" AND coalesce(list_bool_and(list_transform({groups}, lambda g: "
        f"coalesce(list_bool_or(list_transform(g, lambda kw: {hit})), false))), true))"
    )


def keep_last_sql(src: str, keys: list[str], keep: str = "last") -> str:
    """Rows of src that are last (first) per key in arrival order."""
    direction = "DESC" if keep == "last" else "ASC"
    return (f"(SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} "
            f"ORDER BY batch_id {direction}, source_rank {direction}, seq {direction}) AS _rn FROM {src}) "
            f"WHERE _rn = 1)")


DEDUPE_KEYS = [norm_sql("title"), norm_sql("company"), "location"]
