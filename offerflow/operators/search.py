"""Saved searches: text form, compiled form and title matching.

A saved search is one row of a profile table. Its compiled form is
``groups: array<array<string>>`` (conjunctive normal form: every group needs
one hit) and ``excludes: array<string>`` (any substring hit rejects).

Two matching paths:

* :func:`match_words` / :func:`match_substring`: one literal search as a
  plain column predicate (patterns built once on the driver, pushed below
  everything else).
* :func:`match_profiles`: many searches held in a table. Terms are exploded
  and joined to title tokens / title n-grams by *equality*, then verified, so
  the cost grows with offers + terms rather than offers x terms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PY_SPACE, py_regex_escape, py_strip

# Words that mark a junior search (exact keyword equality).
JUNIOR_WORDS_CURRENT = ["junior", "intern", "staż", "trainee", "młodszy", "assistant", "praktyka", "stażysta"]
JUNIOR_WORDS_LEGACY = ["junior", "intern", "staż", "trainee", "młodszy", "assistant", "praktyka"]

# Words of the text form dropped when a search has no parentheses.
_CONNECTIVES = ["AND", "OR", "(", ")", ""]


def _arr(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>"))


# ---------------------------------------------------------------------------
# text form
# ---------------------------------------------------------------------------

def build_search_col(titles="job_titles", levels="experience_levels", excludes="exclude_keywords") -> Column:
    """("a" OR "b") AND ("x" OR "y") -ex1 -ex2; level group omitted when empty."""
    t, lv, ex = _arr(titles), _arr(levels), _arr(excludes)

    def quoted_or(a):
        return F.array_join(F.transform(a, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ")

    q = F.concat(
        F.lit("("), quoted_or(t), F.lit(")"),
        F.when(F.size(lv) > 0, F.concat(F.lit(" AND ("), quoted_or(lv), F.lit(")"))).otherwise(F.lit("")),
        F.when(F.size(ex) > 0,
               F.concat(F.lit(" "), F.array_join(F.transform(ex, lambda x: F.concat(F.lit("-"), x)), " ")))
        .otherwise(F.lit("")),
    )
    return py_strip(q)


def build_search(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("search_text", build_search_col())


def compile_search_col(text) -> Column:
    """Text form to struct<groups, excludes>, with the reference's rules:

    * excludes: every ``-(\\w+)`` anywhere (also inside quotes), lowercased;
    * groups: each non-greedy ``(...)``, split on literal " OR ", stripped,
      both quote kinds removed, lowercased;
    * without parentheses: drop the excludes, split on whitespace, drop
      AND/OR/(/), lowercase, one OR group (quotes kept).
    """
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    excludes = F.transform(F.regexp_extract_all(t, F.lit(r"-([\p{L}\p{N}_]+)"), 1), lambda x: F.lower(x))
    raw_groups = F.regexp_extract_all(t, F.lit(r"\((.*?)\)"), 1)
    paren_groups = F.transform(
        raw_groups,
        lambda g: F.transform(F.split(g, " OR "), lambda k: F.lower(F.translate(py_strip(k), "\"'", ""))),
    )
    bare = py_strip(F.regexp_replace(t, r"-([\p{L}\p{N}_]+)", ""))
    words = F.filter(F.split(bare, f"{PY_SPACE}+"), lambda w: ~w.isin(*_CONNECTIVES))
    bare_kw = F.transform(words, lambda w: F.lower(w))
    bare_groups = F.when(F.size(bare_kw) > 0, F.array(bare_kw)).otherwise(F.array().cast("array<array<string>>"))
    groups = F.when(F.size(raw_groups) > 0, paren_groups).otherwise(bare_groups)
    return F.struct(groups.alias("groups"), excludes.alias("excludes"))


def compile_search(df: DataFrame, text: str = "search_text") -> DataFrame:
    c = compile_search_col(text)
    return df.withColumn("_c", c).select("*", "_c.groups", "_c.excludes").drop("_c")


def compiled_profiles(profiles: DataFrame) -> DataFrame:
    """Compiled form straight from the profile arrays (no text round trip):
    groups = [titles] + [levels if any], lowercased; excludes lowercased.
    An empty title list gives no group at all (matches everything)."""
    lower_all = lambda a: F.transform(_arr(a), lambda x: F.lower(x))
    groups = F.filter(F.array(lower_all("job_titles"), lower_all("experience_levels")), lambda g: F.size(g) > 0)
    return profiles.select("*", groups.alias("groups"), lower_all("exclude_keywords").alias("excludes"))


# ---------------------------------------------------------------------------
# one literal search as a predicate
# ---------------------------------------------------------------------------

#: Word characters, spelled out: Java's Unicode \\w also takes combining marks and leaves out superscripts.
_W = r"[\p{L}\p{N}_]"


def _word_pattern(keywords: Sequence[str]) -> str:
    """Whole-word alternation: both ends of a keyword lie between a word
    character and something else."""

    def whole(k: str) -> str:
        if not k:
            return _W  # an edge exists where there is a word character
        first, last = (c == "_" or c.isalnum() for c in (k[0], k[-1]))
        return f"(?<{'!' if first else '='}{_W}){py_regex_escape(k)}(?{'!' if last else '='}{_W})"

    return "|".join(map(whole, keywords))


def match_predicate(title, groups: Sequence[Sequence[str]], excludes: Sequence[str], mode: str = "word") -> Column:
    """Boolean column: title satisfies the compiled search.

    mode="word" (current): keywords of length <= 3 must be whole words
    (Unicode ``\\b``), longer ones are substrings. mode="substring" (legacy):
    every keyword is a substring. Excludes are substrings in both modes.
    """
    t = F.lower(F.col(title) if isinstance(title, str) else title)
    cond = F.lit(True)
    for e in excludes:
        cond = cond & ~t.contains(e)
    for g in groups:
        if mode == "word":
            short = [k for k in g if len(k) <= 3]
            long_ = [k for k in g if len(k) > 3]
        else:
            short, long_ = [], list(g)
        hit = F.lit(False)
        if short:
            hit = hit | t.rlike(_word_pattern(short))
        for k in long_:
            hit = hit | t.contains(k)
        cond = cond & hit
    # A null title matches nothing (the reference cannot hold one).
    return F.coalesce(cond, F.lit(False)) & t.isNotNull()


def match_words(offers: DataFrame, groups, excludes, title: str = "title") -> DataFrame:
    return offers.where(match_predicate(title, groups, excludes, "word"))


def match_substring(offers: DataFrame, groups, excludes, title: str = "title") -> DataFrame:
    return offers.where(match_predicate(title, groups, excludes, "substring"))


def seniority_flag(compiled: DataFrame, legacy: bool = False) -> DataFrame:
    words = JUNIOR_WORDS_LEGACY if legacy else JUNIOR_WORDS_CURRENT
    flat = F.flatten(F.coalesce(F.col("groups"), F.array().cast("array<array<string>>")))
    junior = F.coalesce(F.arrays_overlap(flat, F.array(*[F.lit(w) for w in words])), F.lit(False))
    return compiled.withColumn("is_junior", junior)


# ---------------------------------------------------------------------------
# many searches as a table
# ---------------------------------------------------------------------------

_WORD_ONLY = r"^[\p{L}\p{N}_]+$"
_GRAM_MAX = 3
_TERM = "struct<kw:string,check:string,pat:string>"


def _term(kw: Column, mode: str) -> Column:
    """A keyword with its check: ``word`` (a short whole word), ``pattern`` (a short one
    with symbols, whole by its edges) or ``contains``; ``pat`` states the first two as
    a pattern."""
    short, word = F.length(kw) <= 3, kw.rlike(_WORD_ONLY)
    whole = F.lit(mode == "word")
    check = (F.when(whole & short & word, F.lit("word")).when(whole & short, F.lit("pattern")).otherwise(F.lit("contains")))
    edge = lambda ahead, inner: F.when(kw.rlike(inner), F.lit(f"(?{ahead}!{_W})")).otherwise(F.lit(f"(?{ahead}={_W})"))
    pat = F.when(kw == "", F.lit(_W)).otherwise(F.concat(
        edge("<", f"^{_W}"), F.regexp_replace(kw, r"([^\p{L}\p{N}_])", r"\\$1"), edge("", f"{_W}$")))
    return F.struct(kw.alias("kw"), check.alias("check"), F.when(whole & short, pat).alias("pat"))


def _searches(compiled: DataFrame, mode: str) -> DataFrame:
    """(profile_id, groups of terms, excludes), nulls left out."""
    groups = F.coalesce("groups", F.array().cast("array<array<string>>"))
    terms = F.transform(groups, lambda g: F.transform(F.filter(g, lambda k: k.isNotNull()), lambda k: _term(k, mode)))
    return compiled.select("profile_id", terms.cast(f"array<array<{_TERM}>>").alias("groups"),
                           F.filter(_arr("excludes"), lambda e: e.isNotNull()).alias("excludes"))


def _hit(lt: Column, t: Column) -> Column:
    return F.when(t["check"] == "contains", lt.contains(t["kw"])).otherwise(F.rlike(lt, t["pat"]))


def _holds(lt: Column, groups: Column, excludes: Column) -> Column:
    """Every group has a term in the title, and no exclude is in it."""
    return (F.forall(groups, lambda g: F.exists(g, lambda t: _hit(lt, t))) & ~F.exists(excludes, lambda e: lt.contains(e)))


_RUNS = rf"{_W}+|[^\p{{L}}\p{{N}}_]+"


def _piece(kw: Column) -> Column:
    """The part of a keyword that one run of a title must hold: its longest run of word
    characters, else its longest run of others, else "" (the empty keyword)."""
    longest = lambda pattern: F.array_max(F.transform(
        F.regexp_extract_all(kw, F.lit(pattern), 0), lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]
    return F.coalesce(longest(f"{_W}+"), longest(r"[^\p{L}\p{N}_]+"), F.lit(""))


def _grams(text: Column, lengths: Sequence[int]) -> Column:
    """The substrings of the given lengths; the look-ahead finds overlapping ones in one pass."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in lengths]))


def _title_runs(titles: DataFrame, key: str, others: bool) -> DataFrame:
    """(key, run): the distinct runs of word characters of each title (with ``others`` also
    the runs between them), and "" of every title."""
    lt = F.lower(F.col("title"))
    runs = F.regexp_extract_all(lt, F.lit(_RUNS if others else f"{_W}+"), 0)
    return titles.select(F.col(key), F.explode(F.array_distinct(F.concat(F.array(F.lit("")), runs))).alias("run"))


def _vocabulary(runs: DataFrame, keywords: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """(run, kw, check, pat, titles): the distinct runs that hold a keyword's piece, and
    the number of titles with the run. Keywords meet the vocabulary, which grows
    slower than the titles, by equality on the run or on the piece's first gram."""
    words = runs.groupBy("run").agg(F.count("*").alias("titles"))
    run, piece = F.col("run"), F.col("piece")
    keyed = keywords.withColumn("k", F.when(F.col("whole"), F.concat(F.lit("="), piece)).otherwise(F.substring(piece, 1, _GRAM_MAX)))
    keys = F.concat(F.array(F.concat(F.lit("="), run)), _grams(run, lengths)) if lengths else F.array(F.concat(F.lit("="), run))
    return (words.select("run", "titles", F.explode(keys).alias("k")).join(keyed, "k")
            .where(F.when(F.col("whole"), run == piece).otherwise(F.contains(run, piece)))
            .select("run", "kw", "check", "pat", "titles"))


def _candidates(titles: DataFrame, searches: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """((key, lt, kw, check) of titles that hold a keyword of an anchor group,
    (profile_id, kw, check) of the anchors)."""
    terms = (searches.select("profile_id", F.posexplode("groups").alias("group_no", "g"))
             .select("profile_id", "group_no", F.inline("g")))
    piece = F.col("piece")
    keywords = terms.select("kw", "check", "pat").distinct().withColumn("piece", _piece(F.col("kw"))).withColumn(
        "whole", (F.col("check") == "word") | (piece == ""))
    # One small job over the searches: is a piece without word characters, and how long are the first grams?
    kinds = keywords.agg(F.max((piece != "") & ~piece.rlike(_W)).alias("others"), F.collect_set(
        F.when(~F.col("whole"), F.least(F.length("piece"), F.lit(_GRAM_MAX)))).alias("lengths")).first()
    runs = _title_runs(titles, key, bool(kinds["others"]))
    # Small beside the titles, and read by the choice of anchors and by the candidates.
    held = _vocabulary(runs, keywords, sorted(kinds["lengths"])).checkpoint(eager=True)
    most = held.groupBy("kw", "check").agg(F.sum("titles").alias("n"))
    # a search's terms are one row, from which the cheapest group is picked
    weighed = (terms.join(most, ["kw", "check"], "left").groupBy("profile_id").agg(F.collect_list(
        F.struct("group_no", F.coalesce("n", F.lit(0)).alias("n"), "kw", "check")).alias("t")))
    cost = lambda g: F.aggregate(F.filter("t", lambda x: x["group_no"] == g), F.lit(0).cast("long"), lambda n, x: n + x["n"])
    cheapest = F.array_min(F.transform(F.array_distinct(F.transform("t", lambda x: x["group_no"])),
                                       lambda g: F.struct(cost(g).alias("cost"), g.alias("g"))))["g"]
    anchors = (weighed.withColumn("g", cheapest).select("profile_id", F.inline(F.filter("t", lambda x: x["group_no"] == F.col("g"))))
               .select("profile_id", "kw", "check").distinct())
    wanted = held.drop("titles").join(anchors, ["kw", "check"], "left_semi")
    near = runs.join(wanted, "run").select(key, "kw", "check", "pat").distinct()
    sure = (F.col("check") == "word") | _hit(F.col("lt"), F.struct("kw", "check", "pat"))
    return near.join(titles.select(F.col(key), F.lower("title").alias("lt")), key).where(sure).select(key, "lt", "kw", "check"), anchors


def match_profiles(offers: DataFrame, compiled: DataFrame, key: str = "seq", mode: str = "word") -> DataFrame:
    """All (profile_id, key) pairs where the offer title satisfies the search.

    ``compiled`` holds profile_id, groups, excludes. A keyword inside a title lies,
    run by run (word characters or others), inside the title's runs, so keywords meet
    the distinct runs of all titles, by equality on a run or a short gram, and never
    the titles' own grams. A conjunction fails with its first failing group, so each
    search has an anchor: the group whose keywords the fewest titles can hold. Titles
    meet the runs of anchor keywords, a candidate (offer, keyword) is confirmed once
    on the title, however many searches share the keyword, and only confirmed
    candidates are tested on their search's other groups and excludes.
    The plan is the same at any number of terms and groups; adaptive execution
    picks join strategies by size and splits hot keys. Searches without groups
    match every offer by their meaning; they join apart, on a salt of the
    offer's key.
    """
    from ..plans.partitioning import shuffle_partitions, spread

    searches = _searches(compiled, mode)
    # Titles are spread by key before the explode: that is the CPU work.
    titles = spread(offers.where(F.col("title").isNotNull()).select(key, "title"), key)
    found, anchors = _candidates(titles, searches, key)
    lt = F.col("lt")
    pairs = (found.join(anchors.join(searches, "profile_id"), ["kw", "check"])
             .where(_holds(lt, F.col("groups"), F.col("excludes"))).select("profile_id", key).distinct())
    n = shuffle_partitions(offers)
    every = (searches.where(F.size("groups") == 0).select("profile_id", "excludes")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))))
    whole = (titles.select(key, F.lower("title").alias("lt"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("salt"))
             .join(every, "salt").where(~F.exists("excludes", lambda e: lt.contains(e))).select("profile_id", key))
    return pairs.unionByName(whole)


def anchor_candidates(offers: DataFrame, compiled: DataFrame, key: str = "seq", mode: str = "word") -> DataFrame:
    """(key, lt, kw, check): the titles (lower-cased) that ``match_profiles`` tests further."""
    return _candidates(offers.where(F.col("title").isNotNull()).select(key, "title"), _searches(compiled, mode), key)[0]


# ---------------------------------------------------------------------------
# topics and slugs (which listing pages a search asks for)
# ---------------------------------------------------------------------------

# Keyword-substring to topic rules per rule set, with the
# default topics used when no rule hits and whether the first hit wins.
TOPIC_RULES = {
    "current": {
        "rules": [("python", "python"), ("data", "data"), ("sql", "data"), ("anal", "data"),
                  ("ai", "ai"), ("learning", "ai"), ("ml", "ai"), ("java", "java"), ("devops", "devops")],
        "default": ["data", "python", "ai"],
        "first_hit": False,
    },
    "legacy_justjoinit": {
        "rules": [("python", "python"), ("data", "data"), ("sql", "data"), ("analytics", "data"),
                  ("java", "java"), ("net", "net"), ("ai", "ai"), ("learning", "ai"), ("ml", "ai"),
                  ("nlp", "ai"), ("llm", "ai")],
        "default": ["data", "python", "ai"],
        "first_hit": False,
    },
    "legacy_nofluffjobs": {
        "rules": [("python", "python"), ("data", "data"), ("ai", "artificial-intelligence"),
                  ("learning", "artificial-intelligence"), ("ml", "artificial-intelligence"), ("back", "backend")],
        "default": ["data", "artificial-intelligence"],
        "first_hit": False,
    },
    "legacy_bulldogjob": {
        "rules": [("data", "data"), ("sql", "data"), ("ai", "ai"), ("learning", "ai"),
                  ("python", "backend"), ("java", "backend")],
        "default": ["data", "backend", "ai"],
        "first_hit": True,
    },
    "legacy_theprotocol": {
        "rules": [("python", "python"), ("data", "big-data"), ("ai", "ai-ml"), ("learning", "ai-ml"),
                  ("java", "java"), ("backend", "backend")],
        "default": ["python", "ai-ml"],
        "first_hit": True,
    },
    "legacy_pracujpl": {
        "rules": [("ai", "ai-ml"), ("learning", "ai-ml"), ("python", "backend"), ("java", "backend"),
                  ("data", "data-analytics-and-bi"), ("data", "big-data-science"),
                  ("anal", "data-analytics-and-bi"), ("anal", "big-data-science")],
        "default": ["ai-ml", "backend", "data-analytics-and-bi", "big-data-science"],
        "first_hit": False,
    },
}

# Topic to site slug, with the default slug.
SLUG_MAPS = {
    "NoFluffJobs": ({"python": "python", "data": "data", "ai": "artificial-intelligence",
                     "java": "java", "devops": "devops"}, "data"),
    "TheProtocol": ({"python": "python", "data": "big-data", "ai": "ai-ml",
                     "java": "java", "devops": "devops"}, "big-data"),
}


def _topic_rule_case(kw: Column, rules) -> Column:
    """Rank of the first rule hitting kw (rule order), for first-hit sets."""
    expr = None
    for rank, (token, _topic) in enumerate(rules):
        cond = kw.contains(token)
        expr = F.when(cond, F.lit(rank)) if expr is None else expr.when(cond, F.lit(rank))
    return expr


# Keywords two legacy rule sets use when a search has no group.
NO_GROUP_KEYWORDS = {"legacy_justjoinit": ["python", "data"], "legacy_theprotocol": ["python"]}


def topics_col(groups="groups", rule_set: str = "current") -> Column:
    """Topics of the first keyword group as an array column, default set when
    nothing hits. The rule table is fixed and tiny, so it is applied as column
    expressions per search row: no join, no shuffle."""
    spec = TOPIC_RULES[rule_set]
    rules = spec["rules"]
    first = F.coalesce(F.get(F.col(groups), 0), F.array().cast("array<string>"))
    if rule_set in NO_GROUP_KEYWORDS:
        fallback = F.array(*[F.lit(k) for k in NO_GROUP_KEYWORDS[rule_set]])
        first = F.when(F.size(F.coalesce(F.col(groups), F.array().cast("array<array<string>>"))) > 0, first
                       ).otherwise(fallback)
    topics_arr = F.array(*[F.lit(t) for _, t in rules])

    def hit(kw):
        kw = F.lower(kw)
        if spec["first_hit"]:
            rank = _topic_rule_case(kw, rules)
            return F.when(rank.isNotNull(), F.array(F.get(topics_arr, rank))).otherwise(
                F.array().cast("array<string>"))
        return F.array_compact(F.array(*[F.when(kw.contains(tok), F.lit(topic)) for tok, topic in rules]))

    found = F.array_distinct(F.flatten(F.transform(first, hit)))
    default = F.array(*[F.lit(t) for t in spec["default"]])
    return F.when(F.size(found) > 0, found).otherwise(default)


def keyword_topics(compiled: DataFrame, rule_set: str = "current") -> DataFrame:
    """(profile_id, topic) rows."""
    return compiled.select("profile_id", F.explode(topics_col("groups", rule_set)).alias("topic"))


def topic_slug_col(site: str, topic="topic") -> Column:
    mapping, default = SLUG_MAPS[site]
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    t = F.col(topic) if isinstance(topic, str) else topic
    return F.coalesce(F.element_at(m, t), F.lit(default))


def topic_slugs(topics: DataFrame) -> DataFrame:
    """(profile_id, topic, site, slug) for the sites that use slugs."""
    parts = [topics.select("profile_id", "topic", F.lit(site).alias("site"), topic_slug_col(site).alias("slug"))
             for site in SLUG_MAPS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# What the listing addresses of the sites are made of, both generations.
LISTING = {
    "LinkedIn": "https://www.linkedin.com/jobs/search/?keywords=",
    "JustJoinIT": "https://justjoin.it/job-offers/",
    "NoFluffJobs": "https://nofluffjobs.com/pl/",
    "TheProtocol": "https://theprotocol.it/filtry/",
    "BulldogJob": "https://bulldogjob.pl/companies/jobs/s/",
    "Pracuj.pl": "https://it.pracuj.pl/praca/",
}
GEO_CITY, GEO_CODES, GEO_OTHER = "Katowice", {"Katowice": "90009829"}, "105072130"
LINKEDIN_TAIL = "&f_TPR=r2592000&f_E=1%2C2&f_F=it&refresh=true"
LINKEDIN_TAIL_LEGACY = "&f_TPR=r2592000&f_E=1%2C2&f_F=it&origin=JOB_SEARCH_PAGE_JOB_FILTER&refresh=true"
LINKEDIN_PLACE_LEGACY = "&f_PP=103855053"
NO_KEYWORD = "Data"
EVERYWHERE = "all-locations"
REMOTE = {"LinkedIn": "&f_WT=2", "JustJoinIT": "workplaceType=remote", "NoFluffJobs": "remote", "TheProtocol": "remote;wm",
          "BulldogJob": "remote,true", "Pracuj.pl": "praca%20zdalna;wm,home-office"}
JUNIOR = {"JustJoinIT": "experience-level=junior", "NoFluffJobs": "?criteria=seniority%3Dtrainee,junior",
          "TheProtocol": "trainee,assistant,junior;p", "BulldogJob": "experienceLevel,intern,junior", "Pracuj.pl": "et=1%2C3%2C17"}
PARAMS = {"JustJoinIT": ["radius=0", "orderBy=DESC", "sortBy=published"], "Pracuj.pl": ["rd=0", "its=", "wm=full-office%2Chybrid"]}


# ---------------------------------------------------------------------------
# crawl plan: listing URLs per search (a frontier table; nothing is fetched)
# ---------------------------------------------------------------------------

def search_plan(compiled: DataFrame, legacy: bool = False) -> DataFrame:
    """(profile_id, site, url) listing URLs of every search, built as columns
    of the search row (templates are fixed values), exploded, distinct.
    ``legacy=True`` gives the older generation's URLs (per-site rule sets,
    one LinkedIn URL per search, extra parameters)."""
    from ..functions.text import quote_plus

    if legacy:
        return _search_plan_legacy(compiled)

    loc = F.coalesce(F.col("location"), F.lit(""))
    lloc = F.lower(loc)
    remote = F.coalesce(F.col("remote_only"), F.lit(False))
    groups = F.coalesce(F.col("groups"), F.array().cast("array<array<string>>"))
    flat = F.flatten(groups)
    junior = F.coalesce(F.arrays_overlap(flat, F.array(*[F.lit(w) for w in JUNIOR_WORDS_CURRENT])), F.lit(False))
    first = F.coalesce(F.get(groups, 0), F.array().cast("array<string>"))
    kws = F.when(F.size(first) > 0, first).otherwise(F.array(F.lit(NO_KEYWORD)))
    geo = F.when(loc.contains(GEO_CITY), F.lit(GEO_CODES[GEO_CITY])).otherwise(F.lit(GEO_OTHER))

    def su(site, url):
        return F.struct(F.lit(site).alias("site"), url.alias("url"))

    linkedin = F.transform(kws, lambda kw: su("LinkedIn", F.concat(
        F.lit(LISTING["LinkedIn"]), quote_plus(kw), F.lit("&geoId="), geo,
        F.lit(LINKEDIN_TAIL),
        F.when(remote, F.lit(REMOTE["LinkedIn"])).otherwise(F.lit("")))))
    topics = topics_col("groups")
    jj_loc = F.when((loc == "") | remote, F.lit(EVERYWHERE)).otherwise(lloc)
    jj = F.transform(topics, lambda t: su("JustJoinIT", F.concat(
        F.lit(LISTING["JustJoinIT"]), jj_loc, F.lit("/"), t,
        F.when(junior, F.lit("?" + JUNIOR["JustJoinIT"])).otherwise(F.lit("")))))
    nfj_mid = F.when(remote, F.lit(REMOTE["NoFluffJobs"])).otherwise(lloc)
    nfj = F.transform(topics, lambda t: su("NoFluffJobs", F.concat(
        F.lit(LISTING["NoFluffJobs"]),
        F.when(nfj_mid != "", F.concat(nfj_mid, F.lit("/"))).otherwise(F.lit("")),
        topic_slug_col("NoFluffJobs", t),
        F.when(junior, F.lit(JUNIOR["NoFluffJobs"])).otherwise(F.lit("")))))
    tp = F.transform(topics, lambda t: su("TheProtocol", F.concat(
        F.lit(LISTING["TheProtocol"]),
        F.array_join(F.array(F.concat(topic_slug_col("TheProtocol", t), F.lit(";sp")),
                             F.when(junior, F.lit(JUNIOR["TheProtocol"])),
                             F.when(remote, F.lit(REMOTE["TheProtocol"])).when(loc != "", F.concat(lloc, F.lit(";wp")))),
                     "/"))))
    bulldog = F.array(su("BulldogJob", F.concat(
        F.lit(LISTING["BulldogJob"]),
        F.array_join(F.array(F.when(remote, F.lit(REMOTE["BulldogJob"])).when(loc != "", F.concat(F.lit("city,"), loc)),
                             F.when(junior, F.lit(JUNIOR["BulldogJob"]))), "/"))))
    pracuj_loc = (F.when(remote, F.lit(REMOTE["Pracuj.pl"]))
                  .when(loc != "", F.concat(lloc, F.lit(";wp"))).otherwise(F.lit("")))
    pracuj = F.array(su("Pracuj.pl", F.concat(
        F.lit(LISTING["Pracuj.pl"]), pracuj_loc, F.lit("?" + PARAMS["Pracuj.pl"][0]),
        F.when(junior, F.lit("&" + JUNIOR["Pracuj.pl"])).otherwise(F.lit("")))))
    allu = F.concat(linkedin, jj, nfj, tp, bulldog, pracuj)
    return (compiled.select("profile_id", F.explode(allu).alias("u"))
            .select("profile_id", "u.site", "u.url").distinct())


def _search_plan_legacy(compiled: DataFrame) -> DataFrame:
    from ..functions.text import quote_plus

    loc = F.coalesce(F.col("location"), F.lit(""))
    lloc = F.lower(loc)
    remote = F.coalesce(F.col("remote_only"), F.lit(False))
    groups = F.coalesce(F.col("groups"), F.array().cast("array<array<string>>"))
    junior = F.coalesce(F.arrays_overlap(F.flatten(groups), F.array(*[F.lit(w) for w in JUNIOR_WORDS_LEGACY])),
                        F.lit(False))
    first = F.coalesce(F.get(groups, 0), F.array().cast("array<string>"))
    joined = F.array_join(first, " ")
    kw = (F.when(F.size(groups) == 0, F.lit(NO_KEYWORD))
          .when(F.length(joined) > 50, F.get(first, 0)).otherwise(joined))
    kato = loc.contains(GEO_CITY)

    def su(site, url):
        return F.struct(F.lit(site).alias("site"), url.alias("url"))

    def opt(cond, text):
        return F.when(cond, F.lit(text))

    linkedin = F.when(kato | (loc == "") | remote, F.array(su("LinkedIn", F.concat(
        F.lit(LISTING["LinkedIn"]), quote_plus(kw),
        F.lit("&geoId="), F.when(kato, F.lit(GEO_CODES[GEO_CITY])).otherwise(F.lit(GEO_OTHER)),
        F.lit(LINKEDIN_TAIL_LEGACY),
        F.coalesce(opt(kato, LINKEDIN_PLACE_LEGACY), F.lit("")), F.coalesce(opt(remote, REMOTE["LinkedIn"]), F.lit("")))))
                        ).otherwise(F.array().cast("array<struct<site:string,url:string>>"))
    jj_loc = F.when((loc == "") | remote, F.lit(EVERYWHERE)).otherwise(lloc)
    jj_params = F.array_join(F.array(opt(remote, REMOTE["JustJoinIT"]), opt(junior, JUNIOR["JustJoinIT"]),
                                     opt(~remote & (loc != ""), PARAMS["JustJoinIT"][0]),
                                     *map(F.lit, PARAMS["JustJoinIT"][1:])), "&")
    jj = F.transform(topics_col("groups", "legacy_justjoinit"), lambda t: su("JustJoinIT", F.concat(
        F.lit(LISTING["JustJoinIT"]), jj_loc, F.lit("/"), t, F.lit("?"), jj_params)))
    nfj_mid = F.when(remote, F.lit(REMOTE["NoFluffJobs"])).otherwise(lloc)
    nfj = F.transform(topics_col("groups", "legacy_nofluffjobs"), lambda t: su("NoFluffJobs", F.concat(
        F.lit(LISTING["NoFluffJobs"]), F.when(nfj_mid != "", F.concat(nfj_mid, F.lit("/"))).otherwise(F.lit("")),
        t, F.coalesce(opt(junior, JUNIOR["NoFluffJobs"]), F.lit("")))))
    roles = F.array_join(F.array_sort(topics_col("groups", "legacy_bulldogjob")), ",")
    bulldog = F.array(su("BulldogJob", F.concat(
        F.lit(LISTING["BulldogJob"]),
        F.array_join(F.array(F.when(remote, F.lit(REMOTE["BulldogJob"])).when(loc != "", F.concat(F.lit("city,"), loc)),
                             F.concat(F.lit("role,"), roles), opt(junior, JUNIOR["BulldogJob"])), "/"))))
    tp = F.transform(topics_col("groups", "legacy_theprotocol"), lambda t: su("TheProtocol", F.concat(
        F.lit(LISTING["TheProtocol"]),
        F.array_join(F.array(F.concat(t, F.lit(";sp")), opt(junior, JUNIOR["TheProtocol"]),
                             F.when(remote, F.lit(REMOTE["TheProtocol"])).when(loc != "", F.concat(lloc, F.lit(";wp")))),
                     "/"))))
    its = F.array_join(F.array_sort(topics_col("groups", "legacy_pracujpl")), "%2C")
    pr_loc = (F.when(remote, F.lit(REMOTE["Pracuj.pl"]))
              .when(loc != "", F.concat(lloc, F.lit(";wp"))).otherwise(F.lit("")))
    pracuj = F.array(su("Pracuj.pl", F.concat(
        F.lit(LISTING["Pracuj.pl"]), pr_loc, F.lit("?"),
        F.array_join(F.array(F.lit(PARAMS["Pracuj.pl"][0]), opt(junior, JUNIOR["Pracuj.pl"]), F.concat(F.lit(PARAMS["Pracuj.pl"][1]), its),
                             opt(~remote, PARAMS["Pracuj.pl"][2])), "&"))))
    allu = F.concat(linkedin, jj, nfj, tp, bulldog, pracuj)
    return (compiled.select("profile_id", F.explode(allu).alias("u"))
            .select("profile_id", "u.site", "u.url").distinct())
