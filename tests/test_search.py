import random

import pytest
from pyspark.sql import functions as F

from offerflow.operators import search as se
from spec import matches

TEXTS = [
    '("Entry-Level" OR "ML") AND (C++) -Senior -Mid Level',
    "()",
    "(a (b) c)",
    "python developer -java",
    "",
    '("Data Scientist" OR "ML") AND ("Junior" OR "Staż") -Senior -staż',
    "AND OR ( ) data",
]


# Worked out by hand.
EXPECTED = dict(zip(TEXTS, [
    ([["entry-level", "ml"], ["c++"]], ["level", "senior", "mid"]),
    ([[""]], []),
    ([["a (b"]], []),
    ([["python", "developer"]], ["java"]),
    ([], []),
    ([["data scientist", "ml"], ["junior", "staż"]], ["senior", "staż"]),
    ([[""]], []),
], strict=True))


@pytest.mark.parametrize("text", TEXTS)
def test_compile_search_matches_hand_worked(spark, text):
    df = spark.createDataFrame([(text,)], "search_text string")
    row = se.compile_search(df).first()
    assert ([list(g) for g in row["groups"]], list(row["excludes"])) == EXPECTED[text]


def test_compile_trap_values(spark):
    df = spark.createDataFrame([(TEXTS[0],)], "search_text string")
    row = se.compile_search(df).first()
    assert [list(g) for g in row["groups"]] == [["entry-level", "ml"], ["c++"]]
    assert list(row["excludes"]) == ["level", "senior", "mid"]


def test_build_then_compile_round_trip(spark):
    df = spark.createDataFrame([(1, ["Data Scientist", "ML"], ["Junior"], ["Senior"])],
                               "profile_id long, job_titles array<string>, experience_levels array<string>, "
                               "exclude_keywords array<string>")
    b = se.build_search(df).first()["search_text"]
    assert b == '("Data Scientist" OR "ML") AND ("Junior") -Senior'
    c = se.compile_search(se.build_search(df)).first()
    assert [list(g) for g in c["groups"]] == [["data scientist", "ml"], ["junior"]]


TITLE_CASES = [
    ("AI trainee", [["ai"]], [], True),
    ("trainee", [["ai"]], [], False),
    ("C++ Developer", [["c++"]], [], False),
    ("Stażysta Python", [["staż"]], [], True),
    ("trainee", [["trainee"]], ["ai"], False),
    ("Senior Data Engineer", [["data"]], ["senior"], False),
    ("Any title at all", [], [], True),
    ("x", [[""]], [], True),
    ("---", [[""]], [], False),
    ("La vie en rose", [["la"]], [], True),
    ("Lavie", [["la"]], [], False),
    ("x\u00b2 la\u0301 a", [["x"]], [], False),
    ("x\u00b2 la\u0301 a", [["la"]], [], True),
    ("c++x", [["c++"]], [], True),
]


@pytest.mark.parametrize("title,groups,excludes,expected", TITLE_CASES)
def test_match_words_traps(spark, title, groups, excludes, expected):
    assert matches(title, groups, excludes) is expected
    df = spark.createDataFrame([(1, title)], "seq long, title string")
    assert (se.match_words(df, groups, excludes).count() == 1) is expected


def _random_titles(n, seed):
    rnd = random.Random(seed)
    vocab = ["the", "la", "de", "ai", "ml", "data", "engineer", "trainee", "c++", "information", "tion",
             "staż", "la-la", "l'a", "éla", "de_x", "heed", "python", "Senior", "ING", "er", "ouer"]
    seps = [" ", "-", ", ", "/", "  ", " "]
    return [rnd.choice(seps).join(rnd.choice(vocab) for _ in range(rnd.randint(1, 6))) for _ in range(n)]


PROFILES = [
    (1, [["the", "la", "de"], ["tion", "ing", "er"]], ["heed"]),
    (2, [["ment", "tion"]], []),
    (3, [["la"]], ["er"]),
    (4, [], []),
    (5, [["c++", "ai"]], ["senior"]),
    (6, [[""]], []),
    (7, [["data", "ml"], ["engineer", "trainee"]], ["ai"]),
]


@pytest.mark.parametrize("mode", ["word", "substring"])
def test_match_profiles_equals_python(spark, mode):
    titles = _random_titles(400, seed=7)
    offers = spark.createDataFrame(list(enumerate(titles)), "seq long, title string")
    prof = spark.createDataFrame(PROFILES, "profile_id long, groups array<array<string>>, excludes array<string>")
    got = {(r["profile_id"], r["seq"]) for r in se.match_profiles(offers, prof, mode=mode).collect()}
    want = {(pid, i) for pid, g, ex in PROFILES for i, t in enumerate(titles) if matches(t, g, ex, mode)}
    assert got == want


def test_match_profiles_shuffle_path(spark):
    """Same answer when term tables are above the broadcast bound."""
    titles = _random_titles(200, seed=11)
    offers = spark.createDataFrame(list(enumerate(titles)), "seq long, title string")
    prof = spark.createDataFrame(PROFILES, "profile_id long, groups array<array<string>>, excludes array<string>")
    spark.conf.set("offerflow.broadcast.maxRows", "1")
    try:
        got = {(r["profile_id"], r["seq"]) for r in se.match_profiles(offers, prof).collect()}
    finally:
        spark.conf.unset("offerflow.broadcast.maxRows")
    want = {(pid, i) for pid, g, ex in PROFILES for i, t in enumerate(titles) if matches(t, g, ex)}
    assert got == want


def test_match_profiles_wide_searches(spark):
    """Searches of very many groups; same answer as the brute force."""
    titles = _random_titles(300, seed=13) + ["the la de data ml engineer er " * 3]
    offers = spark.createDataFrame(list(enumerate(titles)), "seq long, title string")
    many = [["the", "la"], ["de", "data"], ["er"], ["ml", "c++"], ["engineer"]] * 13  # 65 groups
    wide = [(10, many, []), (11, many, ["heed"]), (12, [["la"]] * 70, ["python"]), (4, [], ["ai"])]
    prof = spark.createDataFrame(wide, "profile_id long, groups array<array<string>>, excludes array<string>")
    got = {(r["profile_id"], r["seq"]) for r in se.match_profiles(offers, prof).collect()}
    want = {(pid, i) for pid, g, ex in wide for i, t in enumerate(titles) if matches(t, g, ex)}
    assert got == want and any(pid == 10 for pid, _ in want)


ODD = ["machine learning", "c++ dev", "++", "la-la", ", ", " ", "", "a", "é", "l'a", "x_1", "st-ża", "data engineer", "#", "-la", "la-", "12"]


@pytest.mark.parametrize("mode", ["word", "substring"])
def test_match_profiles_of_keywords_across_words_and_symbols(spark, mode):
    """Keywords of several runs, of symbols only, empty ones, nulls, and groups without keywords."""
    rnd = random.Random(17)
    vocab = [*ODD, "learning", "machine", "dev", "Data", "lala", "ÉA", "ab12", "c++ ", "#1"]
    titles = ["".join(rnd.choice([rnd.choice(vocab), rnd.choice(vocab).upper(), " ", "-"]) for _ in range(rnd.randint(0, 7))) for _ in range(400)]
    titles += ["", " ", "---", "\u00b2", "é#x", "la\u0301"]
    prof = [(i, [[k]], []) for i, k in enumerate(ODD)]
    prof += [(100 + i, [rnd.sample(ODD, rnd.randint(1, 3)) for _ in range(rnd.randint(1, 3))], rnd.sample(ODD[:4], rnd.randint(0, 1))) for i in range(40)]
    prof += [(200, [["la"], []], []), (201, [], ["la"]), (202, [[]], [])]
    offers = spark.createDataFrame([*enumerate(titles), (9999, None)], "seq long, title string")
    nulls = [(300, None, None), (301, [[None, "la"], ["a", None]], [None, "#"]), (302, [[None]], [])]
    table = spark.createDataFrame(prof + nulls, "profile_id long, groups array<array<string>>, excludes array<string>")
    got = {(r["profile_id"], r["seq"]) for r in se.match_profiles(offers, table, mode=mode).collect()}
    prof += [(300, [], []), (301, [["la"], ["a"]], ["#"]), (302, [[]], [])]
    assert got == {(pid, i) for pid, g, ex in prof for i, t in enumerate(titles) if matches(t, g, ex, mode)}


def test_only_candidates_of_the_rarest_group_are_tested(spark):
    """Half of the titles hold a common keyword, a few the rare one: only these are looked at again."""
    titles = [f"common word {i}" if i % 2 else f"other word {i}" for i in range(2000)] + ["common rarely", "rarely seen"]
    offers = spark.createDataFrame(list(enumerate(titles)), "seq long, title string")
    prof = spark.createDataFrame([(k, g, []) for k, g in enumerate([[["common"], ["rare"]], [["rare"], ["word", "common"]], [["word"], ["absent"]]])],
                                 "profile_id long, groups array<array<string>>, excludes array<string>")
    looked = se.anchor_candidates(offers, prof)
    assert sorted((r["seq"], r["kw"]) for r in looked.collect()) == [(2000, "rare"), (2001, "rare")]
    assert {tuple(r) for r in se.match_profiles(offers, prof).collect()} == {(0, 2000), (1, 2000)}


def test_seniority_and_topics(spark):
    prof = spark.createDataFrame([(1, [["ml engineer", "python"], ["junior"]], []), (2, [["html"]], []),
                                  (3, [], [])], "profile_id long, groups array<array<string>>, excludes array<string>")
    flags = {r["profile_id"]: r["is_junior"] for r in se.seniority_flag(prof).collect()}
    assert flags == {1: True, 2: False, 3: False}
    topics = {}
    for r in se.keyword_topics(prof).collect():
        topics.setdefault(r["profile_id"], set()).add(r["topic"])
    assert topics[1] == {"ai", "python"}
    assert topics[2] == {"ai"}  # "ml" is a substring of "html"
    assert topics[3] == {"data", "python", "ai"}
    first_hit = {r["topic"] for r in se.keyword_topics(prof.where("profile_id = 1"), "legacy_bulldogjob").collect()}
    assert first_hit == {"backend"}  # python -> backend; "ml engineer" hits no bulldog rule


def test_search_plan_urls(spark):
    prof = spark.createDataFrame([(1, [["c++ dev"], ["junior"]], [], "Katowice", False)],
                                 "profile_id long, groups array<array<string>>, excludes array<string>, "
                                 "location string, remote_only boolean")
    urls = {(r["site"], r["url"]) for r in se.search_plan(prof).collect()}
    assert ("LinkedIn", "https://www.linkedin.com/jobs/search/?keywords=c%2B%2B+dev&geoId=90009829"
            "&f_TPR=r2592000&f_E=1%2C2&f_F=it&refresh=true") in urls
    assert ("BulldogJob", "https://bulldogjob.pl/companies/jobs/s/city,Katowice/experienceLevel,intern,junior") in urls
    assert ("Pracuj.pl", "https://it.pracuj.pl/praca/katowice;wp?rd=0&et=1%2C3%2C17") in urls
    assert ("TheProtocol", "https://theprotocol.it/filtry/big-data;sp/trainee,assistant,junior;p/katowice;wp") in urls
    assert ("NoFluffJobs", "https://nofluffjobs.com/pl/katowice/python?criteria=seniority%3Dtrainee,junior") in urls


def test_search_plan_legacy(spark):
    prof = spark.createDataFrame([(1, [["data engineer", "python"], ["junior"]], [], "Katowice", False),
                                  (2, [], [], "Gdansk", True)],
                                 "profile_id long, groups array<array<string>>, excludes array<string>, "
                                 "location string, remote_only boolean")
    urls = {(r["profile_id"], r["site"], r["url"]) for r in se.search_plan(prof, legacy=True).collect()}
    assert (1, "LinkedIn", "https://www.linkedin.com/jobs/search/?keywords=data+engineer+python&geoId=90009829"
            "&f_TPR=r2592000&f_E=1%2C2&f_F=it&origin=JOB_SEARCH_PAGE_JOB_FILTER&refresh=true&f_PP=103855053") in urls
    assert (1, "JustJoinIT", "https://justjoin.it/job-offers/katowice/data?experience-level=junior&radius=0"
            "&orderBy=DESC&sortBy=published") in urls
    assert (1, "BulldogJob", "https://bulldogjob.pl/companies/jobs/s/city,Katowice/role,backend,data/"
            "experienceLevel,intern,junior") in urls
    assert (1, "Pracuj.pl", "https://it.pracuj.pl/praca/katowice;wp?rd=0&et=1%2C3%2C17"
            "&its=backend%2Cbig-data-science%2Cdata-analytics-and-bi&wm=full-office%2Chybrid") in urls
    assert (1, "TheProtocol", "https://theprotocol.it/filtry/big-data;sp/trainee,assistant,junior;p/katowice;wp") in urls
    # no group: LinkedIn (remote) with "Data"; JJIT falls back to python+data; TheProtocol to python
    assert (2, "LinkedIn", "https://www.linkedin.com/jobs/search/?keywords=Data&geoId=105072130"
            "&f_TPR=r2592000&f_E=1%2C2&f_F=it&origin=JOB_SEARCH_PAGE_JOB_FILTER&refresh=true&f_WT=2") in urls
    jj2 = {u for p, s_, u in urls if p == 2 and s_ == "JustJoinIT"}
    assert jj2 == {"https://justjoin.it/job-offers/all-locations/python?workplaceType=remote&orderBy=DESC"
                   "&sortBy=published",
                   "https://justjoin.it/job-offers/all-locations/data?workplaceType=remote&orderBy=DESC"
                   "&sortBy=published"}
    assert {u for p, s_, u in urls if p == 2 and s_ == "TheProtocol"} == {
        "https://theprotocol.it/filtry/python;sp/remote;wm"}
