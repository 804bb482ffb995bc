"""The crawl from listing pages to offers, on literal pages."""

import pytest
from pyspark.sql import functions as F

from offerflow.operators.pages import WALL_TEXT
from offerflow.plans.crawl import crawl_funnel, crawl_offers, wanted_details
from offerflow.sources.bloom import KeyFilter
from test_searches import SEARCH

PAGE = "page_id long, url string, site string, html string"
PLAN = "profile_id long, site string, url string"
NFJ = "https://nofluffjobs.com"


def card(path, title):
    return f'<a href="{path}"><h3>{title}</h3></a>'


def listing_of(spark):
    return spark.createDataFrame([
        (1, f"{NFJ}/a", "NoFluffJobs", card("/pl/job/1", "Data one") + card("/pl/job/2", "Cook") + card("/pl/job/3", "Data three")),
        (2, f"{NFJ}/a", "NoFluffJobs", card("/pl/job/1", "Data one") + card("/pl/job/4", "Data three") + card("/pl/job/5/job-apply", "Data x")),
        (3, f"{NFJ}/b", "NoFluffJobs", card("/pl/job/6", "Data six")),
        (4, f"{NFJ}/nobody", "NoFluffJobs", card("/pl/job/7", "Data seven")),
        (5, f"{NFJ}/a", "BulldogJob", card("/companies/jobs/8", "Data of another site")),
        (6, "https://in/q", "LinkedIn", '<div class="base-card"><a class="base-card__full-link" href="https://in/v/9?x=1">x</a></div>'
            '<div class="base-card"><a class="base-card__full-link" href="https://in/v/10?x=1">x</a><h3 class="base-search-card__title">Data ten</h3></div>'),
        (7, "https://in/q", "LinkedIn", None)], PAGE)


def details_of(spark):
    text = lambda t: f'<section id="posting-description">{t}</section>'
    rows = [(100 + i, f"{NFJ}/pl/job/{i}?from=list", None, "NoFluffJobs", text(f"text {i}")) for i in (1, 2, 3, 4, 6, 7)]
    rows += [(99, f"{NFJ}/pl/job/1", None, "NoFluffJobs", text("an older snapshot")), (300, None, None, "NoFluffJobs", text("nowhere")),
             (110, "https://in/authwall?to=10", "https://in/v/10", "LinkedIn", "<p>log in</p>"), (120, "https://in/v/10", None, "BulldogJob", "<p>x</p>")]
    return spark.createDataFrame(rows, "page_id long, url string, requested_url string, site string, html string")


def searches_of(spark):
    return spark.createDataFrame([(1, ["data"], [], [], "Here", False, 14, []), (2, ["data"], [], ["six"], None, False, 14, [])], SEARCH)


def plan_of(spark):
    return spark.createDataFrame([(1, "NoFluffJobs", f"{NFJ}/a"), (1, "NoFluffJobs", f"{NFJ}/a"), (1, "LinkedIn", "https://in/q"),
                                  (2, "NoFluffJobs", f"{NFJ}/a"), (2, "NoFluffJobs", f"{NFJ}/b"), (9, "NoFluffJobs", f"{NFJ}/nothing")], PLAN)


def test_crawl(spark):
    seen = spark.createDataFrame([(1, f"{NFJ}/pl/job/3"), (1, f"{NFJ}/pl/job/3"), (2, "x"), (None, f"{NFJ}/pl/job/1")], "profile_id long, job_url string")
    crawl = crawl_offers(listing_of(spark), details_of(spark), searches_of(spark), seen, plan_of(spark))
    # pages that nobody asks for, or another site's under the same address, are not parsed
    assert {r["page_id"] for r in crawl.cards.collect()} == {1, 2, 3, 6}
    got = {(r["profile_id"], r["job_url"]): (r["page_id"], r["title"], r["location"], r["description"], r["status"], r["company"]) for r in crawl.offers.collect()}
    assert got == {
        # twice on the pages: the last card stays, the newest snapshot answers
        (1, f"{NFJ}/pl/job/1"): (2, "Data one", "Here", "text 1", "ok", "NFJ Listing"),
        # number 3 is seen; number 4 has its title, company and place, and stays
        (1, f"{NFJ}/pl/job/4"): (2, "Data three", "Here", "text 4", "ok", "NFJ Listing"),
        # led to a login wall
        (1, "https://in/v/10"): (6, "Data ten", "Here", None, "signin_wall", "Unknown")}
    # search 2 has no place: its offers break the contract
    refused = {(r["profile_id"], r["reject_reason"]) for r in crawl.matches.collect() if r["reject_reason"]}
    assert refused == {(2, "missing_location")}
    # only linked pages, each once
    assert sorted(r["page_id"] for r in crawl.details.collect()) == [101, 104, 110]
    assert {r["site"]: tuple(r)[1:] for r in crawl_funnel(crawl).collect()} == {
        "NoFluffJobs": (6, 8, 1, 4, 2, 2), "LinkedIn": (2, 1, 0, 0, 1, 0), None: (8, 9, 1, 4, 3, 2)}
    assert WALL_TEXT not in {r["description"] for r in crawl.offers.collect()}


def test_the_filter_stands_before_the_html_pass(spark):
    crawl = crawl_offers(listing_of(spark), details_of(spark), searches_of(spark), None, plan_of(spark))
    plan = crawl.offers._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInPandas"):]
    assert "LeftSemi" in below and "bits" in below  # the exact join and the Bloom filter
    assert plan.count("MapInPandas") == 1  # details once; listing pages were parsed before


def joins_of(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if " Join " in line]


def test_the_filter_is_asked_before_the_details_are_shuffled(spark):
    links = spark.createDataFrame([("LinkedIn", "https://in/v/10")], "site string, link string")
    joins = joins_of(wanted_details(details_of(spark), links))
    # the newest snapshot, the exact join, and below both the filter
    assert ["bits" in j for j in joins[:3]] == [False, False, True]


def test_a_text_is_judged_once_for_all_its_searches(spark):
    plan = crawl_offers(listing_of(spark), details_of(spark), searches_of(spark), None, plan_of(spark)).offers._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("RLIKE")  # below the join with the offers


def test_offers_without_a_page_or_with_two(spark):
    searches = spark.createDataFrame([(k, ["data"], [], [], "Here", False, 14, []) for k in (1, 2)], SEARCH)
    plan = spark.createDataFrame([(k, "NoFluffJobs", f"{NFJ}/a") for k in (1, 2)], PLAN)
    details = details_of(spark)
    twice = details.where("page_id != 104").unionByName(details.where("page_id = 101"))
    offers = crawl_offers(listing_of(spark), twice, searches, None, plan).offers
    got = sorted((r["profile_id"], r["job_url"][-1], r["status"], r["description"]) for r in offers.select("profile_id", "job_url", "status", "description").distinct().collect())
    assert got == [(k, i, *rest) for k in (1, 2) for i, *rest in (("1", "ok", "text 1"), ("4", "missing", None))]


def test_crawl_of_empty_tables(spark):
    listing, details, s = listing_of(spark), details_of(spark), searches_of(spark)
    for a, b, c in ((listing.limit(0), details, s), (listing, details.limit(0), s), (listing, details, s.limit(0))):
        crawl = crawl_offers(a, b, c, None, plan_of(spark))
        assert crawl.details.count() == 0 and {r["status"] for r in crawl.offers.collect()} <= {"missing"}
    # without requested addresses a page answers for its own
    assert wanted_details(details.drop("requested_url"), spark.createDataFrame([("LinkedIn", "https://in/v/10")], "site string, link string")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark, n):
    keys = spark.range(n).select(F.concat(F.lit("k"), "id").alias("k"))
    asked = spark.range(20_000).select(F.when(F.col("id") > 0, F.concat(F.lit("k"), "id")).alias("k"), "id")
    got = KeyFilter.of(keys, "k").may_hold(asked, "k")
    assert got.columns == ["k", "id"]
    ids = {r["id"] for r in got.collect()}
    assert ids >= set(range(1, n)) and len(ids) <= n + 0.02 * 20_000
