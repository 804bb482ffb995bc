"""Tables read by key, and sites as rows."""

import glob

import pytest
from pyspark.sql import functions as F

from offerflow.operators import pages as pg
from offerflow.operators import site_rules as sr
from offerflow.session import scratch_path
from offerflow.sources import ranged


def test_one_search_is_read_from_the_files_that_hold_it(spark):
    lines = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("profile_id"),
                                     (F.col("id") * 7919 % 6000).alias("ord"), F.concat(F.lit("line "), "id").alias("html"))
    lines = lines.unionByName(spark.createDataFrame([(None, 1, "none")], lines.schema))
    path = scratch_path(spark, "ranged")
    ranged.write_ranged(lines, path, "profile_id", ["ord"], partitions=12)
    files = glob.glob(path.removeprefix("file:") + "/rows/*.parquet")
    assert len(files) <= 12  # however many searches there are
    want = {}
    for r in lines.collect():
        want.setdefault(r["profile_id"], []).append((r["ord"], r["html"]))
    for key in (7, 8, 0, 499, None, 1234):
        got = ranged.read_key(spark, path, "profile_id", key)
        rows = [(r["ord"], r["html"]) for r in got.collect()]
        assert sorted(rows) == sorted(want.get(key, []))
        if key not in (7, None):
            assert len(got.inputFiles()) <= 2 and rows == sorted(rows)
    assert 3 <= len(ranged.read_key(spark, path, "profile_id", 7).inputFiles()) < 12  # a hot search spans files
    assert ranged.read_ranged(spark, path).count() == 6001
    ranged.write_ranged(lines.limit(0), path, "profile_id", ["ord"], partitions=2)
    assert ranged.read_ranged(spark, path).count() == ranged.read_key(spark, path, "profile_id", 7).count() == 0


def test_ranged_files_are_packed_by_page(spark):
    path = scratch_path(spark, "packed")
    df = spark.range(10).select("id", F.lit("x").alias("html"))
    ranged.write_ranged(df, path, "id", partitions=2)
    assert all(f.endswith(".zstd.parquet") for f in ranged.read_ranged(spark, path).inputFiles())
    assert ranged.read_ranged(spark, path).count() == 10


def test_an_age_limit_opens_the_days_it_needs(spark):
    import datetime as dt

    from offerflow.operators.offers import fresh_only
    from offerflow.sources import daily

    ref = "2024-03-01 12:00:00"
    rows = [(i, f"u{i}", dt.datetime(2024, 2, 1 + i % 29, i % 24)) for i in range(600)] + [(700, "u", None), (701, None, dt.datetime(2024, 3, 1, 13))]
    offers = spark.createDataFrame(rows, "seq long, job_url string, posted_ts timestamp_ntz")
    path = scratch_path(spark, "by-day")
    daily.write_by_day(offers, path)
    seqs = lambda df: sorted(r["seq"] for r in df.collect())
    for days in (0, 3, 14, 400):
        got = daily.read_fresh(spark, path, ref, days)
        assert seqs(got) == seqs(fresh_only(offers, ref, days)) and got.columns == offers.columns
    got = daily.read_fresh(spark, path, ref, 3)
    scan = got._jdf.queryExecution().executedPlan().toString()
    filters = scan.split("PartitionFilters: ")[1].split("]")[0]
    assert "day#" in filters and ">= 2024-02-27" in filters
    days = glob.glob(path.removeprefix("file:") + "/day=*")
    opened = {r[0].split("/")[-2] for r in got.select(F.input_file_name()).distinct().collect()}
    assert len(days) == 31 and opened <= {f"day=2024-02-{d}" for d in (27, 28, 29)} | {"day=2024-03-01"}
    s = spark.createDataFrame([(1, 3), (2, 14)], "profile_id long, max_days_old int")
    assert seqs(daily.read_for(spark, path, ref, s)) == seqs(fresh_only(offers, ref, 14))
    assert daily.read_for(spark, path, ref, s.unionByName(spark.createDataFrame([(3, None)], s.schema))).count() == 602
    assert daily.read_for(spark, path, ref, s.limit(0)).count() == 602


def test_built_in_sites_read_alike_by_rows_and_by_rules(spark):
    from conftest import SF_SMALL
    from offerflow.sources import site_pages as sp

    rules = sr.builtin_rules(spark)
    listing, details = sp.listing_pages(spark, SF_SMALL), sp.detail_pages(spark, SF_SMALL)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(sr.cards_by_rules(listing, rules)) == rows(pg.page_cards(listing))
    assert rows(sr.offers_of_cards(sr.cards_by_rules(listing, rules), rules, "K")) == rows(pg.card_offers(pg.page_cards(listing), search_place="K"))
    plain = pg.site_descriptions(details).select("page_id", "site", F.when(F.col("description") == pg.WALL_TEXT, "").otherwise(F.col("description")))
    assert rows(sr.descriptions_by_rules(details, rules)) == rows(plain)


@pytest.mark.parametrize("order", [1, -1])
def test_rules_in_any_order_equal_ranks_and_unknown_sites(spark, order):
    s = "Own"
    rows = [(s, "container", 0, "div", "class", "eq", "job"), (s, "container", 1, "li", "data-x", "prefix", "job-"),
            (s, "link", 1, "a", "href", "any", None), (s, "link", 0, "a", "id", "eq", "main"), (s, "title", 0, "*", "class", "eq", "t"),
            (s, "setting", 0, None, "marker", None, "/j/"), (s, "setting", 0, None, "prefix", None, "https://own"),
            (s, "setting", 0, None, "title_default", None, "?"), (s, "longest", 0, "p", None, "none", None), (s, "stop_phrase", 0, None, None, None, "bad"),
            ("Bare", "description", 0, "b", None, "none", None)][::order]
    rules = spark.createDataFrame(rows, sr.RULE)
    html = ('<div class="a job"><a href="/no"></a><a id="main" href="/j/1">x</a><i class="t u">One</i></div><li data-x="job-2"><a href="/j/2">y</a></li>'
            '<div class="job"><a href="/other/3">z</a></div>')
    pages = spark.createDataFrame([(1, s, html), (2, "Unknown", html), (3, None, html), (4, s, None), (5, "Bare", "<b>text</b>")], "page_id long, site string, html string")
    got = sr.offers_of_cards(sr.cards_by_rules(pages, rules), rules, "Here").collect()
    assert sorted((r["page_id"], r["job_url"], r["title"], r["location"]) for r in got) == [
        (1, "https://own/j/1", "One", "Here")]  # the other container counts only where the first has no hit
    only = spark.createDataFrame([(1, s, '<li data-x="job-2"><a href="/j/2">y</a></li>')], pages.schema)
    assert [(r["job_url"], r["title"]) for r in sr.offers_of_cards(sr.cards_by_rules(only, rules), rules).collect()] == [("https://own/j/2", "?")]
    more = spark.createDataFrame([(6, s, "<p>short</p><p>the longest but bad</p><p>longer text</p>")], pages.schema)
    texts = {r["page_id"]: r["description"] for r in sr.descriptions_by_rules(pages.unionByName(more), rules).collect()}
    assert texts == {1: "", 2: "", 3: "", 4: "", 5: "text", 6: "longer text"}
    assert sr.cards_by_rules(pages, rules.limit(0)).count() == 0


def test_pages_meet_their_rules_without_a_shuffle_by_site(spark):
    pages = spark.createDataFrame([(i, "Example", "<article>a</article>") for i in range(4)], "page_id long, site string, html string")
    rules = spark.createDataFrame([("Example", "description", 0, "article", None, "none", None)], sr.RULE)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables whose size Spark does not know to be small
    try:
        out = sr.descriptions_by_rules(pages, rules)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r["description"] for r in out.collect()} == {"a"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
