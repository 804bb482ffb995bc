"""From listing pages to offers: the crawl of one run, over tables of page snapshots.

``search_plan`` names the listing pages of every search. Pages that no search asks
for are not parsed; a page that many ask for is parsed once. Its cards are matched
with the searches that asked for it, checked against what each search has seen, and
only the links that are left decide which detail pages are read: a Bloom filter
over these links is asked before the detail table is shuffled, and an exact join
follows, both in front of the HTML pass (which Catalyst pushes nothing through).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_url
from ..operators.offers import description_status, validate_offers
from ..operators.pages import card_offers, page_cards, site_descriptions
from ..operators.search import compiled_profiles, match_profiles, search_plan
from ..operators.state import dedupe_keys, keep_one
from ..sources.bloom import KeyFilter

FOUND = ["profile_id", "page_id", "pos", "site", "job_url", "title", "company", "location"]
#: The status of an offer whose detail page was not read.
NO_PAGE = "missing"


@dataclass
class Crawl:
    """One crawl: the cards read; per search the matching cards with ``is_seen`` and the
    contract's ``reject_reason``; the new offers with description and status; the
    detail pages that were parsed for them."""

    cards: DataFrame
    matches: DataFrame
    offers: DataFrame
    details: DataFrame


def asked_pages(listing: DataFrame, plan: DataFrame) -> DataFrame:
    """Listing pages (page_id, site, url, html) that some search asks for."""
    return listing.join(plan.select("site", "url").distinct(), ["site", "url"], "left_semi")


def wanted_details(details: DataFrame, links: DataFrame) -> DataFrame:
    """Detail pages of the given addresses (site, link), the newest snapshot of each.

    A page answers for the address that was asked for (``requested_url``) where a
    redirect led elsewhere, else for its own."""
    asked = F.coalesce("requested_url", "url") if "requested_url" in details.columns else F.col("url")
    keyed = details.withColumn("link", canonical_url(asked))
    near = KeyFilter.of(links, "link").may_hold(keyed, "link").join(links.distinct(), ["site", "link"], "left_semi")
    newest = near.groupBy("site", "link").agg(F.max("page_id").alias("page_id"))
    return near.join(newest, ["site", "link", "page_id"], "left_semi")


def crawl_offers(listing: DataFrame, details: DataFrame, searches: DataFrame, seen: DataFrame | None = None,
                 plan: DataFrame | None = None) -> Crawl:
    """The crawl of all ``searches`` (profile table).

    ``listing`` and ``details``: page_id, url, site, html; ``seen``: profile_id, job_url;
    ``plan``: profile_id, site, url (``search_plan`` of the searches if none is given).
    Of repeats of an offer within a search the last one stays."""
    compiled = compiled_profiles(searches)
    plan = (search_plan(compiled) if plan is None else plan).select("profile_id", "site", "url").distinct()
    pages = asked_pages(listing, plan)
    # read by matching, joins and counters: parsed once
    cards = (card_offers(page_cards(pages)).join(pages.select("page_id", "url"), "page_id")
             .withColumn("card", F.monotonically_increasing_id()).checkpoint(eager=True))
    places = searches.select("profile_id", F.col("location").alias("_place"))
    found = (match_profiles(cards, compiled, key="card").join(cards, "card")
             .join(plan, ["profile_id", "site", "url"], "left_semi").join(places, "profile_id")
             .withColumn("location", F.coalesce("location", "_place")).select(*FOUND))
    known = F.lit(False)
    if seen is not None:
        marks = seen.select("profile_id", "job_url").distinct().withColumn("_known", F.lit(True))
        found = found.join(marks, ["profile_id", "job_url"], "left")
        known = F.coalesce("_known", F.lit(False))
    matches = validate_offers(found.withColumn("is_seen", known)).select(*FOUND, "is_seen", "reject_reason").checkpoint(eager=True)

    new = matches.where("not is_seen and reject_reason is null").select(*FOUND)
    new = keep_one(new, ["profile_id", *dedupe_keys()], order=("page_id", "pos")).withColumn("link", canonical_url("job_url")).checkpoint(eager=True)
    pages = wanted_details(details, new.select("site", "link"))
    texts = site_descriptions(pages.select("page_id", "url", "site", "html")).select("page_id", "description")
    texts = texts.join(pages.select("page_id", "site", "link"), "page_id").select("site", "link", "description")
    # a text is judged once, however many searches found its offer; an offer without a page has none
    offers = (new.join(description_status(texts), ["site", "link"], "left")
              .select(*FOUND, "description", F.coalesce("status", F.lit(NO_PAGE)).alias("status")))
    return Crawl(cards, matches, offers, pages)


def crawl_funnel(crawl: Crawl) -> DataFrame:
    """Per site and in all (site null): cards read, matches of a search, of these seen
    before and refused, offers added, and of these with a description."""
    zero = {c: F.lit(0) for c in ("cards", "matched", "seen", "refused", "added", "described")}

    def part(df: DataFrame, **counts):
        return df.select("site", *[F.coalesce(counts.get(c, z).cast("int"), F.lit(0)).alias(c) for c, z in zero.items()])

    one = F.lit(1)
    rows = (part(crawl.cards, cards=one)
            .unionByName(part(crawl.matches, matched=one, seen=F.col("is_seen"),
                              refused=~F.col("is_seen") & F.col("reject_reason").isNotNull()))
            .unionByName(part(crawl.offers, added=one, described=F.col("status") == "ok")))
    return rows.rollup("site").agg(*[F.sum(c).alias(c) for c in zero])
