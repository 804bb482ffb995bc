"""Listing and detail pages of the six sites, derived from ``documents``.

The document's number picks the site (``doc_id mod 6``) and one of four forms of
its markup (``doc_id / 6 mod 4``): primary and fallback selectors, cards without
link or title, stop markers, a login wall, pages without a description. The text
of a page is the document's, escaped. FIXTURES.md 2.5 lists the forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fixtures import table

SITES = ["LinkedIn", "JustJoinIT", "NoFluffJobs", "BulldogJob", "TheProtocol", "Pracuj.pl"]
LISTING_ID = 10_000_000_000  # page ids of listing pages start here, those of detail pages at twice that
LISTING_URLS = ["https://linkedin.example.org/search", "https://justjoin.it/job-offers/all",
                "https://nofluffjobs.com/pl/data", "https://bulldogjob.pl/companies/jobs/s",
                "https://theprotocol.it/filtry/data", "https://it.pracuj.pl/praca"]
DETAIL_URLS = ["https://linkedin.example.org/jobs/view/", "https://justjoin.it/job-offer/",
               "https://nofluffjobs.com/pl/job/", "https://bulldogjob.pl/companies/jobs/",
               "https://theprotocol.it/szczegoly/praca/", "https://it.pracuj.pl/o/"]
WALL_URL = "https://linkedin.example.org/authwall/"

# Slots: I number, T first line, C company, L place.
_CARD = ('<div class="base-card"><a class="base-card__full-link" href="https://linkedin.example.org/jobs/view/{I}?trk=1">x'
         '</a><h3 class="base-search-card__title"> {T} </h3><h4 class="base-search-card__subtitle">{C}</h4>'
         '<span class="job-search-card__location">{L}</span></div>')
_OLD_CARD = ('<li class="result-card"><a class="result-card__full-card-link" '
             'href="https://linkedin.example.org/jobs/view/{I}">x</a><h3 class="result-card__title">{T}</h3>'
             '<h4 class="result-card__subtitle">{C}</h4><span class="result-card__location">{L}</span></li>')
_BARE_CARD = ('<div class="base-card"><a class="base-card__full-link" '
              'href="https://linkedin.example.org/jobs/view/{I}">x</a></div>')
_NO_LINK = '<div class="base-card"><h3 class="base-search-card__title">no link</h3></div>'
_ITEM = ('<div data-test="offer-item"><a data-test="link-offer" href="https://it.pracuj.pl/o/{I}?s=1">x</a>'
         '<h2 data-test="offer-title">{T}</h2></div>')
_OLD_ITEM = ('<div class="offer-view"><a data-test="link-offer" href="/o/{I}?s=2">x</a>'
             '<h2 data-test="offer-title">{T}</h2></div>')
LISTING_FORMS = [
    [_CARD + _NO_LINK, _OLD_CARD, _BARE_CARD, _CARD + _OLD_CARD],
    ['<a class="k" href="/job-offer/{I}"><h2>{T} 20 000 PLN</h2><span>s</span></a>',
     '<a data-href="/no" href="/job-offer/{I}"><span>{T}</span></a>', "<a href='/job-offer/{I}'>{T}</a>",
     '<a href="/about">{T}</a>'],
    ['<a href="/pl/job/{I}"><h3>{T}</h3></a>', '<a href="/pl/job/{I}/job-apply"><h3>{T}</h3></a>',
     '<a href="/pl/job/{I}">{T}</a>', '<!-- <a href="/pl/job/0"> --><A HREF="/pl/job/{I}"><h3>{T}</h3></A>'],
    ['<a href="/companies/jobs/{I}?a=1&amp;b=2"><h3>{T}</h3></a>',
     '<a href="https://bulldogjob.pl/companies/jobs/{I}"><h3>{T}</h3></a>',
     '<a href="/companies/jobs/page,2"><h3>{T}</h3></a>', '<a href="/companies/jobs/{I}">{T}</a>'],
    ['<a href="/szczegoly/praca/{I}"><h2>{T}</h2></a>', '<a href="/szczegoly/praca/{I}">{T}</a>',
     '<a href="/szczegoly/praca/{I}"><h2><b>{T}</b> x</h2></a>', '<a name="top"><h2>{T}</h2></a>'],
    [_ITEM, '<div data-test="offer-item"><a data-test="link-offer" href="https://it.pracuj.pl/o/{I}">x</a></div>',
     _OLD_ITEM, _OLD_ITEM + _ITEM],
]
# Slot: D the whole text.
DETAIL_FORMS = [
    ['<div class="x description__text">{D}</div>',
     '<p class="jobs-description">{D}</p><div class="description__text">second</div>', "<p>none</p>", "<p>none</p>"],
    ["<div>{D}</div><div>short</div>", "<div>Sign in<b>{D}</b></div>", "<div>{D}</div><div>{D}</div>", "<p>{D}</p>"],
    ['<section id="posting-description">{D}</section>', '<div class="common-posting-content-wrapper">{D}</div>',
     '<div class="common-posting-content-wrapper">second</div><section id="posting-description">{D}</section>',
     "<p>{D}</p>"],
    ['<div id="job-description">{D}</div>', '<div class="text-sm">{D}</div>',
     '<div class="text-sm">second</div><div id="job-description">{D}</div>', "<p>{D}</p>"],
    ['<section data-test="section-description">{D}</section>', "<article>{D}</article>",
     '<article>second</article><section data-test="section-description">{D}</section>', "<p>{D}</p>"],
    ['<div data-test="section-a">{D}</div><div data-test="other">no</div><div data-test="section-b">second</div>',
     '<div id="offer-view">{D}</div>', '<div class="offer-view">second</div><div id="offer-view">{D}</div>',
     '<div class="big offer-view">{D}</div>'],
]


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"),
                     F.lit("&gt;"))


def _form(forms: list[list[str]], site, form, slots: dict):
    html = F.element_at(F.array(*[F.lit(f"<html><body>{m}</body></html>") for per_site in forms for m in per_site]),
                        (site * 4 + form + 1).cast("int"))
    for slot, value in slots.items():
        html = F.replace(html, F.lit(f"{{{slot}}}"), value)
    return html


def _of_site(values: list[str], site):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (site + 1).cast("int"))


def _parts(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    return docs, doc.cast("string"), doc % 6, F.floor(doc / 6) % 4, F.coalesce("text", F.lit(""))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, site, html): one listing page per document."""
    docs, number, site, form, text = _parts(spark, sf_dir)
    html = _form(LISTING_FORMS, site, form, {"I": number, "C": _escaped("source"), "L": _escaped("lang"),
                                             "T": _escaped(F.substring_index(text, "\n", 1))})
    return docs.select((F.col("doc_id") + LISTING_ID).alias("page_id"), _of_site(LISTING_URLS, site).alias("url"),
                       _of_site(SITES, site).alias("site"), html.alias("html"))


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, requested_url, site, html): one detail page per document. A
    login wall has an address of its own."""
    docs, number, site, form, text = _parts(spark, sf_dir)
    asked = F.concat(_of_site(DETAIL_URLS, site), number)
    url = F.when((site == 0) & (form == 2), F.concat(F.lit(WALL_URL), number)).otherwise(asked)
    return docs.select((F.col("doc_id") + 2 * LISTING_ID).alias("page_id"), url.alias("url"), asked.alias("requested_url"),
                       _of_site(SITES, site).alias("site"),
                       _form(DETAIL_FORMS, site, form, {"D": _escaped(text)}).alias("html"))


def asked_listing_pages(spark: SparkSession, sf_dir: str, plan: DataFrame) -> DataFrame:
    """The listing pages under addresses that a crawl plan asks for: page after page,
    the addresses of its site in order; every ninth page keeps its own address."""
    asked = plan.select("site", "url").distinct()
    order = Window.partitionBy("site").orderBy("url")  # one row per address of a plan
    urls = asked.groupBy("site").agg(F.count("*").alias("n")).join(
        asked.withColumn("k", F.row_number().over(order) - 1), "site").select("site", "n", "k", F.col("url").alias("asked"))
    doc = F.col("page_id") - LISTING_ID
    pages = listing_pages(spark, sf_dir).withColumn("turn", F.floor(doc / 6))
    sizes = urls.select("site", "n").distinct()
    return (pages.join(sizes, "site", "left").withColumn("k", F.col("turn") % F.col("n")).join(urls.drop("n"), ["site", "k"], "left")
            .select("page_id", F.when(F.col("turn") % 9 == 8, F.col("url")).otherwise(F.coalesce("asked", "url")).alias("url"),
                    "site", "html"))


#: DuckDB: the documents with site number, form, first line.
SITE_DOCS_SQL = """site_docs AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, split_part(coalesce(text, ''), chr(10), 1) AS t1,
    doc_id % 6 AS s, (doc_id // 6) % 4 AS v FROM documents)"""
