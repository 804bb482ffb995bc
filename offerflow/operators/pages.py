"""Operators over a table of page snapshots ``pages(page_id, url, html)``.

* One Python parse pass per page (``mapInPandas`` with the standard library
  ``html.parser``) yields links (:func:`page_links`), offer cards
  (:func:`page_cards`), descriptions (:func:`site_descriptions`) or element rows
  (:func:`parse_elements`); the rules are data. A table of pages of many sites
  is parsed once: the ``site`` of a page picks its rule.
* The operators over element rows (longest block, ordered description rules,
  section joins) are native Spark, grouped by page.

Tables of fewer files than shuffle partitions are spread first; larger ones are
parsed where they are read. Rows leave a worker page by page in small chunks.

Text of an element follows the usual "visible text" rule: every text node
stripped, empty ones dropped, joined with a newline; script and style bodies
and comments are not text; entities are decoded. Unclosed tags stay open
until an ancestor closes, as a tolerant parser does.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import absolute_url, canonical_url, clean_listing_title
from ..plans.partitioning import spread_few
from ..schemas import ELEMENT

CHUNK_ROWS = 2000  # rows that a parse pass holds before it hands them on

# Per-site link markers (keep if the href holds the marker and
# not the stop marker).
LINK_RULES = [
    ("JustJoinIT", "/job-offer/", None),
    ("NoFluffJobs", "/pl/job/", "job-apply"),
    ("BulldogJob", "/companies/jobs/", "page,"),
    ("TheProtocol", "/szczegoly/praca/", None),
]

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
         "track", "wbr"}
_RAW = {"script", "style", "template"}


def link_site_col(href: Column) -> Column:
    """Site whose marker rule keeps the link (first rule wins), else null."""
    expr = None
    for site, keep, stop in LINK_RULES:
        cond = href.contains(keep)
        if stop:
            cond = cond & ~href.contains(stop)
        expr = F.when(cond, F.lit(site)) if expr is None else expr.when(cond, F.lit(site))
    return expr


class _LinkParser(HTMLParser):
    """The href values of all ``a`` tags, in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hrefs: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            href = dict(attrs).get("href", False)  # the last of repeated attributes counts
            if href is not False:
                self.hrefs.append(href or "")


def _chunked(batches, columns: list[str], rows_of):
    """Frames of CHUNK_ROWS rows or a little more from ``rows_of(*row)`` of each input row."""
    for pdf in batches:
        rows: list[tuple] = []
        for values in pdf.itertuples(index=False, name=None):
            rows.extend(rows_of(*values))
            if len(rows) >= CHUNK_ROWS:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def page_links(pages: DataFrame) -> DataFrame:
    """One row per ``<a href=...>`` tag: (page_id, page_url, pos, href, site).

    Links are parsed attributes: any quotes and letter case, character
    references decoded; comments, scripts and other attributes give none. A null
    page has no links."""
    def links(page_id, url, html):
        p = _LinkParser()
        p.feed(html or "")
        p.close()
        return [(page_id, url, i, h) for i, h in enumerate(p.hrefs)]

    columns = ["page_id", "page_url", "pos", "href"]

    def run(batches):
        yield from _chunked(batches, columns, links)

    out = spread_few(pages.select("page_id", "url", "html"), "page_id").mapInPandas(
        run, "page_id long, page_url string, pos long, href string")
    return out.withColumn("site", link_site_col(F.col("href")))


# ---------------------------------------------------------------------------
# the parse pass
# ---------------------------------------------------------------------------

def _matches(sel, tag: str, attrs: dict) -> bool:
    """sel = (tag, attr, value, op): op 'eq' (class: token), 'prefix'."""
    s_tag, s_attr, s_val, op = sel
    if s_tag not in ("*", tag):
        return False
    if s_attr is None:
        return True
    v = attrs.get(s_attr)
    if v is None:
        return False
    if op == "prefix":
        return v.startswith(s_val)
    if op == "any":
        return True
    if s_attr == "class":
        return s_val in v.split()
    return v == s_val


class _Node:
    """An element; its text is a span of the page's list of text nodes."""

    __slots__ = ("pos", "depth", "parent", "tag", "attrs", "keep", "firsts", "is_card", "start", "end",
                 "raw_start", "raw_end")

    def __init__(self, pos, depth, parent, tag, attrs, keep, start, raw_start):
        self.pos, self.depth, self.parent, self.tag, self.attrs = pos, depth, parent, tag, attrs
        self.keep = keep
        self.firsts = None
        self.is_card = False
        self.start = self.end = start
        self.raw_start = self.raw_end = raw_start


class _PageParser(HTMLParser):
    """Builds element records for kept tags, and card records for a card rule."""

    def __init__(self, keep_tags, card_rule=None):
        super().__init__(convert_charrefs=True)
        self.keep_tags = keep_tags
        self.card = card_rule
        self.stack: list[_Node] = []
        self.done: list[_Node] = []
        self.cards: list[_Node] = []
        self.doc_texts: list[str] = []
        self.raw_texts: list[str] = []  # unstripped, for rules with raw_text
        self.buf: list[str] = []
        self.raw_depth = 0
        self.pos = 0
        if card_rule:
            self.sel_lists = [card_rule.get(part) or [] for part in ("link", "title", "company", "place")]

    # text -------------------------------------------------------------
    def _flush(self):
        if not self.buf:
            return
        s = "".join(self.buf)
        self.buf = []
        if self.card and self.card.get("raw_text"):
            self.raw_texts.append(s)
        s = s.strip()
        if s:
            self.doc_texts.append(s)

    def _shut(self, n: _Node):
        n.end, n.raw_end = len(self.doc_texts), len(self.raw_texts)
        self.done.append(n)

    def text(self, n: _Node, sep: str = "\n") -> str:
        return sep.join(self.doc_texts[n.start:n.end])

    def card_text(self, n: _Node) -> str:
        """Stripped strings joined without separator; with raw_text the text as it stands, its ends stripped."""
        if self.card.get("raw_text"):
            return "".join(self.raw_texts[n.raw_start:n.raw_end]).strip()
        return self.text(n, "")

    def read(self, html):
        """Parse a whole page; a parser error keeps what was parsed."""
        try:
            self.feed(html or "")
            self.close()
        except Exception:  # noqa: BLE001 - a broken page must not cost its neighbours
            self.broken = True
        self._flush()
        for n in self.stack:
            self._shut(n)
        self.stack = []
        return self

    broken = False

    def handle_data(self, data):
        if self.raw_depth == 0:
            self.buf.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    # tags -------------------------------------------------------------
    def _open(self, tag, attrs, push: bool):
        self._flush()
        self.pos += 1
        a = {k: (v if v is not None else "") for k, v in attrs}
        parent = self.stack[-1].pos if self.stack else 0
        card = self.card
        is_card = False
        if card:
            is_card = any(_matches(s, tag, a) for s in card["container"])
        node = _Node(self.pos, len(self.stack), parent, tag, a, tag in self.keep_tags, len(self.doc_texts),
                     len(self.raw_texts))
        if card:
            # first matching descendant per selector, in document order
            for anc in self.stack:
                if anc.is_card:
                    for li, sels in enumerate(self.sel_lists):
                        for si, s in enumerate(sels):
                            key = (li, si)
                            if key not in anc.firsts and _matches(s, tag, a):
                                anc.firsts[key] = node
            if is_card:
                node.is_card = True
                node.firsts = {}
                self.cards.append(node)
        if push and tag not in _VOID:
            self.stack.append(node)
        else:
            self.done.append(node)
        if tag in _RAW and push:
            self.raw_depth += 1

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs, True)

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs, False)

    def handle_endtag(self, tag):
        self._flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                for n in self.stack[i:]:
                    if n.tag in _RAW:
                        self.raw_depth = max(0, self.raw_depth - 1)
                    self._shut(n)
                del self.stack[i:]
                return


def parse_elements(pages: DataFrame, keep_tags: Iterable[str] = ("div", "article", "p", "section", "a", "h1",
                                                                  "h2", "h3", "span")) -> DataFrame:
    """Element rows (ELEMENT schema) for the kept tags, plus one row per page
    with tag '#document' (pos 0) holding the whole visible text."""
    keep = frozenset(keep_tags)

    def elements(page_id, html):
        p = _PageParser(keep).read(html)
        yield (page_id, 0, 0, None, "#document", None, None, None, None, "\n".join(p.doc_texts))
        for n in p.done:
            if n.keep:
                a = n.attrs
                yield (page_id, n.pos, n.depth, n.parent, n.tag, a.get("id"), a.get("class"), a.get("data-test"),
                       a.get("href"), p.text(n))

    def run(batches):
        yield from _chunked(batches, [f.name for f in ELEMENT.fields], elements)

    return spread_few(pages.select("page_id", "html"), "page_id").mapInPandas(run, ELEMENT)


# ---------------------------------------------------------------------------
# native operators over element rows
# ---------------------------------------------------------------------------

def _sel_col(sel) -> Column:
    tag, attr, val, op = sel
    cond = F.col("tag") == tag if tag != "*" else F.lit(True)
    if attr is None:
        return cond
    col = {"id": "el_id", "class": "el_class", "data-test": "data_test", "href": "href"}[attr]
    c = F.col(col)
    if op == "prefix":
        return cond & c.startswith(val)
    if op == "any":
        return cond & c.isNotNull()
    if attr == "class":
        return cond & F.array_contains(F.split(F.coalesce(c, F.lit("")), r"\s+"), F.lit(val))
    return cond & (c == val)


def longest_block(elements: DataFrame, tags: Sequence[str] = ("div",), lo: int = 200, hi: int = 15000,
                  stop_phrases: Sequence[str] = ("Sign in",)) -> DataFrame:
    """Per page: the longest block text with lo < length < hi holding no stop
    phrase; first in document order wins ties; "" when none."""
    L = F.length("text")
    ok = F.col("tag").isin(*tags) & (L > lo) & (L < hi)
    for s in stop_phrases:
        ok = ok & ~F.col("text").contains(s)
    best = F.max_by(F.col("text"), F.when(ok, F.struct(L.alias("len"), (-F.col("pos")).alias("neg_pos"))))
    return elements.groupBy("page_id").agg(F.coalesce(best, F.lit("")).alias("description"))


def page_description(elements: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """Per page: text of the first element matching the first rule that hits
    (rule order, then document order); "" when none. A rule may be a list of
    selectors of equal rank."""
    rank = None
    for i, rule in enumerate(rules):
        cond = F.lit(False)
        for sel in rule if isinstance(rule, list) else [rule]:
            cond = cond | _sel_col(sel)
        rank = F.when(cond, F.lit(i)) if rank is None else rank.when(cond, F.lit(i))
    key = F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("pos").alias("pos")))
    best = F.min_by(F.col("text"), key)
    return elements.groupBy("page_id").agg(F.coalesce(best, F.lit("")).alias("description"))


def join_sections(elements: DataFrame, prefix: str = "section-",
                  fallback: Sequence[tuple] = (("div", "id", "offer-view", "eq"),
                                               ("div", "class", "offer-view", "eq"))) -> DataFrame:
    """All div blocks whose data-test starts with the prefix, in document
    order, joined by a blank line; else the first fallback block; else ""."""
    is_sec = (F.col("tag") == "div") & F.col("data_test").startswith(prefix)
    secs = F.array_sort(F.collect_list(F.when(is_sec, F.struct(F.col("pos"), F.col("text")))))
    joined = F.array_join(F.transform(secs, lambda s: s["text"]), "\n\n")
    rank = None
    for i, sel in enumerate(fallback):
        cond = _sel_col(sel)
        rank = F.when(cond, F.lit(i)) if rank is None else rank.when(cond, F.lit(i))
    fb = F.min_by(F.col("text"), F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("pos").alias("p"))))
    agg = elements.groupBy("page_id").agg(secs.alias("_secs"), joined.alias("_joined"), fb.alias("_fb"))
    return agg.select("page_id", F.when(F.size("_secs") > 0, F.col("_joined"))
                      .otherwise(F.coalesce(F.col("_fb"), F.lit(""))).alias("description"))


# ---------------------------------------------------------------------------
# cards
# ---------------------------------------------------------------------------

CARD_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("site", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("href", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("place", T.StringType()),
])


def _pick(card: _Node, li: int, sels) -> _Node | None:
    for si in range(len(sels)):
        n = card.firsts.get((li, si))
        if n is not None:
            return n
    return None


def _cards_of(page_id, html, rule: dict):
    p = _PageParser(frozenset(), rule).read(html)
    by_sel: dict[int, list[_Node]] = {}
    for c in p.cards:
        si = next(i for i, s in enumerate(rule["container"]) if _matches(s, c.tag, c.attrs))
        by_sel.setdefault(si, []).append(c)
    for c in by_sel[min(by_sel)] if by_sel else []:
        ln = _pick(c, 0, rule["link"]) if rule.get("link") else c
        href = ln.attrs.get("href") if ln is not None else None
        if href is None:
            continue
        tn = _pick(c, 1, rule.get("title") or [])
        if tn is None and rule.get("title_self"):
            tn = c
        if tn is None and rule.get("title_required"):
            continue
        title = p.card_text(tn) if tn is not None else rule.get("title_default")
        company = rule.get("company_const")
        if company is None:
            cn = _pick(c, 2, rule.get("company") or [])
            company = p.card_text(cn) if cn is not None else rule.get("company_default")
        pn = _pick(c, 3, rule.get("place") or [])
        yield (page_id, rule["site"], c.pos, href, title, company, p.card_text(pn) if pn is not None else None)


def page_cards(pages: DataFrame, rule: dict | None = None, rules: dict[str, dict] | None = None) -> DataFrame:
    """Offer cards of listing pages by one rule, or by the rule that ``rules``
    (SITE_CARD_RULES where none are given) holds for the page's ``site``; pages of
    other sites have no cards. Every page is parsed once.

    Containers: the first container selector that has hits on the page
    (fallback containers only when the primary has none). Link, title, company
    and place: first matching descendant per ordered fallback selector. A card
    without a link is skipped; with ``title_required`` a card without title
    too. Text is the stripped strings joined without separator. The place is
    null where the site's cards name none.
    """
    table = SITE_CARD_RULES if rules is None else rules
    source = pages.select("page_id", "html", (F.lit(None).cast("string") if rule else F.col("site")).alias("site"))

    def cards(page_id, html, site):
        r = rule or table.get(site)
        return _cards_of(page_id, html, r) if r else ()

    def run(batches):
        yield from _chunked(batches, CARD_SCHEMA.names, cards)

    return spread_few(source, "page_id").mapInPandas(run, CARD_SCHEMA)


def _s(tag, attr=None, val=None, op="eq"):
    return (tag, attr, val, op)


# Listing-page card rules per site.
CARD_RULES = {
    "LinkedIn": dict(site="LinkedIn", container=[_s("div", "class", "base-card"), _s("li", "class", "result-card")],
                     link=[_s("a", "class", "base-card__full-link"), _s("a", "class", "result-card__full-card-link")],
                     title=[_s("h3", "class", "base-search-card__title"), _s("h3", "class", "result-card__title")],
                     title_default="Unknown",
                     company=[_s("h4", "class", "base-search-card__subtitle"), _s("h4", "class", "result-card__subtitle")],
                     company_default="Unknown", cut_query=True),
    # legacy generation: other defaults, text as it stands, the card's own place
    "LinkedIn_legacy": dict(site="LinkedIn",
                            container=[_s("div", "class", "base-card"), _s("li", "class", "result-card")],
                            link=[_s("a", "class", "base-card__full-link"),
                                  _s("a", "class", "result-card__full-card-link")],
                            title=[_s("h3", "class", "base-search-card__title"), _s("h3", "class", "result-card__title")],
                            title_default="Nieznane",
                            company=[_s("h4", "class", "base-search-card__subtitle"),
                                     _s("h4", "class", "result-card__subtitle")],
                            company_default="Nieznana",
                            place=[_s("span", "class", "job-search-card__location"),
                                   _s("span", "class", "result-card__location")],
                            raw_text=True, cut_query=True),
    "JustJoinIT_legacy": dict(site="JustJoinIT", container=[_s("a", "href", None, "any")], link=None, title_self=True,
                              company_const="JJIT Listing", marker="/job-offer/", prefix="https://justjoin.it",
                              prefix_always=True, raw_text=True),
    "JustJoinIT": dict(site="JustJoinIT", container=[_s("a", "href", None, "any")], link=None,
                       title=[_s("h2"), _s("span")], title_self=True, company_const="JJIT Listing",
                       marker="/job-offer/", prefix="https://justjoin.it", prefix_always=True, clean_title=True),
    "NoFluffJobs": dict(site="NoFluffJobs", container=[_s("a", "href", None, "any")], link=None,
                        title=[_s("h3")], title_required=True, company_const="NFJ Listing",
                        marker="/pl/job/", stop="job-apply", prefix="https://nofluffjobs.com", prefix_always=True),
    "BulldogJob": dict(site="BulldogJob", container=[_s("a", "href", None, "any")], link=None,
                       title=[_s("h3")], title_required=True, company_const="BulldogJob",
                       marker="/companies/jobs/", stop="page,", prefix="https://bulldogjob.pl", prefix_always=False),
    "TheProtocol": dict(site="TheProtocol", container=[_s("a", "href", None, "any")], link=None,
                        title=[_s("h2")], title_required=True, company_const="TheProtocol",
                        marker="/szczegoly/praca/", prefix="https://theprotocol.it", prefix_always=True),
    "Pracuj.pl": dict(site="Pracuj.pl", container=[_s("div", "data-test", "offer-item")],
                      link=[_s("a", "data-test", "link-offer")], title=[_s("h2", "data-test", "offer-title")],
                      title_required=True, company_const="Pracuj.pl Listing", cut_query=True),
    # legacy generation: fallback container, prefix unless absolute, no cut
    "Pracuj.pl_legacy": dict(site="Pracuj.pl", container=[_s("div", "data-test", "offer-item"),
                                                          _s("div", "class", "offer-view")],
                             link=[_s("a", "data-test", "link-offer")], title=[_s("h2", "data-test", "offer-title")],
                             title_required=True, company_const="Pracuj.pl Listing",
                             prefix="https://it.pracuj.pl", prefix_always=False),
}

SITE_CARD_RULES = {name: rule for name, rule in CARD_RULES.items() if name == rule["site"]}
SITE_CARD_RULES_LEGACY = {name: CARD_RULES.get(f"{name}_legacy", rule) for name, rule in SITE_CARD_RULES.items()}

# Description-page rules per site (ordered selectors).
DESCRIPTION_RULES = {
    "LinkedIn": [[_s("*", "class", "description__text"), _s("*", "class", "show-more-less-html__markup"),
                  _s("*", "class", "jobs-description")]],
    "NoFluffJobs": [_s("section", "id", "posting-description"), _s("div", "class", "common-posting-content-wrapper")],
    "BulldogJob": [_s("div", "id", "job-description"), _s("div", "class", "text-sm")],
    "TheProtocol": [_s("section", "data-test", "section-description"), _s("article")],
}


def card_offers(cards: DataFrame, rule: dict | None = None, rules: dict[str, dict] | None = None,
                search_place: str | Column | None = None) -> DataFrame:
    """Marker filter, link form and title clean-up of one site rule, or of each
    card's own site, as columns. The location is the card's place, else the place of
    the search (null where none is given)."""
    sites = {None: rule} if rule else (SITE_CARD_RULES if rules is None else rules)
    keep, link, title = F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string")
    for site, r in sites.items():
        mine = F.lit(True) if site is None else F.col("site") == site
        ok = mine
        if r.get("marker"):
            ok = ok & F.col("href").contains(r["marker"])
        if r.get("stop"):
            ok = ok & ~F.col("href").contains(r["stop"])
        href = canonical_url("href") if r.get("cut_query") else F.col("href")
        if r.get("prefix"):
            href = absolute_url(href, r["prefix"], always=r.get("prefix_always", False))
        keep = keep | ok
        link = F.when(mine, href).otherwise(link)
        title = F.when(mine, clean_listing_title("title") if r.get("clean_title") else F.col("title")).otherwise(title)
    place = search_place if isinstance(search_place, Column) else F.lit(search_place).cast("string")
    return cards.where(keep).select("page_id", "site", "pos", link.alias("job_url"), title.alias("title"), "company",
                                    F.coalesce(F.col("place"), place).alias("location"))


# The sites whose description is the longest div, or a join of
# sections with fallback blocks; DESCRIPTION_RULES holds the other sites.
LONGEST_RULES = {"JustJoinIT": dict(tags=("div",), lo=200, hi=15000, stop_phrases=("Sign in",))}
LONGEST_RULES_LEGACY = {"JustJoinIT": dict(tags=("div",), lo=200, hi=15000,
                                           stop_phrases=("Offers with salary", "Sign in"))}
SECTION_RULES = {"Pracuj.pl": dict(prefix="section-", fallback=[_s("div", "id", "offer-view"),
                                                                _s("div", "class", "offer-view")])}
# Texts stored in place of a description.
WALL_TEXT = "Błąd: LinkedIn wyświetlił ekran logowania. Nie można pobrać opisu."
WALL_MARKERS = ("authwall", "login")
GUEST_TEXT = "Opis dostępny bezpośrednio na LinkedIn (Guest Mode)."
NO_TEXT = "Brak opisu dla {site}."


def first_by_rank(p: _PageParser, nodes, ranks, found: bool = False) -> str | bool:
    """Text of the first node that the first rank with a hit selects (with ``found``: whether one does)."""
    for rank in ranks:
        for n in nodes:
            if any(_matches(s, n.tag, n.attrs) for s in (rank if isinstance(rank, list) else [rank])):
                return found or p.text(n)
    return False if found else ""


def _describe(html, site, longest: dict) -> str:
    p = _PageParser(frozenset()).read(html)
    nodes = sorted(p.done, key=lambda n: n.pos)
    if site in longest:
        r, best = longest[site], ""
        for n in nodes:
            if n.tag in r["tags"]:
                text = p.text(n)
                if max(r["lo"], len(best)) < len(text) < r["hi"] and not any(s in text for s in r["stop_phrases"]):
                    best = text
        return best
    if site in SECTION_RULES:
        r = SECTION_RULES[site]
        parts = [p.text(n) for n in nodes if n.tag == "div" and (n.attrs.get("data-test") or "").startswith(r["prefix"])]
        return "\n\n".join(parts) if parts else first_by_rank(p, nodes, r["fallback"])
    return first_by_rank(p, nodes, DESCRIPTION_RULES.get(site, []))


def site_descriptions(pages: DataFrame, legacy: bool = False) -> DataFrame:
    """The description of every detail page by the rule of its ``site``:
    (page_id, url, site, description), one parse per page; only the chosen text
    leaves the worker. "" where no rule hits and for an unknown or null site.

    A LinkedIn page without a description whose address names a login wall gives
    the wall's text. ``legacy``: LinkedIn pages are not read, one more stop
    phrase, and a text of its own for a missing description."""
    longest = LONGEST_RULES_LEGACY if legacy else LONGEST_RULES

    def texts(page_id, url, site, html):
        return [(page_id, url, site, "" if html is None else _describe(html, site, longest))]

    columns = ["page_id", "url", "site", "description"]

    def run(batches):
        yield from _chunked(batches, columns, texts)

    # a page that is not read leaves its markup behind
    html = F.when(F.col("site") != "LinkedIn", F.col("html")) if legacy else F.col("html")
    out = spread_few(pages.select("page_id", "url", "site", html.alias("html")), "page_id").mapInPandas(
        run, "page_id long, url string, site string, description string")
    d, linkedin = F.col("description"), F.col("site") == "LinkedIn"
    if legacy:
        head, tail = NO_TEXT.split("{site}")
        d = F.when(linkedin, F.lit(GUEST_TEXT)).when(d == "", F.concat(F.lit(head), "site", F.lit(tail))).otherwise(d)
    else:
        wall = F.lit(False)
        for m in WALL_MARKERS:
            wall = wall | F.col("url").contains(m)
        d = F.when(linkedin & (d == "") & wall, F.lit(WALL_TEXT)).otherwise(d)
    return out.withColumn("description", d)


def links_to_details(links: DataFrame, details: DataFrame) -> DataFrame:
    """Attach the description page to each listing link (left join on the
    canonical URL). Run it after title match and the seen check, so that no
    unneeded detail page is parsed."""
    host = F.regexp_extract("page_url", r"^(https?://[^/?#]+)", 1)
    job_url = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(host, F.col("href")))
    l = links.select("page_id", "pos", job_url.alias("job_url"))
    d = details.select(F.col("page_id").alias("detail_page_id"), canonical_url("url").alias("_k"))
    return (l.withColumn("_k", canonical_url("job_url"))
            .join(d, "_k", "left").select("page_id", "pos", "job_url", "detail_page_id"))


def run_extractor(pages: DataFrame, fn, schema) -> DataFrame:
    """Plug-in extractor: ``fn(page_id, url, html) -> list of row tuples``,
    run per page inside Arrow batches (new source = new rule or callable)."""
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    out_schema = T._parse_datatype_string(ddl) if isinstance(schema, str) else schema
    names = [f.name for f in out_schema.fields]

    def run(batches):
        yield from _chunked(batches, names, fn)

    return spread_few(pages.select("page_id", "url", "html"), "page_id").mapInPandas(run, out_schema)
