"""Sites as rows: selectors and settings of any number of sites in one table.

A rule row is (site, role, rank, tag, attribute, test, value). Roles of selectors:
``container``, ``link``, ``title``, ``company``, ``place`` (listing pages) and
``description``, ``longest``, ``section``, ``fallback`` (detail pages). Lower ranks go
first; of equal ranks, selectors of detail pages are alternatives, those of listing
pages follow one another by tag, attribute and value. ``tag`` is a name or ``*``; ``test`` is
``eq`` (of a class: one of its words), ``prefix`` or ``any`` on the attribute, or
``none`` without one. Role ``setting`` names a setting in ``attribute`` and its ``value``;
role ``stop_phrase`` a text that no longest block may hold.

A page meets its own site's rows by a join on the site; a task compiles a site's rows
once and parses each page once. A site whose rows are added is read from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canonical_url, clean_listing_title
from ..plans.partitioning import spread_few
from .pages import CARD_SCHEMA, DESCRIPTION_RULES, LONGEST_RULES, SECTION_RULES, SITE_CARD_RULES, _cards_of, _chunked, _PageParser, first_by_rank

RULE = T.StructType([T.StructField("site", T.StringType()), T.StructField("role", T.StringType()), T.StructField("rank", T.IntegerType()),
                     *[T.StructField(c, T.StringType()) for c in ("tag", "attribute", "test", "value")]])
PARTS = ("container", "link", "title", "company", "place")
FLAGS = ("title_self", "title_required", "raw_text", "cut_query", "clean_title", "prefix_always")


def builtin_rows() -> list[tuple]:
    """The rows of the six sites that are built in."""
    rows: list[tuple] = []

    def selector(site, role, rank, sel):
        tag, attribute, value, op = sel
        rows.append((site, role, rank, tag, attribute, op if attribute else "none", value))

    for site, r in SITE_CARD_RULES.items():
        for part in PARTS:
            for rank, sel in enumerate(r.get(part) or []):
                selector(site, part, rank, sel)
        for name, value in r.items():
            if name not in (*PARTS, "site"):
                rows.append((site, "setting", 0, None, name, None, str(value).lower() if isinstance(value, bool) else value))
    for site, ranks in DESCRIPTION_RULES.items():
        for rank, sels in enumerate(ranks):
            for sel in sels if isinstance(sels, list) else [sels]:
                selector(site, "description", rank, sel)
    for site, r in LONGEST_RULES.items():
        for tag in r["tags"]:
            rows.append((site, "longest", 0, tag, None, "none", None))
        rows += [(site, "setting", 0, None, f"longest_{k}", None, str(r[k])) for k in ("lo", "hi")]
        rows += [(site, "stop_phrase", 0, None, None, None, p) for p in r["stop_phrases"]]
    for site, r in SECTION_RULES.items():
        rows.append((site, "section", 0, "div", "data-test", "prefix", r["prefix"]))
        for rank, sel in enumerate(r["fallback"]):
            selector(site, "fallback", rank, sel)
    return rows


def builtin_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(builtin_rows(), RULE)


def compile_rows(site: str, rows) -> dict:
    """One site's rows as the parser takes them."""
    out: dict = {"site": site, "roles": {}, "stop_phrases": []}
    for r in sorted(rows, key=lambda r: (r["role"], r["rank"], r["tag"] or "", r["attribute"] or "", r["value"] or "")):
        if r["role"] == "setting":
            out[r["attribute"]] = r["value"] == "true" if r["attribute"] in FLAGS else r["value"]
        elif r["role"] == "stop_phrase":
            out["stop_phrases"].append(r["value"])
        else:
            sel = (r["tag"], r["attribute"], r["value"], r["test"])
            out["roles"].setdefault(r["role"], {}).setdefault(r["rank"], []).append(sel)
    for role, ranks in out["roles"].items():
        out["roles"][role] = [ranks[k] for k in sorted(ranks)]
        if role in PARTS:
            out[role] = [s for sels in out["roles"][role] for s in sels]
    return out


def _by_site(pages: DataFrame, rules: DataFrame, *columns: str) -> DataFrame:
    """The pages' columns, spread, with the rows of their site (null where there are none).

    The rules (a row per site) go to every task: a join on the site would send all
    pages of a site to one, and rows joined before the spreading would be shuffled with each page."""
    rows = rules.groupBy(F.col("site").alias("_site")).agg(F.collect_list(F.struct(*[c for c in RULE.names if c != "site"])).alias("_rules"))
    return spread_few(pages.select(*columns), "page_id").join(F.broadcast(rows), F.col("site") == F.col("_site"), "left").drop("_site")


class _Compiled(dict):
    """Compiled rules by site, made on first use in a task."""

    def of(self, site, rows) -> dict | None:
        if rows is None:
            return None
        if site not in self:
            self[site] = compile_rows(site, rows)
        return self[site]


def cards_by_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Offer cards (CARD_SCHEMA) of listing pages (page_id, site, html)."""
    def run(batches):
        known = _Compiled()

        def cards(page_id, site, html, rows):
            r = known.of(site, rows)
            return _cards_of(page_id, html, r) if r and r.get("container") else ()

        yield from _chunked(batches, CARD_SCHEMA.names, cards)

    return _by_site(pages, rules, "page_id", "site", "html").mapInPandas(run, CARD_SCHEMA)


def offers_of_cards(cards: DataFrame, rules: DataFrame, search_place: str | None = None) -> DataFrame:
    """Marker filter, link form and title clean-up by the settings of each card's site."""
    names = ("marker", "stop", "prefix", "cut_query", "clean_title", "prefix_always")
    settings = rules.where("role = 'setting'").groupBy(F.col("site").alias("_site")).agg(
        *[F.max(F.when(F.col("attribute") == c, F.col("value"))).alias(f"_{c}") for c in names])
    c = cards.join(F.broadcast(settings), F.col("site") == F.col("_site"), "left")
    on = lambda flag: F.coalesce(F.col(f"_{flag}") == "true", F.lit(False))
    keep = (F.coalesce(F.contains("href", F.col("_marker")), F.lit(True)) & ~F.coalesce(F.contains("href", F.col("_stop")), F.lit(False)))
    link = F.when(on("cut_query"), canonical_url("href")).otherwise(F.col("href"))
    prefixed = F.when(on("prefix_always") | ~link.startswith("http"), F.concat("_prefix", link)).otherwise(link)
    return c.where(keep).select("page_id", "site", "pos", F.when(F.col("_prefix").isNull(), link).otherwise(prefixed).alias("job_url"),
                                F.when(on("clean_title"), clean_listing_title("title")).otherwise(F.col("title")).alias("title"), "company",
                                F.coalesce("place", F.lit(search_place).cast("string")).alias("location"))


def _text_of(html: str, r: dict) -> str:
    p = _PageParser(frozenset()).read(html)
    nodes = sorted(p.done, key=lambda n: n.pos)
    roles = r["roles"]
    if "longest" in roles:
        tags = {s[0] for sels in roles["longest"] for s in sels}
        lo, hi, best = int(r.get("longest_lo", 0)), int(r.get("longest_hi", 1 << 31)), ""
        for n in nodes:
            if n.tag in tags or "*" in tags:
                text = p.text(n)
                if max(lo, len(best)) < len(text) < hi and not any(s in text for s in r["stop_phrases"]):
                    best = text
        return best
    if "section" in roles:
        parts = [p.text(n) for n in nodes if first_by_rank(p, [n], roles["section"], found=True)]
        return "\n\n".join(parts) if parts else first_by_rank(p, nodes, roles.get("fallback", []))
    return first_by_rank(p, nodes, roles.get("description", []))


def descriptions_by_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, site, description) of detail pages; "" where no rule hits or the site has none."""
    def run(batches):
        known = _Compiled()

        def texts(page_id, site, html, rows):
            r = known.of(site, rows)
            return [(page_id, site, _text_of(html, r) if r and html is not None else "")]

        yield from _chunked(batches, ["page_id", "site", "description"], texts)

    return _by_site(pages, rules, "page_id", "site", "html").mapInPandas(
        run, "page_id long, site string, description string")
