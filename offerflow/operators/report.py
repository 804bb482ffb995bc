"""Counters and the report.

The report is kept as ordered lines ``(profile_id, ord, html)`` rather than
one string per search: the header count comes from a small aggregate and the
text sink writes the lines in order, so no group is ever collected into one
task however many results a search has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import band_color_col, score_band_col


def site_funnel(flags: DataFrame) -> DataFrame:
    """Per site (and a total row with site null): links processed, dropped by
    history, added. ``flags`` holds site, is_seen, is_match."""
    return (
        flags.rollup("site")
        .agg(F.count(F.lit(1)).alias("processed"),
             F.count_if(F.col("is_seen")).alias("filtered_history"),
             F.count_if(~F.col("is_seen") & F.col("is_match")).alias("added"))
    )


def session_report(flags: DataFrame) -> DataFrame:
    """One row: found, dropped by history, new from API / sites, total after
    dedupe. ``flags`` holds is_match, is_seen, source_rank, is_survivor."""
    new = F.col("is_match") & ~F.col("is_seen")
    return flags.agg(
        F.count_if(F.col("is_match")).alias("found"),
        F.count_if(F.col("is_match") & F.col("is_seen")).alias("dropped_history"),
        F.count_if(new & (F.col("source_rank") == 0)).alias("new_api"),
        F.count_if(new & (F.col("source_rank") == 1)).alias("new_sites"),
        F.count_if(new & F.col("is_survivor")).alias("total_after_dedupe"),
    )


def html_escape(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def report_block_col(escape: bool = True) -> Column:
    """One HTML block per result."""
    e = html_escape if escape else (lambda c: c)
    s = lambda c: e(F.coalesce(F.col(c).cast("string"), F.lit("")))
    color = band_color_col(score_band_col("match_score"))
    return F.concat(
        F.lit('<section><h3>'), s("title"), F.lit("</h3><p>"), s("company"), F.lit('</p><p style="color:'), color, F.lit('">'),
        F.coalesce(F.col("match_score").cast("string"), F.lit("")), F.lit(" of 100</p><p>"), s("advice"),
        F.lit('</p><p><a href="'), s("url"), F.lit('">To the offer</a></p></section>'),
    )


REPORT_HEAD = "<html><body><h1>Scored offers: {n}</h1>"
REPORT_TAIL = "</body></html>"


def report_lines(results: DataFrame, order: str = "seq", escape: bool = True) -> DataFrame:
    """(profile_id, ord, html): header (ord -1), one block per result in
    input order, footer (ord = 2^62). Results are read twice, for the lines and for
    their number: pass a stored table, not a plan that scores."""
    blocks = results.select("profile_id", F.col(order).cast("long").alias("ord"),
                            report_block_col(escape).alias("html"))
    counts = results.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"))
    head_a, head_b = REPORT_HEAD.split("{n}")
    edges = counts.select("profile_id", F.inline(F.array(
        F.struct(F.lit(-1).cast("long").alias("ord"),
                 F.concat(F.lit(head_a), F.col("n").cast("string"), F.lit(head_b)).alias("html")),
        F.struct(F.lit(1 << 62).cast("long").alias("ord"), F.lit(REPORT_TAIL).alias("html")))))
    return edges.unionByName(blocks)
