"""Offer, profile and history views derived from the driver tables.

The derivation rules are those of FIXTURES.md section 2, so that Spark and
the DuckDB oracles see the same rows. Everything is a lazy DataFrame over the
parquet scans; Catalyst prunes the columns each query needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_url

# Fixed values of the fixture derivation (FIXTURES.md 2.1).
OFFER_BASE_URL = "https://jobs.example.org/offer/"
FIXTURE_EPOCH = "2024-01-01"
REF_TS = "2024-03-01 00:00:00"  # reference time of a run; never now() in tests


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All offers of all runs: batch 0 is the history, batches 1 to 3 are new runs."""
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    url_id = doc - F.when(doc % 10 == 9, F.lit(1)).otherwise(F.lit(0))
    raw_url = F.concat(F.lit(OFFER_BASE_URL), url_id.cast("string"), F.lit("?ref="), (doc % 3).cast("string"))
    posted_ts = F.date_add(F.lit(FIXTURE_EPOCH).cast("date"), (doc % 60).cast("int")).cast("timestamp_ntz")
    return d.select(
        doc.alias("seq"),
        (doc % 4).alias("batch_id"),
        (doc % 2).alias("source_rank"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        F.col("source").alias("company"),
        F.col("lang").alias("location"),
        raw_url.alias("raw_url"),
        canonical_url(raw_url).alias("job_url"),
        F.concat(F.lit("site"), (doc % 7).cast("string")).alias("site"),
        F.when(doc % 29 == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("description"),
        posted_ts.alias("posted_ts"),
        F.date_format(posted_ts, "yyyy-MM-dd").alias("posted_at"),
        (doc % 5 == 0).alias("is_remote"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored history: all of batch 0."""
    return offers(spark, sf_dir).where(F.col("batch_id") == 0)


def new_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers collected by the runs after the history (batches 1 to 3)."""
    return offers(spark, sf_dir).where(F.col("batch_id") > 0)


# The saved searches of FIXTURES.md 2.2, plus default scorer
# skills and place settings of our own.
FIXTURE_PROFILES = [
    # profile_id, job_titles, experience_levels, exclude_keywords, location, remote_only, max_days_old, skills
    (1, ["the", "la", "de"], ["tion", "ing", "er"], ["heed"], "Katowice", False, 14,
     ["the", "and", "de", "pour", "python", "sql"]),
    (2, ["ment", "tion"], [], [], "Warszawa", True, 30, ["ment", "tion", "data"]),
    (3, ["la"], [], ["er"], "", False, 7, ["la", "que", "en"]),
    (4, [], [], [], "Katowice", False, 60, ["the"]),
]

PROFILE_DDL = (
    "profile_id long, job_titles array<string>, experience_levels array<string>, "
    "exclude_keywords array<string>, location string, remote_only boolean, "
    "max_days_old int, skills array<string>"
)


def _lit_array(xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def fixture_profiles(spark: SparkSession) -> DataFrame:
    """The fixture searches as a literal (a local relation: no Python worker,
    no RDD)."""
    names = [f.split()[0] for f in PROFILE_DDL.split(", ")]
    rows = [F.struct(F.lit(pid).cast("long").alias(names[0]), _lit_array(t).alias(names[1]),
                     _lit_array(lv).alias(names[2]), _lit_array(ex).alias(names[3]), F.lit(loc).alias(names[4]),
                     F.lit(rem).alias(names[5]), F.lit(days).cast("int").alias(names[6]),
                     _lit_array(sk).alias(names[7]))
            for pid, t, lv, ex, loc, rem, days, sk in FIXTURE_PROFILES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def derived_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved searches derived from the `benchmark` table, so that the number of
    searches grows with the data: of the words of an item's whole text, those
    of ten letters or more are its titles, those of nine its excludes, those of
    five its skills (distinct, in order of first occurrence)."""
    b = table(spark, sf_dir, "benchmark")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"(\p{L}+)"), 1))
    return b.select(
        (F.col("item_id") + 100).alias("profile_id"),
        F.filter(words, lambda w: F.length(w) >= 10).alias("job_titles"),
        F.array().cast("array<string>").alias("experience_levels"),
        F.filter(words, lambda w: F.length(w) == 9).alias("exclude_keywords"),
        F.when(F.col("item_id") % 2 == 0, F.lit("Katowice")).otherwise(F.lit("Warszawa")).alias("location"),
        (F.col("item_id") % 3 == 0).alias("remote_only"),
        F.lit(14).alias("max_days_old"),
        F.filter(words, lambda w: F.length(w) == 5).alias("skills"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture searches plus the derived ones."""
    return fixture_profiles(spark).unionByName(derived_profiles(spark, sf_dir))


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CV text per saved search: the `benchmark` item with the same number
    (fixture searches use items 1 to 4, derived searches their own item)."""
    b = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("_item"), F.col("text").alias("cv_text"))
    p = profiles(spark, sf_dir).select(
        "profile_id",
        F.when(F.col("profile_id") >= 100, F.col("profile_id") - 100).otherwise(F.col("profile_id")).alias("_item"),
    )
    return p.join(b, "_item").select("profile_id", "cv_text")


def placed_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers at the places that the searches name, some of them broken
    (FIXTURES.md 2.6): every rule of the offer contract fails somewhere."""
    seq = F.col("seq")
    none = F.lit(None).cast("string")
    bad_url = (F.when(seq % 37 == 5, none).when(seq % 41 == 7, F.lit("ftp://jobs.example.org/x"))
               .when(seq % 43 == 9, F.concat("job_url", F.lit("/"), F.repeat(F.lit("x"), F.lit(2083)))))
    ok_url = ~((seq % 37 == 5) | (seq % 41 == 7) | (seq % 43 == 9))
    return offers(spark, sf_dir).withColumns({
        "title": F.when(seq % 47 != 11, F.col("title")),
        "company": F.when(seq % 53 != 13, F.col("company")),
        "location": F.when(seq % 59 == 17, none).when(seq % 3 == 0, F.lit("Katowice")).otherwise(F.lit("Warszawa")),
        "site": F.when(seq % 61 != 19, F.col("site")),
        "job_url": F.when(ok_url, F.col("job_url")).otherwise(bad_url)})


def levelled_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All searches; every third asks for juniors."""
    return profiles(spark, sf_dir).withColumn("experience_levels", F.when(
        F.col("profile_id") % 3 == 0, F.array(F.lit("Junior"), F.lit("Regular"))).otherwise(F.col("experience_levels")))
