from urllib.parse import quote_plus

import pytest
from pyspark.sql import functions as F

from offerflow.functions import text as tx

TRIMS = ["\tTitle\t", " Title ", " Title ", "\u0085Title\u0085", "\u001cTitle\u001c",
         " \n\r Title x \x0b", "", "   "]


def one(spark, value, col_fn):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(col_fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("s", TRIMS)
def test_py_strip_matches_python(spark, s):
    assert one(spark, s, tx.py_strip) == s.strip()


def test_norm_key(spark):
    assert one(spark, " Data ENGINEER\t", tx.norm_key) == "data engineer"


@pytest.mark.parametrize(("s", "want"), [
    ("P y t h o n", "Python"), ("S Q L x", "SQLx"), ("é a b é", "é ab é"), ("a  b\t\tc", "abc"),
    ("Hello   world", "Hello world"), ("  x y  ", "xy")])
def test_clean_text_literal(spark, s, want):
    assert one(spark, s, tx.clean_text) == want


def test_clean_text_null_is_empty(spark):
    df = spark.createDataFrame([(None,)], "v string")
    assert df.select(tx.clean_text("v").alias("r")).first()["r"] == ""


@pytest.mark.parametrize("s", ["C++ ~*-_.", "staż & x/y", "Data Scientist", "ą ę/ł"])
def test_quote_plus(spark, s):
    assert one(spark, s, tx.quote_plus) == quote_plus(s)


def test_url_functions(spark):
    assert one(spark, "https://a.b/x?y=1#f", tx.canonical_url) == "https://a.b/x"
    assert one(spark, "https://a.b/x#f", tx.canonical_url) == "https://a.b/x#f"
    assert one(spark, "/job-offer/1", lambda c: tx.absolute_url(c, "https://justjoin.it")) == \
        "https://justjoin.it/job-offer/1"
    assert one(spark, "https://x.y/1", lambda c: tx.absolute_url(c, "https://justjoin.it")) == "https://x.y/1"
    assert one(spark, "https://x.y/1", lambda c: tx.absolute_url(c, "B", always=True)) == "Bhttps://x.y/1"


def test_clean_listing_title(spark):
    assert one(spark, " Data Engineer 12 000 PLN\nWarsaw", tx.clean_listing_title) == "Data Engineer 12 000"


def test_clip_code_points(spark):
    s = "😀" * 10
    assert one(spark, s, lambda c: tx.clip(c, 4)) == s[:4]
    assert one(spark, s, lambda c: tx.n_cut(c, 4)) == 6


def test_py_strip_looks_at_the_ends_only(spark):
    df = spark.createDataFrame([("\u2003 a \u00a0b\n\u0085",), (" \t\u3000",), ("",), (None,)], "s string").select(tx.py_strip("s").alias("s"))
    assert [r["s"] for r in df.collect()] == ["a \u00a0b", "", "", None]
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert set(tx.PY_SPACE_CHARS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
