import pytest
from pyspark.sql import functions as F

from offerflow.operators import report as rpt
from offerflow.operators import scoring as sc

VERDICTS = [
    ('{"match_score": 80, "missing_skills": ["a"], "advice": "x"}', 80, None),
    ('{"match_score": "80", "missing_skills": [], "advice": "x"}', 80, None),
    ('{"match_score": 80.0, "missing_skills": [], "advice": "x"}', 80, None),
    ('{"match_score": 80.5, "missing_skills": [], "advice": "x"}', None, "score_not_integer"),
    ('{"match_score": 180, "missing_skills": [], "advice": "x"}', 180, "score_out_of_range"),
    ('{"match_score": 50, "missing_skills": null, "advice": "x"}', 50, "missing_skills_null"),
    ("not json", None, "not_json"),
    ('{"missing_skills": [], "advice": "x"}', None, "missing_score"),
]


@pytest.mark.parametrize("raw,score,err", VERDICTS)
def test_parse_verdict(spark, raw, score, err):
    df = spark.createDataFrame([(raw,)], "raw string")
    r = sc.parse_verdict(df).first()
    assert r["match_score"] == score
    assert r["verdict_error"] == err


@pytest.mark.parametrize("score,band,legacy", [(44, "red", "red"), (45, "yellow", "yellow"), (69, "yellow", "yellow"),
                                               (70, "green", "green"), (None, None, "red")])
def test_score_band(spark, score, band, legacy):
    df = spark.createDataFrame([(score,)], "match_score int")
    r = df.select(sc.score_band_col().alias("b"), sc.score_band_col(legacy=True).alias("l")).first()
    assert (r["b"], r["l"]) == (band, legacy)


def test_default_scorer(spark):
    df = spark.createDataFrame([("Python and SQL work", ["python", "sql", "java"]), ("", ["x"]), (None, ["x"])],
                               "description string, skills array<string>")
    rows = sc.score_offers(df).collect()
    assert len(rows) == 1  # no description, no scoring
    r = rows[0]
    assert r["match_score"] == 67 and list(r["missing_skills"]) == ["java"] and r["error"] is None


def test_plugin_scorer_and_dead_letter(spark):
    import pandas as pd

    def scorer(pdf):
        ok = pdf["description"].str.contains("good")
        return pd.DataFrame({"match_score": [90 if o else None for o in ok],
                             "missing_skills": [[] for _ in ok], "advice": ["fine" if o else None for o in ok],
                             "error": [None if o else "bad reply" for o in ok]})

    df = spark.createDataFrame([(1, "good offer"), (2, "poor offer")], "seq long, description string")
    scored = sc.score_offers(df.withColumn("cv_text", F.lit("cv")), scorer=scorer)
    assert [r["seq"] for r in sc.scored_ok(scored).collect()] == [1]
    assert [(r["seq"], r["error"]) for r in sc.dead_letter(scored).collect()] == [(2, "bad reply")]

    def broken(pdf):
        raise RuntimeError("model down")

    failed = sc.dead_letter(sc.score_offers(df.withColumn("cv_text", F.lit("cv")), scorer=broken)).collect()
    assert len(failed) == 2 and all("model down" in r["error"] for r in failed)


def test_render_prompt_clips(spark):
    df = spark.createDataFrame([("x" * 9000, "my cv")], "description string, cv_text string")
    p = sc.render_prompt(df).first()["prompt"]
    assert "x" * 8000 in p and "x" * 8001 not in p and "my cv" in p
    own = sc.render_prompt(df, "CV {description} / {cv}!").first()["prompt"]
    assert own == "CV " + "x" * 8000 + " / my cv!"


def test_report_lines_escape_and_order(spark):
    res = spark.createDataFrame([(1, 2, "<b>T</b>", "A&B", "https://x/1", 80, "ok"),
                                 (1, 1, "T1", "C", "https://x/2", 30, "no")],
                                "profile_id long, seq long, title string, company string, url string, "
                                "match_score int, advice string")
    lines = rpt.report_lines(res).orderBy("profile_id", "ord").collect()
    assert lines[0]["html"].endswith("Scored offers: 2</h1>")
    assert "&lt;b&gt;T&lt;/b&gt;" in lines[2]["html"] and "A&amp;B" in lines[2]["html"]
    assert "#dc3545" in lines[1]["html"] and "#28a745" in lines[2]["html"]
    assert lines[-1]["html"] == rpt.REPORT_TAIL


def test_analysis_backlog(spark):
    offers = spark.createDataFrame([(1, "u1", "d"), (2, "u2", "d"), (3, "u3", None)],
                                   "seq long, job_url string, description string")
    results = spark.createDataFrame([("u1",), (None,)], "url string")
    assert [r["seq"] for r in sc.analysis_backlog(offers, results).collect()] == [2]


def test_one_raising_offer_fails_alone(spark):
    def scorer(pdf):
        if (pdf["seq"] == 3).any():
            raise ValueError("bad offer")
        return pdf.assign(match_score=50, missing_skills=[[]] * len(pdf), advice="ok")[["match_score", "missing_skills", "advice"]]

    df = spark.createDataFrame([(i, "text", "cv") for i in range(20)], "seq long, description string, cv_text string").coalesce(1)
    out = sc.score_offers(df, scorer)
    assert [r["seq"] for r in sc.dead_letter(out).collect()] == [3] and sc.scored_ok(out).count() == 19


def test_scorer_gets_small_slices_of_long_texts(spark):
    import pandas as pd

    bound = 3 * (2 << 20)

    def scorer(pdf):
        chars = int(pdf["description"].str.len().sum())
        return pd.DataFrame({"match_score": [50] * len(pdf), "missing_skills": [[]] * len(pdf), "advice": ["ok"] * len(pdf),
                             "error": ["too much at once" if chars > bound else None] * len(pdf)})

    df = spark.range(400).coalesce(1).select(F.col("id").alias("seq"), F.repeat(F.lit("x"), F.lit(50_000)).alias("description"),
                                             F.when(F.col("id") % 2 == 0, F.lit("cv")).alias("cv_text"))
    out = sc.score_offers(df, scorer)
    assert sc.dead_letter(out).count() == 0 and sc.scored_ok(out).count() == 400
    assert out.select(F.sum(F.length("prompt"))).first()[0] == sc.render_prompt(df).select(F.sum(F.length("prompt"))).first()[0]
