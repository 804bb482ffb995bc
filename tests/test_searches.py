import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL
from offerflow.operators import offers as ofr
from offerflow.operators import state as st
from offerflow.plans.searches import STATE_COLS, fold_searches, wanted_pairs

OFFER = ("seq long, batch_id long, source_rank long, title string, company string, location string, job_url string, "
         "site string, description string, is_remote boolean, posted_ts timestamp_ntz")
SEARCH = ("profile_id long, job_titles array<string>, experience_levels array<string>, exclude_keywords array<string>, "
          "location string, remote_only boolean, max_days_old int, skills array<string>")
REF = "2024-03-01 00:00:00"


def offer(seq, batch, title, url, place="Katowice", remote=False, company="A", desc="sql text", day=28):
    return (seq, batch, 0, title, company, place, f"https://x/{url}" if url else None, "s", desc, remote,
            dt.datetime(2024, 2, day) if day else None)


def offers_of(spark, rows):
    return spark.createDataFrame(rows, OFFER)


def searches_of(spark):
    return spark.createDataFrame([
        (1, ["data"], [], [], "Katowice", False, 14, ["sql"]),
        (2, ["data"], [], ["senior"], "Katowice", True, 60, ["sql", "scala"]),
        (3, ["data"], [], [], "", False, None, []),
        (4, None, None, None, None, None, 3, None)], SEARCH)


def test_place_and_age_of_each_search(spark):
    rows = [offer(0, 0, "Data a", "a"), offer(1, 0, "Data b", "b", "Warszawa"), offer(2, 0, "Data c", "c", remote=True),
            offer(3, 0, "Senior data d", "d", "Warszawa", True), offer(4, 0, "Data e", "e", day=1),
            offer(5, 0, "Data f", "f", day=None), offer(6, 0, None, "g"), offer(7, 0, "Cook", "h")]
    got = wanted_pairs(offers_of(spark, rows), searches_of(spark), REF)
    assert got.columns == STATE_COLS
    assert sorted((r["profile_id"], r["seq"]) for r in got.collect()) == [
        (1, 0), (1, 2), (2, 2), (3, 0), (3, 1), (3, 2), (3, 3), (3, 4), (3, 5),
        (4, 0), (4, 1), (4, 2), (4, 3), (4, 7)]  # no titles: every title, at any place, three days old


def test_each_search_has_its_own_history(spark):
    o = offers_of(spark, [
        offer(0, 0, "Data a", "a"),
        # seen by search 1 (and 3), new to search 2
        offer(1, 1, "Data a", "a", remote=True),
        # one more place of the same offer: a repeat within the batch, the last one stays
        offer(2, 1, "Data b", "b1"), offer(3, 1, "data B ", "b2"), offer(4, 1, "Data n", "n", desc=None),
        offer(5, 1, None, "broken"), offer(6, 2, "Data b", "b3"), offer(7, 2, "Data b", "b2")])
    searches = searches_of(spark).where("profile_id < 4")
    start = wanted_pairs(o.where("seq = 0"), searches, REF)
    cvs = spark.createDataFrame([(1, "cv"), (2, "cv"), (3, "cv")], "profile_id long, cv_text string")
    one, two = fold_searches([o.where("batch_id = 1"), o.where("batch_id = 2")], start, searches, cvs, REF)
    fresh = lambda run: sorted((r["profile_id"], r["seq"]) for r in run.fresh.collect())
    assert fresh(one) == [(1, 3), (1, 4), (2, 1), (3, 3), (3, 4)]
    assert sorted((r["profile_id"], r["seq"]) for r in one.results.collect()) == [(1, 3), (2, 1), (3, 3)]
    assert {r["profile_id"]: r["analysis"]["match_score"] for r in one.results.collect()} == {1: 100, 2: 50, 3: 0}
    assert [(r["seq"], r["reject_reason"]) for r in one.rejects.collect()] == [(5, "missing_title")]
    assert fresh(two) == [(1, 6), (3, 6)]  # b2 is seen, b3 is a new address
    kept = sorted((r["profile_id"], r["seq"]) for r in two.current.collect())
    assert kept == [(1, 0), (1, 4), (1, 6), (2, 1), (3, 0), (3, 4), (3, 6)]
    assert one.failed.count() == 0


def test_failures_are_dead_letters(spark):
    def scorer(pdf):
        if (pdf["title"] == "Data bad").any():
            raise ValueError("no verdict")
        return pdf.assign(match_score=7, missing_skills=[[]] * len(pdf), advice="ok")[["match_score", "missing_skills",
                                                                                      "advice"]]

    o = offers_of(spark, [offer(0, 1, "Data ok", "a"), offer(1, 1, "Data bad", "b")])
    cvs = spark.createDataFrame([(3, "cv")], "profile_id long, cv_text string")
    run, = fold_searches([o], wanted_pairs(o.limit(0), searches_of(spark), REF), searches_of(spark), cvs, REF, scorer)
    assert [r["seq"] for r in run.results.collect()] == [0]
    assert [(r["seq"], r["error"]) for r in run.failed.collect()] == [(1, "ValueError: no verdict")]


def test_empty_tables(spark):
    o, s = offers_of(spark, []), searches_of(spark)
    cvs = spark.createDataFrame([], "profile_id long, cv_text string")
    run, = fold_searches([o], wanted_pairs(o, s, REF), s, cvs, REF)
    assert run.fresh.count() == run.current.count() == run.results.count() == 0
    assert wanted_pairs(offers_of(spark, [offer(0, 0, "Data", "a")]), s.limit(0), REF).count() == 0


def test_scoped_merge_equals_full_merge(spark):
    h = spark.range(400).select(
        (F.col("id") % 3).alias("profile_id"), F.col("id").alias("seq"), F.lit(0).cast("long").alias("batch_id"),
        F.lit(0).cast("long").alias("source_rank"), F.concat(F.lit("t"), F.col("id") % 17).alias("title"),
        F.when(F.col("id") % 5 > 0, F.lit("c")).alias("company"), F.lit("l").alias("location"),
        F.when(F.col("id") % 7 > 0, (F.col("id") % 29).cast("string")).alias("job_url"))
    merged = st.merge_history(h.where("seq < 250"), h.limit(0), scope=["profile_id"])
    new = h.where("seq >= 250")
    full = st.merge_history(merged, new, False, ["profile_id"])
    part = st.merge_history(merged, new, True, ["profile_id"])
    rows = lambda df: sorted(r["seq"] for r in df.collect())
    assert rows(full) == rows(part) and len(rows(full)) > 3


def test_description_status_reads_whole_texts(spark):
    texts = {"Brak opisu dla Pracuj.pl.": "missing", " \t": "missing", None: "missing",
             "Błąd: LinkedIn wyświetlił ekran logowania. Nie można pobrać opisu.": "signin_wall",
             "Guest Mode - opis niedostępny bez logowania": "guest_mode",
             "Opis dostępny bezpośrednio na LinkedIn (Guest Mode).": "guest_mode", "Błąd: timeout": "error",
             "Error handling and how to sign in to systems": "ok", "Brak opisu dla zespołu.\nPiszemy kod.": "ok",
             "Błądzimy rzadko": "ok"}
    df = spark.createDataFrame([(t,) for t in texts], "description string")
    rows = ofr.description_status(df.withColumn("raw", F.col("description"))).collect()
    assert {r["raw"]: r["status"] for r in rows} == texts
    assert all((r["description"] is not None) == (r["status"] == "ok") for r in rows)


def test_posted_ts_of_imported_offers(spark):
    df = spark.createDataFrame([("2024-02-28",), ("None",), ("",), (None,), ("2024-02-28 10:00:00",)], "posted_at string")
    got = [r["posted_ts"] for r in ofr.with_posted_ts(df).collect()]
    assert got == [dt.datetime(2024, 2, 28), None, None, None, dt.datetime(2024, 2, 28, 10)]
    assert ofr.fresh_only(ofr.with_posted_ts(df), REF, 14).count() == 2


def test_registered_inputs_fire_every_branch(spark):
    import __spark_entry__ as E

    q = E.queries()
    reasons = {r["reject_reason"] for r in q["validate_offers"](spark, SF_SMALL).collect()}
    assert reasons == {None, "missing_title", "missing_company", "missing_location", "missing_job_url", "missing_site",
                       "bad_url", "url_too_long"}
    assert {r["status"] for r in q["description_status"](spark, SF_SMALL).collect()} == {
        "ok", "missing", "signin_wall", "guest_mode", "error"}
    assert {r["is_junior"] for r in q["seniority_flag"](spark, SF_SMALL).collect()} == {True, False}
    assert q["links_to_details"](spark, SF_SMALL).where("detail_page_id is not null").count() > 20
    assert q["join_sections"](spark, SF_SMALL).where("description <> ''").count() > 20
    sites = {r["site"] for r in q["page_links"](spark, SF_SMALL).select("site").distinct().collect()}
    assert sites == {None, "JustJoinIT", "NoFluffJobs", "BulldogJob", "TheProtocol"}
    assert q["site_cards"](spark, SF_SMALL).select("site").distinct().count() == 6


def attempt_log(spark, name, results=None):
    from offerflow.session import scratch_path
    from offerflow.sources.attempt_log import AttemptLog

    log = AttemptLog(spark, scratch_path(spark, name))
    log.create(results)
    return log


def counting(path, fails):
    """A scorer that notes each call in a file and fails where ``fails(title, attempts)``."""
    def scorer(pdf):
        with open(path, "a") as f:
            f.writelines(f"{r.profile_id} {r.title}\n" for r in pdf.itertuples())
        bad = [fails(r.title, r.attempts) for r in pdf.itertuples()]
        return pdf.assign(match_score=7, missing_skills=[[]] * len(pdf), advice="ok", error=["no" if b else None for b in bad])[
            ["match_score", "missing_skills", "advice", "error"]]
    return scorer


def test_failed_and_late_offers_are_scored_later_and_scored_ones_never_again(spark, tmp_path):
    calls = tmp_path / "calls"
    batches = [
        [offer(0, 1, "Data fails once", "a", desc="text a"), offer(1, 1, "Data good", "b", desc="text b"),
         offer(2, 1, "Data late", "c", desc=None), offer(3, 1, "Data never", "d", desc="text d"), offer(4, 1, "Data empty", "e", desc="")],
        # c again, now with a text: no longer new, yet it was never scored; b again: scored for good
        [offer(10, 2, "Data late", "c", desc="text c"), offer(11, 2, "Data good", "b", desc="other text")],
        [offer(20, 3, "Cook", "z", desc="nothing")]]
    s = searches_of(spark).where("profile_id = 3")
    cvs = spark.createDataFrame([(3, "cv")], "profile_id long, cv_text string")
    log = attempt_log(spark, "attempts-test")
    frames = [offers_of(spark, b) for b in batches]
    runs = fold_searches(frames, wanted_pairs(frames[0].limit(0), s, REF), s, cvs, REF,
                         counting(str(calls), lambda title, tried: title == "Data never" or title == "Data fails once" and tried == 0), log)
    titles = lambda df: sorted(r["title"] for r in df.collect())
    assert [titles(r.results) for r in runs] == [["Data good"], ["Data fails once", "Data late"], []]
    assert [titles(r.failed) for r in runs] == [["Data fails once", "Data never"], ["Data never"], ["Data never"]]
    table = {r["title"]: (r["status"], r["attempts"], r["last_error"], r["description"]) for r in log.read().collect()}
    assert table == {"Data fails once": ("scored", 2, None, None), "Data good": ("scored", 1, None, None),
                     "Data late": ("scored", 1, None, None), "Data never": ("failed", 3, "no", "text d"),
                     "Data empty": ("waiting", 0, "no_description", None)}
    # results and failures are read above: the scorer still ran once per attempt
    assert sorted(calls.read_text().splitlines()) == sorted(
        ["3 Data good", "3 Data late"] + ["3 Data fails once"] * 2 + ["3 Data never"] * 3)


def test_attempts_end_and_stored_results_are_skipped(spark, tmp_path):
    calls = tmp_path / "calls"
    o = offers_of(spark, [offer(0, 1, "Data a", "a"), offer(1, 1, "Data b", "b")])
    s = searches_of(spark).where("profile_id = 3")
    results = spark.createDataFrame([(3, "https://x/a"), (3, None), (2, "https://x/b"), (3, "https://x/a")], "profile_id long, url string")
    log = attempt_log(spark, "attempts-seeded", results)
    cvs = spark.createDataFrame([(3, "cv")], "profile_id long, cv_text string")
    empty = o.limit(0)
    fold_searches([o, empty, empty, empty], wanted_pairs(empty, s, REF), s, cvs, REF, counting(str(calls), lambda *_: True), log, max_attempts=2)
    assert calls.read_text().splitlines() == ["3 Data b"] * 2
    assert sorted((r["profile_id"], r["job_url"], r["status"], r["attempts"]) for r in log.read().collect()) == [
        (2, "https://x/b", "scored", 1), (3, "https://x/a", "scored", 1), (3, "https://x/b", "failed", 2)]
    # a pair without a CV waits for one
    log = attempt_log(spark, "attempts-cv")
    run, = fold_searches([o], wanted_pairs(empty, s, REF), s, cvs.limit(0), REF, None, log)
    assert run.results.count() == 0 and {r["last_error"] for r in log.read().collect()} == {"no_cv"}


def test_registered_retries_fire_every_outcome(spark):
    import __spark_entry__ as E

    rows = E.queries()["retry_ledger"](spark, "/root/testdata/sf0.01").collect()
    pairs = [r for r in rows if r["outcome"] == "pair"]
    assert {r["status"] for r in pairs} == {"scored", "failed", "waiting"} and {r["attempts"] for r in pairs} >= {0, 1, 2, 3}
    scored = [(r["profile_id"], r["job_url"]) for r in rows if r["outcome"] == "result"]
    assert len(scored) == len(set(scored)) == sum(r["status"] == "scored" for r in pairs)
    assert {r["run"] for r in rows} == {0, 1, 2, 3}


def test_texts_that_wait_are_stored_once_and_no_pair_carries_them(spark, tmp_path):
    text = "text of some length " * 200
    o = offers_of(spark, [offer(i, 1, "Data never", f"u{i}", company=f"c{i}", desc=text) for i in range(40)])
    s = searches_of(spark).where("profile_id in (1, 3)")
    cvs = spark.createDataFrame([(1, "cv"), (3, "cv")], "profile_id long, cv_text string")
    log = attempt_log(spark, "attempts-texts")
    runs = fold_searches([o, o.limit(0)], wanted_pairs(o.limit(0), s, REF), s, cvs, REF, counting(str(tmp_path / "calls"), lambda *_: True), log)
    assert "description" not in log.pairs().columns and log.texts().count() == 1
    assert {(r["status"], r["attempts"], r["description"]) for r in log.read().collect()} == {("failed", 2, text)}
    assert log.read().count() == 80 and {r["description"] for r in runs[1].failed.collect()} == {text}
