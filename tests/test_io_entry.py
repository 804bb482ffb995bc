import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from offerflow.sources import io


def _write(tmp, name, text):
    p = os.path.join(tmp, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_history_json_variants(spark):
    tmp = tempfile.mkdtemp(prefix="of-io-")
    recs = [{"title": "123", "company": "A", "location": "K", "job_url": "https://x/1", "site": "s"},
            {"title": "456", "company": "B", "location": "K", "job_url": "https://x/2", "site": "s",
             "posted_at": "None"}]
    arr = _write(tmp, "h.json", json.dumps(recs, ensure_ascii=False, indent=2))
    h = io.read_history(spark, arr)
    assert sorted(r["title"] for r in h.collect()) == ["123", "456"]  # all-digit titles stay text
    assert dict(h.dtypes)["title"] == "string"
    empty = _write(tmp, "e.json", "[]")
    assert io.read_history(spark, empty).count() == 0
    assert io.read_history(spark, os.path.join(tmp, "missing.json")).count() == 0
    trunc = _write(tmp, "t.json", json.dumps(recs)[:-20])
    good, bad = io.split_corrupt(io.read_json_records(spark, trunc, io.HISTORY_JSON))
    assert good.count() + bad.count() >= 1  # never raises, never erases silently


def test_snapshots_switch(spark):
    from offerflow.session import scratch_path

    base = scratch_path(spark, "snap-test")
    df1 = spark.range(3)
    io.write_snapshot(df1, base, 0)
    io.write_snapshot(spark.range(5), base, 1)
    assert io.latest_snapshot(spark, base) == 1
    assert io.read_snapshot(spark, base).count() == 5
    assert io.read_snapshot(spark, base, 0).count() == 3
    assert io.latest_snapshot(spark, base, below=1) == 0


def test_results_append_is_idempotent(spark):
    from offerflow.session import scratch_path

    path = scratch_path(spark, "results-test")
    r = spark.createDataFrame([(1, "a"), (2, "b")], "batch_id long, v string")
    io.append_results(r, path)
    io.append_results(r.where("batch_id = 2"), path)
    assert spark.read.parquet(path).count() == 2


def test_profiles_defaults(spark):
    tmp = tempfile.mkdtemp(prefix="of-prof-")
    _write(tmp, "p.json", json.dumps({"profile_id": 1, "job_titles": ["Data"]}) + "\n")
    p = io.read_profiles(spark, tmp).first()
    assert (p["location"], p["remote_only"], p["max_days_old"], list(p["exclude_keywords"])) == \
        ("Katowice", False, 14, [])


def test_entry_and_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() == df.select("seq").distinct().count() > 0
    assert set(df.columns) == {"seq", "job_url", "title", "company", "location", "match_score", "missing_skills",
                               "band"}
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_history_import_keeps_file_order(spark):
    tmp = tempfile.mkdtemp(prefix="of-imp-")
    rec = lambda n, title: {"title": title, "company": "A", "location": "K", "job_url": f"https://x/{n}", "site": "s"}
    # the later file is the larger one, and Spark reads larger files first
    _write(tmp, "a.json", json.dumps([rec(1, "Dev"), rec(2, "Ops")]))
    _write(tmp, "b.json", json.dumps([rec(3, "dev "), rec(4, "Dba"), rec(4, "Dba two"), rec(5, "x" * 5000)]))
    _write(tmp, "c.json", json.dumps([rec(6, "y")])[:-9])
    offers, bad = io.import_history(spark, tmp)
    assert bad.count() == 1
    new = offers.limit(0)
    from offerflow.operators.state import merge_history
    kept = {r["job_url"][-1]: r["title"] for r in merge_history(offers, new).collect()}
    assert {k: v[:7] for k, v in kept.items()} == {"2": "Ops", "3": "dev ", "4": "Dba two", "5": "xxxxxxx"}


def test_history_import_of_many_files(spark):
    """More files than source ranks have numbers; the last file's offer stays."""
    from offerflow.operators.state import SOURCE_RANGE, merge_history
    tmp, n = tempfile.mkdtemp(prefix="of-many-"), SOURCE_RANGE + 8
    for k in range(n):
        rows = [{"title": f"t{k}", "company": "A", "location": "K", "job_url": f"https://x/{u}", "site": "s"} for u in ("same", k)]
        _write(tmp, f"{k:04d}.json", json.dumps(rows))
    offers, _ = io.import_history(spark, tmp)
    order = [r["job_url"] for r in offers.orderBy("batch_id", "source_rank", "seq").collect()]
    assert order == [f"https://x/{u}" for k in range(n) for u in ("same", k)]
    kept = {r["job_url"]: r["title"] for r in merge_history(offers, offers.limit(0)).collect()}
    assert kept["https://x/0"] == "t0" and len(kept) == n  # title t<last> holds two addresses, the later one stays
    assert kept[f"https://x/{n - 1}"] == f"t{n - 1}" and "https://x/same" not in kept


def test_lines_of_a_split_file_keep_their_order(spark):
    tmp = tempfile.mkdtemp(prefix="of-split-")
    _write(tmp, "a.json", "".join(json.dumps({"title": f"t{i}", "company": "A", "location": "K", "job_url": f"https://x/{i}", "site": "s",
                                              "description": "x" * 400}) + "\n" for i in range(3000)))
    _write(tmp, "b.json", json.dumps({"title": "z", "company": "A", "location": "K", "job_url": "https://x/z", "site": "s"}) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        offers, _ = io.import_history(spark, tmp, array=False)
        assert [r["title"] for r in offers.orderBy("seq").collect()] == [f"t{i}" for i in range(3000)] + ["z"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stream_equals_fold(spark):
    import __spark_entry__ as E

    a = {tuple(r) for r in E.queries()["stream_ingest"](spark, SF_SMALL).collect()}
    b = {tuple(r) for r in E.queries()["incremental_run"](spark, SF_SMALL).collect()}
    assert a == b and len(a) > 0


def test_report_results_are_stored_with_each_text_about_once(spark, tmp_path):
    import hashlib
    import os

    from offerflow.plans import registry

    words = [f"keyword{i:04d}x" for i in range(60)]
    title = lambda i: f"{i} " + " ".join(words) + f" {hashlib.sha256(str(i).encode()).hexdigest() * 4}"
    docs = [(i, f"{title(i)}\ntext {i}", "en", "src", 1) for i in range(1, 29)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, w) for i, w in enumerate(words)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    lines = registry.q_report(spark, str(tmp_path))
    files = [f.removeprefix("file:") for f in lines.inputFiles()]
    assert files  # a reliable checkpoint, which holds every pair in full, gives none
    html = lines.where("ord between 0 and 1000").collect()
    assert len(html) >= 28 * 60  # every search of a word matches every offer
    assert sum(map(os.path.getsize, files)) < sum(len(r["html"]) for r in html) / 5
    # lines and counts as before
    by = {}
    for r in lines.collect():
        by.setdefault(r["profile_id"], []).append((r["ord"], r["html"]))
    for rows in by.values():
        rows.sort()
        assert rows[0][0] == -1 and f"Scored offers: {len(rows) - 2}<" in rows[0][1] and [o for o, _ in rows[1:-1]] == list(range(1, 29))


def test_result_history_holds_each_offer_about_once(spark, tmp_path):
    import hashlib
    import os

    from offerflow.plans import registry

    words = [f"keyword{i:04d}x" for i in range(60)]
    title = lambda i: f"{i} " + " ".join(words) + f" {hashlib.sha256(str(i).encode()).hexdigest() * 4}"
    docs = [(i, f"{title(i)}\ntext {i}", "en", "src", 1) for i in range(1, 29)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, w) for i, w in enumerate(words)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    urls = registry.q_src_results(spark, str(tmp_path))
    files = [f.removeprefix("file:") for f in urls.inputFiles()]
    records = [json.loads(r["value"]) for r in spark.read.text(files).collect()]
    # every pair is a record with its offer's fields in full
    pairs = registry.sc.to_result(registry._scored_pairs(spark, str(tmp_path))).collect()
    assert sorted((r["url"], r["title"], r["analysis"]["match_score"]) for r in records) == sorted(
        (p["url"], p["title"], p["analysis"]["match_score"]) for p in pairs)
    assert len(records) >= 28 * 60  # every search of a word matches every offer
    assert sum(map(os.path.getsize, files)) < sum(len(r["title"]) for r in records) / 5
    assert sorted(r["url"] for r in urls.collect()) == sorted({p["url"] for p in pairs})


def test_results_are_written_by_offer_in_files_of_bounded_length(spark, tmp_path, monkeypatch):
    import hashlib
    import os

    text = lambda i: "".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest() for k in range(30))
    # an offer's records stand 200 kB apart as they come, out of reach of gzip
    rows = [(p, i, None if i == 7 else f"Zażółć {i}", text(i), None if i == 9 else f"https://x/{i}", "K",
             (p, ["sql", "ü"] if p % 2 else [], None if p == 3 else "a\nb")) for p in range(20) for i in range(100)]
    df = spark.createDataFrame(rows, "profile_id long, seq long, company string, title string, url string, location string, "
                                     "analysis struct<match_score int, missing_skills array<string>, advice string>").coalesce(1)
    monkeypatch.setattr(io, "RESULTS_PER_FILE", 300)
    io.write_results(df, f"{tmp_path}/r", "seq")
    back = io.read_results(spark, f"{tmp_path}/r", array=False)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select(*back.columns).collect()))
    files = [f.removeprefix("file:") for f in back.inputFiles()]
    assert len(files) == 7 and all(spark.read.text(f).count() <= 300 for f in files)
    assert sum(map(os.path.getsize, files)) < 2 * sum(len(text(i)) for i in range(100))
    io.write_results(df.limit(0), f"{tmp_path}/r", "seq")  # replaced; no rows give an empty history
    assert io.read_results(spark, f"{tmp_path}/r", array=False).count() == 0
