"""The history log, the seen ledger and the stream on them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from offerflow.operators import state as st
from offerflow.session import scratch_path
from offerflow.sources.history_log import HistoryLog
from offerflow.sources.log_table import TakenError
from offerflow.sources.seen_ledger import SeenLedger
from offerflow.streaming import ingest
from test_state import SCHEMA, _rows


def local(path):
    return path.removeprefix("file:")


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(local(path)) for f in names)


def batches_of(n, rows, seed):
    """Batches of rows that repeat addresses and keys of earlier ones."""
    rnd = random.Random(seed)
    out, seq = [], 0
    for b in range(n):
        batch = []
        for _ in range(rows):
            key = rnd.randrange(n * rows // 3)
            batch.append((seq, b + 1, rnd.randrange(2), f"Title {key % 40} " if key % 3 else f"t{seq}", rnd.choice(["Acme", "acme ", None]),
                          rnd.choice(["K", None]), rnd.choice([f"https://x.org/{key}"] * 9 + [None]), "s", "d", None))
            seq += 1
        out.append(batch)
    return out


def log_of(spark, name, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    log = HistoryLog(spark, scratch_path(spark, name), df.schema)
    log.create(df, **kw)
    return log


def rows_of(df):
    return sorted(tuple(r) for r in df.select("seq", "batch_id", "job_url", "title").collect())


def test_log_of_twenty_batches_equals_the_full_merge(spark):
    history = [(10_000 + i, 0, *r[2:]) for i, r in enumerate(_rows(60, 3))]
    log = log_of(spark, "log-fold", history)
    full = spark.createDataFrame(history, SCHEMA)
    compacted = 0
    for batch in batches_of(20, 12, 5):
        new = spark.createDataFrame(batch, SCHEMA)
        full = st.merge_history(full, new).checkpoint()
        log.append(new)
        compacted += log.compact(deltas=4) is not None
        assert rows_of(log.read()) == rows_of(full)
    assert compacted >= 3
    before = rows_of(log.read())
    assert log.prune(1) and rows_of(log.read()) == before
    folders = os.listdir(local(f"{log.log.base}/rows"))
    assert len(folders) == len(log.log.manifest().rows("rows"))


def test_a_run_writes_what_its_batch_changes(spark):
    wide = [(i, 0, 0, f"title {i}", "c", "l", f"https://x.org/{i}", "s", f"{i} " * 200, None) for i in range(6000)]
    log = log_of(spark, "log-bytes", wide, merged=True)
    base = size_of(f"{log.log.base}/rows/v=0")
    new = [(7000 + i, 1, 0, f"title {i}", "c", "l", f"https://x.org/{i}", "s", "d", None) for i in range(10)]
    m = log.append(spark.createDataFrame(new, SCHEMA))
    assert m.rows("rows") == {0: 6000, 1: 10} and m.rows("gone") == {1: 10}
    assert (size_of(f"{log.log.base}/rows/v=1") + size_of(f"{log.log.base}/gone/v=1")) * 20 < base
    assert log.compact() is None and log.read().count() == 6000


def test_a_reader_keeps_its_version_and_a_second_writer_fails(spark):
    log = log_of(spark, "log-reader", [(i, 0, 0, f"t{i}", "c", "l", f"u{i}", "s", "d", None) for i in range(4)], merged=True)
    held = log.read()  # opened before the commits below
    for k in range(3):
        log.append(spark.createDataFrame([(10 + k, 1 + k, 0, "t0", "c", "l", f"v{k}", "s", "d", None)], SCHEMA))
    assert log.compact(deltas=1) is not None
    assert {r["seq"] for r in held.collect()} == {0, 1, 2, 3}
    assert {r["seq"] for r in log.read().collect()} == {12, 1, 2, 3}
    assert {r["seq"] for r in log.read(1).collect()} == {10, 1, 2, 3}
    m = log.log.manifest(1)
    with pytest.raises(TakenError):
        log.log.publish(m)
    # what a failed commit left behind is in no version, and its retry replaces it
    n = log.log.manifest().version + 1
    log.log.put("rows", n, log.read())
    assert log.read().count() == 4
    log.append(spark.createDataFrame([(20, 9, 0, "t9", "c", "l", "u9", "s", "d", None)], SCHEMA))
    assert log.read().count() == 5


def test_rows_without_a_number_and_empty_batches(spark):
    rows = [(None, None, None, "a", "c", "l", "u1", "s", None, None), (None, None, None, "b", "c", "l", "u2", "s", None, None)]
    log = log_of(spark, "log-null", rows, merged=True)
    log.append(spark.createDataFrame([], SCHEMA))
    assert log.read().count() == 2
    log.append(spark.createDataFrame([(None, 1, 0, "a", "c", "l", "u3", "s", None, None)], SCHEMA))
    assert {r["job_url"] for r in log.read().collect()} == {"u2", "u3"}


# ---- the seen ledger

def urls_of(spark, names):
    return spark.createDataFrame([(n, "x") for n in names], "job_url string, title string")


def test_ledger_finds_what_it_holds_and_nothing_else(spark):
    ledger = SeenLedger(spark, scratch_path(spark, "ledger"), buckets=8)
    assert ledger.find(urls_of(spark, ["a"])).urls.count() == 0
    held, rnd = set(), random.Random(1)
    for k in range(12):
        names = [f"https://x.org/{rnd.randrange(900)}" for _ in range(60)] + [None]
        ledger.add(urls_of(spark, names))
        held |= set(names) - {None}
        assert sorted(r[0] for r in ledger.read().collect()) == sorted(held)  # each once
    assert len(ledger.log.manifest().rows("urls")) <= 9  # compacted on the way
    offers = urls_of(spark, [f"https://x.org/{i}" for i in range(0, 1800, 2)] + [None, "", "https://x.org/4"])
    known = [r[0] for r in ledger.known_offers(offers).select("job_url").collect()]
    new = [r[0] for r in ledger.new_offers(offers).select("job_url").collect()]
    seen = spark.createDataFrame([(u,) for u in held], "job_url string")
    assert sorted(known) == sorted(r[0] for r in st.known_offers(offers, seen).select("job_url").collect())
    assert sorted(new, key=str) == sorted((r[0] for r in st.new_offers(offers, seen).select("job_url").collect()), key=str)


def test_ledger_reads_only_buckets_whose_filter_answers_and_shuffles_none(spark, monkeypatch):
    ledger = SeenLedger(spark, scratch_path(spark, "ledger-plan"), buckets=16)
    ledger.add(spark.range(40_000).select(F.concat(F.lit("https://x.org/"), "id").alias("job_url")))
    few = ledger.find(urls_of(spark, [f"https://x.org/{i}" for i in (5, 77)] + [f"https://y.org/{i}" for i in range(200)]))
    assert few.files == 16 and few.files_read <= 5 and {r[0] for r in few.urls.collect()} == {"https://x.org/5", "https://x.org/77"}
    strangers = ledger.find(spark.range(5000).select(F.concat(F.lit("https://z.org/"), "id").alias("job_url")))
    assert strangers.candidates < 0.03 * 5000 and strangers.urls.count() == 0
    from offerflow.sources import seen_ledger
    for bound in (100_000, 900):  # in one go, and bucket by bucket
        monkeypatch.setattr(seen_ledger, "CANDIDATES", bound)
        many = ledger.find(spark.range(0, 80_000, 10).select(F.concat(F.lit("https://x.org/"), "id").alias("job_url")))
        assert many.urls.count() == 4000
        plan = many.urls._jdf.queryExecution().executedPlan().toString()
        # the ledger's files are the streamed side of broadcast joins: no exchange between scan and join
        assert plan.count("BroadcastHashJoin") >= (1 if bound > 900 else 4) and "SortMergeJoin" not in plan


# ---- the stream on the log

def test_stream_keeps_rows_without_a_batch_id_and_resumes_inside_an_epoch(spark, tmp_path, monkeypatch):
    def row(seq, batch, title, url):
        return (seq, batch, 0, title, "c", "l", f"https://x.example/{url}", "s", None, None)

    rows = [row(1, None, "one", "u1"), row(2, 3, "two", "u2"), row(3, 5, "one", "u3"), row(4, 7, "four", "u1")]
    df = spark.createDataFrame(rows, SCHEMA)
    for forgetful, want in ((True, [2, 3, 4]), (False, [2, 3])):
        state = str(tmp_path / f"log-{forgetful}")
        ingest.seed_state(spark.createDataFrame([], SCHEMA), state)
        real, runs = ingest.run_on_log, []

        def failing(log, *args, real=real, runs=runs, **info):
            runs.append(info["upto"])
            if len(runs) == 2:
                raise RuntimeError("executor lost")
            return real(log, *args, **info)

        monkeypatch.setattr(ingest, "run_on_log", failing)
        with pytest.raises(RuntimeError):
            ingest._run_epoch(df, 0, state, [], [], forgetful)
        for _ in range(2):  # the replay, and one more
            ingest._run_epoch(df, 0, state, [], [], forgetful)
        monkeypatch.setattr(ingest, "run_on_log", real)
        assert runs == ["none", "3", "3", "5", "7"]
        assert sorted(r["seq"] for r in ingest.read_state(spark, state).collect()) == want


def test_stream_prunes_old_versions(spark, tmp_path):
    state = str(tmp_path / "log-prune")
    for epoch, batch in enumerate(batches_of(9, 6, 8)):
        ingest._run_epoch(spark.createDataFrame(batch, SCHEMA), epoch, state, [], [], True)
    assert len(os.listdir(f"{state}/manifest")) <= 2 * ingest.KEPT_VERSIONS
    assert len([n for n in os.listdir(f"{state}/rows") if n.startswith("v=")]) <= 14
