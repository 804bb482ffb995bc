"""Quality chain, licence index, toxicity and language-model scores."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from offerflow.llm import license_scan, lm_score, quality_rules, toxicity
from offerflow.llm.common import read
from tests.llm.conftest import by_id

SF = "/root/testdata/sf0.01"
EDGE = [None, "", "  \n\t", "one two", "a b c d e " * 9, "x" * 4000, "The same line of words here.\n" * 3, "#$ | <b> word"]


def plain_base(text):
    """The contract of op1, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_base_counts_match_the_contract():
    random.seed(4)
    texts = EDGE + ["".join(random.choice("ab \n\té|\x0b") for _ in range(random.randint(0, 80))) for _ in range(500)]
    for t in texts:
        assert quality_rules.base_counts(t) == plain_base(t), repr(t)


def test_viterbi_equals_all_sequences():
    rng = np.random.default_rng(2)
    for _ in range(100):
        chain = quality_rules.Chain(rng.normal(size=quality_rules.FEATURES), rng.normal(size=2), rng.normal(size=(2, 2)))
        masks = [int(m) | 1 for m in rng.integers(0, 1 << quality_rules.FEATURES, 6)]

        def value(labels, chain=chain, masks=masks):
            return (chain.start[labels[0]] + sum(chain.emission(m) for m, y in zip(masks, labels, strict=True) if y)
                    + sum(chain.moves[a, b] for a, b in itertools.pairwise(labels)))

        got = chain.decode(masks)
        assert math.isclose(value(got), max(map(value, itertools.product((0, 1), repeat=6))))


def test_quality_verdicts_on_held_labels(spark):
    rows = duckdb.sql(f"select d.doc_id, text, quality from '{SF}/documents.parquet' d join '{SF}/labels.parquet' l "
                      "using (doc_id) where quality is not null order by doc_id").fetchall()
    chain = quality_rules.fit([(q, quality_rules.read_lines(t)[0]) for i, t, q in rows if i % 2])
    verdicts = [(quality_rules.judge(chain, t), q) for i, t, q in rows if not i % 2]
    good = [v[6] for v, q in verdicts if q and not v[5]]
    bad = [v[6] for v, q in verdicts if not q]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15


def test_quality_edges(spark, table):
    docs = table(EDGE)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = by_id(quality_rules.judge_documents(docs, none))
    assert len(out) == len(EDGE) and not any(out[i].kept for i in (0, 1, 2, 3, 4, 5))
    kept = quality_rules.keep_good(docs, none)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.kept}
    assert quality_rules.judge_documents(docs.limit(0), none).collect() == []


def plain_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for phrase, label in license_scan.BASE.items() for p in [phrase.split()]
             for i in range(len(words)) if words[i:i + len(p)] == p]
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))


def test_quality_fit_leaves_out_documents_of_too_many_lines(spark, table):
    texts = ["Plain words that make up a sentence of a text.\n" * 3, "| # | $$ |\n" * 3] * 4
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(9)], "doc_id long, quality int")
    long = "| # | $$ |\n" * 50
    want = quality_rules.train(table(texts), labels)
    got = quality_rules.train(table([*texts, long]), labels, sample_lines=49)
    other = quality_rules.train(table([*texts, long]), labels, sample_lines=50)
    assert np.array_equal(got.weights, want.weights) and np.array_equal(got.moves, want.moves)
    assert not np.array_equal(other.weights, want.weights)
    assert by_id(quality_rules.judge_documents(table([*texts, long]), labels))[8].n_lines == 50


def test_license_base_places_match_the_contract(spark, table):
    random.seed(5)
    vocabulary = "gnu general public license apache cc by mit the é Version 2.0, and MIT/License CC-BY".split()
    texts = EDGE + [" ".join(random.choice(vocabulary) for _ in range(random.randint(0, 40))) for _ in range(200)]
    out = by_id(license_scan.scan_licenses(table(texts)))
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licenses(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


HEADER = ("This file is part of it. It is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by\n"
          "the Free Software Foundation, either version {} of the License, or (at your option) any later version.")


@pytest.mark.parametrize(("text", "labels"), [
    (HEADER.format("General Public License", "3"), "gpl,gpl-3.0"), (HEADER.format("General Public License", "2"), "gpl,gpl-2.0"),
    (HEADER.format("Lesser General Public License", "2.1"), "lgpl"), (HEADER.format("Lesser General Public License", "3"), "lgpl"),
    (HEADER.format("Affero General Public License", "3"), "agpl-3.0"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache,apache-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "gpl,gpl-3.0"), ("GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991", "gpl,gpl-2.0"),
    ("Apache License\nVersion 2.0, January 2004", "apache,apache-2.0"), ("// SPDX-License-Identifier: MIT", "mit"),
    ("# SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd"),
    ("SPDX-License-Identifier: LicenseRef-Own", ""), ("version 3 of the general software may be redistributed", "")])
def test_license_headers_openings_and_spdx_lines(spark, table, text, labels):
    docs = table([text, *["some other words of a corpus that names no licence at all"] * 30])
    assert by_id(license_scan.scan_licenses(docs))[0].labels == labels


def plain_notices(index, text):
    """Every place of every notice, tried one by one."""
    words = license_scan.words_of(text)
    out = {}
    for t in index.templates:
        weight, best = sum(index.idf[w] for w in t.words), 0.0
        for start in range(-len(t.words), len(words) + 1):
            low, high = start - index.drift, start + len(t.words) + index.drift
            if all(any(low <= s and s + len(k) <= high and words[s:s + len(k)] == k for s in range(len(words))) for k in t.keys):
                best = max(best, sum(index.idf[w] for q, w in enumerate(t.words)
                                     if w in words[max(0, start + q - index.drift):max(0, start + q + index.drift + 1)]))
        if best >= index.least * weight:
            out[t.label] = max(out.get(t.label, 0), best / weight)
    return out


def test_license_labels_and_score_equal_every_place(spark, table):
    rng = random.Random(6)
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            notice = rng.choice(license_scan.NOTICES)[1].split()
            words += [w for w in notice if rng.random() < 0.93] + rng.choices(["the", "license", "plain", "2", "0"], k=rng.randrange(4))
        texts.append(" ".join(words))
    docs = table(texts)
    index = license_scan.build_index(docs)
    for i, r in by_id(license_scan.scan_licenses(docs)).items():
        want = plain_notices(index, texts[i])
        base = set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted(set(want) | base)), texts[i]
        assert math.isclose(r.score, 1.0 if base else min(1.0, max(want.values(), default=0.0)), abs_tol=1e-9)


def test_license_scan_of_a_phrase_repeated_through_a_long_text(table):
    import time

    index = license_scan.Index(dict.fromkeys(license_scan.vocabulary(license_scan.notices(), [p.encode().split() for p in license_scan.BASE]), 1.0))
    start = time.process_time()
    assert index.scan("all rights reserved " * 60_000)[5] == "all-rights-reserved"
    assert time.process_time() - start < 20


@pytest.mark.parametrize(("text", "labels"), [
    ("Some code.\nLicensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated "
     "documentation files (the 'Software'), to deal in the Software without restriction", "mit"),
    ("the license of the software is general", ""),
    ("All rights reserved.", "all-rights-reserved"),
])
def test_license_notices(spark, table, text, labels):
    docs = table([text] + ["the words of a text in the house"] * 30)
    assert by_id(license_scan.scan_licenses(docs))[0].labels == labels


def test_factorization_machine_learns_a_pair():
    """Neither word alone is toxic; both together are."""
    random.seed(6)
    rows = []
    for _ in range(3000):
        a, b = random.random() < 0.5, random.random() < 0.5
        words = [f"w{random.randrange(50)}" for _ in range(10)] + ["insult"] * a + ["group"] * b
        rows.append((toxicity.term_ids(" ".join(words)), int(a and b)))
    m = toxicity.fit(rows, epochs=30)
    both, one, other = (m.score(t) for t in ("w1 insult group", "w1 insult", "w1 group"))
    assert both > 0.7 > 0.3 > max(one, other)


def test_factorization_machine_learns_a_pair_whose_words_tell_nothing_alone():
    """Each word is as likely toxic as any; only both together always are."""
    rng = np.random.default_rng(3)
    noise = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(12000):
        a, b = rng.random(2) < 0.1
        words = [w for w, has in (("glarb", a), ("mooks", b)) if has]
        words += rng.choice(noise, 20, replace=False).tolist()
        rows.append((toxicity.term_ids(" ".join(words)), int(a and b or (not a and not b and rng.random() < 0.111))))
    share, single = np.mean([t for _, t in rows]), toxicity.term_ids("glarb")
    held = [t for x, t in rows if np.isin(single, x).all()]
    assert abs(np.mean(held) - share) < 3 * np.sqrt(share * (1 - share) / len(held))  # no effect of its own
    assert set(toxicity.joint_terms(rows)) == set(toxicity.term_ids("glarb mooks"))
    m = toxicity.fit(rows)
    pair, *alone = (m.score(f"{x} w1 w2 w3") for x in ("glarb mooks", "glarb", "mooks", ""))
    assert pair > 0.7 and max(alone) < 0.3


def test_factorization_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(21)
    machine = toxicity.Machine(0.3, rng.normal(size=1 << toxicity.BITS).astype(np.float32),
                               rng.normal(size=(1 << toxicity.BITS, 4)).astype(np.float32))
    for text in ["", "one", "You are a silly goose", "word " * 30 + "and other words, longer ones as well"]:
        ids = toxicity.term_ids(text).tolist()
        v = machine.factors.astype(float)
        plain = 0.3 + sum(float(machine.linear[i]) for i in ids) + sum(v[i] @ v[j] for i, j in itertools.combinations(ids, 2))
        assert machine.raw(np.array(ids, np.int32)) == pytest.approx(plain)
        assert machine.score(text) == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, plain)))))


@pytest.mark.parametrize("block", [3, 512])
def test_joint_terms_equal_a_plain_count(block):
    rng = np.random.default_rng(22)
    rows = []
    for _ in range(1500):
        ids = np.flatnonzero(rng.random(14) < 0.3)
        both = 2 in ids and 5 in ids
        rows.append((ids.astype(np.int32), int(rng.random() < (0.9 if both else 0.1))))
    rows += rows[:40]  # copies count once
    once = {(tuple(x.tolist()), t) for x, t in rows}
    share = sum(t for _, t in once) / len(once)
    every = Counter(i for x, _ in once for i in x)
    toxic = Counter(i for x, t in once if t for i in x)
    terms = [i for i in sorted(every) if toxic[i] >= 5]
    want = set()
    for i, j in itertools.combinations(terms, 2):
        held = [t for x, t in once if i in x and j in x]
        if len(held) < 5:
            continue

        def odds(p):
            return math.log(p / (1 - p))

        hope = sum(odds((toxic[k] + 10 * share) / (every[k] + 10)) for k in (i, j)) - odds(share)
        hope, seen = 1 / (1 + math.exp(-hope)), sum(held) / len(held)
        away = sum(p * math.log(p / q) for p, q in ((seen, hope), (1 - seen, 1 - hope)) if p > 0)
        if math.exp(-len(held) * away) * len(terms) * (len(terms) - 1) / 2 <= 0.01:
            want |= {i, j}
    assert {2, 5} <= want and set(toxicity.joint_terms(rows, block=block).tolist()) == want


def test_toxicity_held_out(spark):
    docs, labels = read(spark, SF.replace("0.01", "0.1"), "documents"), read(spark, SF.replace("0.01", "0.1"), "labels")
    out = toxicity.score_toxicity(docs, labels).join(labels.where("toxic is not null"), "doc_id").where("held_out").toPandas()
    assert len(out) > 800
    assert (out.predicted[out.toxic == 1]).mean() > 0.75 and (out.predicted[out.toxic == 0]).mean() < 0.01
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(out.doc_id, out.held_out, strict=True))


def test_toxicity_edges(spark, table):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = by_id(toxicity.score_toxicity(table(EDGE), none))
    assert {r.score for r in out.values()} == {0.5} and toxicity.score_toxicity(table([]), none).collect() == []


def plain_em(hist, uniform, rounds=60):
    """Mixture weights per context bucket, one token class after another."""
    part = lambda step: 0.0 if step < 0 else 2.0 ** (-step / lm_score.FINE)
    weights = {b: [1 / 3] * 3 if b else [0.5, 0.5, 0.0] for b in range(64)}
    used = {b for b, _, _ in hist}
    for _ in range(rounds if hist else 0):
        got = {b: [0.01, 0.01, 0.01 if b else 0.0] for b in range(64)}
        for (b, s2, s1), times in hist.items():
            joint = [w * p for w, p in zip(weights[b], (uniform, part(s1), part(s2)))]
            for k in range(3):
                got[b][k] += times * joint[k] / sum(joint)
        weights = {b: [x / sum(g) for x in g] for b, g in got.items()}
    for b in range(2, 64):
        if hist and b not in used and used & set(range(1, b)):
            weights[b] = weights[b - 1]
    return weights


def plain_lm(rows):
    """Unigram base and deleted interpolation over all words, without Spark."""
    tokens = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in rows}
    kind = {i: zlib.crc32(str(i).encode()) % 5 for i in tokens}
    one, two, own1, own2 = Counter(), Counter(), Counter(), Counter()
    for i, ws in tokens.items():
        pairs = list(zip([b"\n", *ws], ws))
        if kind[i] != 1:
            one.update(ws)
            two.update(pairs)
        if kind[i] == 0:
            own1.update(ws)
            own2.update(pairs)
    n, v = sum(one.values()), len(one)
    kept_n, kept_v = n - sum(own1.values()), sum(one[w] > own1[w] for w in one)
    hist = Counter()
    step = lambda p: round(-math.log2(p) * lm_score.FINE) if p > 0 else -1
    for i, ws in tokens.items():
        if kind[i] == 0:
            for h, w in zip([b"\n", *ws], ws):
                ch = one[h] - own1[h]
                p2 = (two[h, w] - own2[h, w]) / ch if ch else 0.0
                hist[math.ceil(math.log2(ch + 1)), step(p2), step((one[w] - own1[w]) / max(kept_n, 1))] += 1
    weights = plain_em(hist if kept_n else {}, 1 / (kept_v + 1))
    out = {}
    for i, ws in tokens.items():
        score = base = 0.0
        for h, w in zip([b"\n", *ws], ws):
            b = weights[math.ceil(math.log2(one[h] + 1))]
            score += math.log10(b[0] / (v + 1) + b[1] * one[w] / max(n, 1) + b[2] * (two[h, w] / one[h] if one[h] else 0))
            base += math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1)))
        out[i] = (kind[i] == 1, len(ws), sum(one[w] > 0 for w in ws), n, base, score)
    return out


@pytest.mark.parametrize("chunk", [200, 10 ** 6])
def test_lm_scores_equal_plain_counts(spark, table, chunk):
    random.seed(7)
    texts = EDGE + [" ".join(random.choice(["the", "The", "of", "a", f"w{random.randrange(40)}"]) for _ in range(random.randint(0, 60)))
                    for _ in range(150)]
    want = plain_lm(list(enumerate(texts)))
    got = by_id(lm_score.score_texts(table(texts), chunk_tokens=chunk, bucket_keys=100))
    for i, w in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert math.isclose(r.base_score, w[4], abs_tol=1e-9) and math.isclose(r.score, w[5], abs_tol=1e-9)


@pytest.mark.parametrize("doc_id", [2, None])
def test_lm_scores_of_rows_that_share_an_id(spark, doc_id):
    """Texts of one id, alike in shape but not in words, whatever the partitions."""
    texts = ["a", "b", "c", "a", "a", "d", "a b", "c d", "", None]
    docs = spark.createDataFrame([(doc_id, t) for t in texts], "doc_id long, text string")
    results = [sorted(tuple(r)[1:] for r in lm_score.score_texts(docs.repartition(n), chunk_tokens=c).collect())
               for n, c in ((1, 10 ** 6), (1, 2), (6, 10 ** 6), (10, 1))]
    for other in results[1:]:
        assert len(other) == len(texts)
        for x, y in zip(results[0], other, strict=True):
            assert x[:4] == y[:4] and x[4:] == pytest.approx(y[4:], abs=1e-9)
    count, n, v = Counter("a b c a a d a b c d".split()) + Counter({"\n": 10}), 20, 5
    base = lambda t: sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*(t or "").split(), "\n"])
    assert sorted(r[4] for r in results[0]) == pytest.approx(sorted(map(base, texts)))


def test_lm_edges_and_gain(spark, table):
    assert lm_score.score_texts(table([])).collect() == []
    repeated = table(["same words here"] * 7)
    rows = lm_score.score_texts(repeated.unionByName(repeated)).collect()
    assert len(rows) == 14 and all(r.n_tokens == 4 for r in rows)
    out = lm_score.score_texts(read(spark, SF, "documents")).where("held_out").toPandas()
    assert out.score.sum() > out.base_score.sum() + 0.3 * out.n_tokens.sum()
