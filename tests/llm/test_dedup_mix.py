"""Line dedup, Jaccard join, vector near-duplicates, components, mixing, pipeline."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from offerflow.llm import embedding_dedup, jaccard_join, line_dedup, mixing
from offerflow.llm.common import BATCH_BYTES, FEW_FILES, TEXTS_PER_BATCH, conf_number, read, small_batches
from offerflow.llm.components import components
from offerflow.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import by_id

SF = "/root/testdata/sf0.001"


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_batches_are_bounded_in_bytes(spark):
    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(k) for k in keys]

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    try:
        for k in keys:
            spark.conf.unset(k)
        small_batches(spark)
        wide = spark.range(0, 700, 1, 1).selectExpr("cast(repeat('x', 100000) as binary) as raw")
        sizes = [r["size"] for r in wide.mapInArrow(size, "size long").collect()]
        assert max(sizes) < BATCH_BYTES + 1_000_000 and sum(sizes) >= 70_000_000  # all rows, in several batches
        for k, less in zip(keys, ("7", "2m"), strict=True):  # never raised
            spark.conf.set(k, less)
        small_batches(spark)
        assert [conf_number(spark.conf.get(k)) for k in keys] == [7, 2 << 20]
        spark.conf.set(keys[0], "0")  # no limit
        small_batches(spark)
        assert spark.conf.get(keys[0]) == str(TEXTS_PER_BATCH)
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def test_components_of_few_nodes_write_few_files(spark):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    links = [(i, i + 1000) for i in range(600)]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = components(spark.createDataFrame(links, "a long, b long"))
        assert len(got.inputFiles()) <= FEW_FILES
        assert {(r.node, r.component) for r in got.collect()} == {(n, a) for a, b in links for n in (a, b)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_of_chains_stars_and_cycles(spark):
    random.seed(8)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 400)] + [(7, 5), (5, 9), (9, 7)]
    links += [(random.randrange(500, 900), random.randrange(500, 900)) for _ in range(250)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find({n for e in links for n in e}, links)
    assert all(got[n] == want[n] for n in got) and {n for a, b in links if a != b for n in (a, b)} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- line dedup

PASSAGE = "A first long line of the passage.\nShort.\nA second long line of the passage."


def plain_shared(texts):
    """Lines (with their keys) that an earlier document has."""
    first, out = {}, {}
    for i, t in enumerate(texts):
        keys = [k for k, _ in line_dedup.line_keys(t)] if t else []
        out[i] = [n for n, k in enumerate(keys) if k is not None and first.get(k, i) != i]
        for k in keys:
            first.setdefault(k, i)
    return out


def test_line_dedup_cases(spark, table):
    texts = ["Intro only here in the first one.\n" + PASSAGE, PASSAGE + "\nIts own last line with some words.",
             None, "", "Short.", "Something else entirely stands in here.\nShort.\nA second long line of the passage.",
             PASSAGE, "A second long line of the passage.\nUnique words between the moved lines.\nA first long line of the passage."]
    out = by_id(line_dedup.dedup_report(table(texts)))
    assert [out[i].n_removed for i in range(8)] == [0, 3, 0, 0, 0, 1, 3, 2]
    assert out[1].partners == [0] and out[6].partners == [0]
    kept = by_id(line_dedup.remove_shared(table(texts)))
    assert 6 not in kept and len(kept) == 7
    assert kept[1].text == "Its own last line with some words." and kept[1].n_chars == len(kept[1].text)
    assert kept[5].text == "Something else entirely stands in here.\nShort."  # a short line alone is left alone
    assert kept[2].text is None and kept[3].text == "" and kept[4].text == "Short."
    assert line_dedup.remove_shared(table(texts)).schema == table(texts).schema


def test_line_dedup_equals_plain_rule_and_repeated_rows(spark, table):
    random.seed(9)
    lines = [f"line number {i} has enough words" for i in range(12)] + ["Tiny.", "", "two words"]
    texts = ["\n".join(random.choice(lines) for _ in range(random.randint(0, 12))) for _ in range(120)]
    docs = table(texts)
    out = by_id(line_dedup.dedup_report(docs))
    assert {i: r.n_removed for i, r in out.items()} == {i: len(x) for i, x in plain_shared(texts).items()}
    twice = line_dedup.dedup_report(docs.limit(5).unionByName(docs.limit(5)))
    assert twice.count() == 10
    assert line_dedup.dedup_report(docs.limit(0)).collect() == []


def test_runs_of_short_lines_match_whatever_stands_around_them(table):
    verse = "O wild west\nwind\n\nthou breath\nof autumn's\nbeing"
    han = "\u5929\u5730\u7384\u9ec4\n\u5b87\u5b99\u6d2a\u8352\n\u65e5\u6708\u76c8\u6603"
    texts = ["The first title has five words\n" + verse + "\nfoo", "Quite another title stands above it\nbar baz\n" + verse + "\nend",
             verse, verse, han, "\u522b\u7684\n" + han, "Tiny.\nbar baz", "Tiny.\nbar baz",
             "\u4e00\u4e8c\u4e09\u56db\u4e94\u516d\u4e03\u516b\u4e5d\u5341", "x\n\u4e00\u4e8c\u4e09\u56db\u4e94\u516d\u4e03\u516b\u4e5d\u5341"]
    out = by_id(line_dedup.dedup_report(table(texts)))
    assert [out[i].n_removed for i in range(10)] == [0, 6, 6, 6, 0, 3, 0, 0, 0, 1]
    assert out[1].partners == [0] and out[3].partners == [0] and out[5].partners == [4]
    kept = by_id(line_dedup.remove_shared(table(texts)))
    assert kept[1].text == "Quite another title stands above it\nbar baz\nend" and 2 not in kept and 3 not in kept
    assert kept[5].text == "\u522b\u7684" and kept[7].text == "Tiny.\nbar baz" and kept[9].text == "x"


def test_line_dedup_of_rows_that_share_an_id(spark):
    """Each text of an id loses its own shared lines; rows that repeat whole lose the same."""
    a, b = "a first line that several texts have", "a second line that several texts have"
    rows = [(1, a + "\n" + b, "x", "y"), (2, a + "\nonly here", "x", "y"), (2, b + "\nand only there", "x", "y")] + [(3, b, "x", "y")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines string, __gone_id string").repartition(4)
    got = sorted((r.doc_id, r.n_removed, r.partners) for r in line_dedup.dedup_report(docs).collect())
    assert got == [(1, 0, []), (2, 1, [1]), (2, 1, [1])] + [(3, 1, [1])] * 3
    kept = line_dedup.remove_shared(docs)
    assert sorted(tuple(r)[:2] for r in kept.collect()) == [(1, a + "\n" + b), (2, "and only there"), (2, "only here")]
    assert kept.columns == docs.columns


def test_patience_keeps_order_and_aligns_unique_lines():
    d, o = dict(enumerate([1, 2, 3, 4, 5])), dict(enumerate([9, 1, 4, 3, 5]))
    pairs = line_dedup.patience(d, o)
    assert all(d[p] == o[q] for p, q in pairs) and (0, 1) in pairs and (4, 4) in pairs
    assert [q for _, q in sorted(pairs)] == sorted(q for _, q in pairs)
    assert line_dedup.increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    assert line_dedup.blocks([(0, 5), (1, 6), (3, 9)], {0: 2, 1: 2, 3: 9}, 5) == [(3, 1)]


# ---- n-gram Jaccard join

def plain_jaccard(texts):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return degree, union_find(range(len(texts)), links)


@pytest.mark.parametrize("block", [4, 256])
def test_jaccard_links_equal_all_pairs(spark, table, block):
    random.seed(10)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for _ in range(12):
        base = [random.choice(words) for _ in range(random.choice([6, 40, 120]))]
        for _ in range(random.randint(1, 25)):
            copy = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 8])):
                copy[random.randrange(len(copy))] = random.choice(words)
            texts.append(" ".join(copy))
    random.shuffle(texts)
    degree, group = plain_jaccard(texts)
    out = by_id(jaccard_join.jaccard_links(table(texts), block=block))
    assert {i: (r.n_links, r.class_id) for i, r in out.items()} == {i: (degree[i], group[i]) for i in range(len(texts))}
    kept = jaccard_join.one_of_each(table(texts))
    assert {r.doc_id for r in kept.collect()} == set(group.values()) and kept.columns == table(texts).columns


def test_jaccard_edges(spark, table):
    docs = table(["a b c d e f", "a b c d e f"])
    out = jaccard_join.jaccard_links(docs.unionByName(docs)).collect()
    assert len(out) == 4 and all(r.n_links == 3 and r.class_id == 0 for r in out)
    nulls = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_links) for r in jaccard_join.jaccard_links(nulls).collect()) == [(-1, 0), (1, 0)]
    assert jaccard_join.jaccard_links(docs.limit(0)).collect() == []


def test_one_of_each_of_rows_that_share_an_id(spark):
    t, u = "one text of some more than five words", "another text with quite different words in it"
    rows = [(1, t, "a"), (2, t, "b"), (2, u, "c"), (3, t, "d"), (4, u, "e"), (5, "five", "f"), (5, "five", "g"), (None, t, "h"), (6, None, "i"), (6, None, "i"),
            (6, "", "j"), (6, "words of six", "k"), (6, "other words", "l"), (7, "other words", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id string").repartition(4)
    kept = jaccard_join.one_of_each(docs)
    got = sorted(((r.doc_id or 0, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(0, t), (1, t), (2, u), (5, "five"), (6, None), (6, None), (6, ""), (6, "words of six"), (6, "other words")], key=str)
    assert kept.columns == docs.columns


def test_prefix_depth_meets_the_recall():
    depth = jaccard_join.prefix_depth()
    assert 1 - (1 - 0.8 ** depth) ** jaccard_join.TREES >= jaccard_join.RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** jaccard_join.TREES


def test_new_pairs_are_met_once_in_their_first_tree():
    rng = np.random.default_rng(12)
    trees, deepest = 5, 4
    s = np.repeat(rng.integers(0, 3, (6, trees * deepest)), 5, axis=0)
    s = np.where(rng.random(s.shape) < 0.2, rng.integers(0, 3, s.shape), s).astype(np.uint32)
    every = np.arange(len(s))
    for depth in range(1, deepest + 1):
        seen = {}
        for tree in range(trees):
            for a, b, same in zip(*jaccard_join.new_pairs(s, trees, tree, depth, every, None), strict=True):
                assert (a, b) not in seen
                seen[a, b] = tree
                assert same == (s[a] == s[b]).sum()
        want = {}
        for a in every:
            for b in range(a + 1, len(s)):
                holds = (s[a] == s[b]).reshape(trees, deepest)[:, :depth].all(1)
                if holds.any() and 2 * (s[a] == s[b]).sum() >= s.shape[1]:
                    want[a, b] = holds.argmax()
        assert seen == want


def test_prefixes_are_longer_in_a_table_of_few_links(spark):
    rng = np.random.default_rng(13)
    trees, deepest = jaccard_join.TREES, jaccard_join.DEEPEST

    def classes(groups, size, changed):
        rows = []
        for g in range(groups):
            own = rng.integers(0, 1 << 32, trees * deepest, dtype=np.uint32)
            for _ in range(size):
                sig = np.where(rng.random(len(own)) < changed, rng.integers(0, 1 << 32, len(own), dtype=np.uint32), own)
                rows.append((len(rows), sig.tobytes()))
        return spark.createDataFrame(rows, "cls long, sig binary")

    def depth_of(table):
        return jaccard_join.forest_depth(table, trees, deepest, jaccard_join.RECALL, jaccard_join.BLOCK)

    last = jaccard_join.prefix_depth()
    sparse, recall = depth_of(classes(40, 2, 0.01))
    assert last < sparse <= deepest and recall > 0.9999
    dense, recall = depth_of(classes(10, 20, 0.1))  # similarities about 0.8
    assert dense == last and recall > 0.9999
    assert depth_of(classes(30, 1, 0))[0] > last
    assert depth_of(classes(0, 1, 0))[0] > last


def test_expected_loss_follows_the_pairs_met():
    counts = np.zeros(20 * 6 + 1, np.int64)
    alone, _ = jaccard_join.expected_loss(counts, 5, 20, 6)
    assert alone == pytest.approx((1 - 0.8 ** 5) ** 20)  # the one more link
    counts[120] = 1000  # equal signatures are always met
    counts[60] = 1000  # no links
    lost, recall = jaccard_join.expected_loss(counts, 5, 20, 6)
    assert lost == pytest.approx(alone) and recall == pytest.approx(1 - lost / 1001)
    counts[96] = 500  # at the threshold: each stands for 1 / 0.8^6
    assert jaccard_join.expected_loss(counts, 5, 20, 6)[0] == pytest.approx((500 / 0.8 ** 6 + 1) * alone)


# ---- vectors

def test_vector_links_equal_all_pairs(spark):
    rng = np.random.default_rng(11)
    rows = []
    for label in (0, 1):
        for c in rng.normal(size=(6, 8)):
            rows += [(v.tolist(), label) for v in c + rng.normal(scale=rng.choice([0.02, 0.06, 0.1]), size=(30, 8))]
    rows += [([1.0] * 8, 0), ([2.0] * 8, 0), ([1.0] * 8, 1), ([0.0] * 8, 0), (None, 0), ([], 0), ([1.0, None] + [1.0] * 6, 0),
             ([float("nan")] * 8, 0), ([float("inf")] * 8, 1), ([1.0] * 8, None), ([1.0] * 4, 0), (rows[0][0], 0), (rows[0][0], 0)]
    order = rng.permutation(len(rows))
    vectors = [(int(i), *rows[k]) for i, k in enumerate(order)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumnRenamed("vec_id", "vec_id")
    stored = {r.vec_id: (r.embedding, r.label) for r in df.collect()}
    good = {i: np.array(v, float) for i, (v, label) in stored.items() if label is not None and v and None not in v
            and np.isfinite(np.array(v, float)).all() and any(v)}
    links = [(i, j) for i in good for j in good if i < j and stored[i][1] == stored[j][1] and len(good[i]) == len(good[j])
             and good[i] @ good[j] / (np.linalg.norm(good[i]) * np.linalg.norm(good[j])) >= 0.98]
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    group = union_find(stored, links)
    for block in (16, 1000):
        out = by_id(embedding_dedup.near_duplicates(df, block=block, cells=4), "vec_id")
        assert {i: (r.n_links, r.component_id, r.kept) for i, r in out.items()} == {
            i: (degree[i], group[i], group[i] == i) for i in stored}
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_vectors_near_the_ends_of_the_range(spark):
    rows = [(1, [1e-200, 0.0], 0), (2, [5e-324, 0.0], 0), (3, [1e200, 0.0], 0), (4, [1.7e308, 1e150], 0), (5, [0.0, 1e-300], 0),
            (6, [1.0, 1e-200], 0), (7, [1e-160, 1e-160], 0), (8, [3e170, 3.1e170], 0), (9, [0.0, 0.0], 0)]
    got = by_id(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), "vec_id")
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {
        1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 6: (4, 1), 5: (0, 5), 7: (1, 7), 8: (1, 7), 9: (0, 9)}
    i, j = embedding_dedup.links_between(np.array([[1e200, 0], [2e200, 0], [0, 1e-200]]), np.array([[1e-200, 0.0]]), 0.98, False)
    assert sorted(i.tolist()) == [0, 1] and j.tolist() == [0, 0]


def test_cover_tree_bounds_and_walk():
    rng = np.random.default_rng(12)
    x = np.concatenate([c + rng.normal(scale=0.03, size=(100, 5)) for c in rng.normal(size=(8, 5))])

    def check(node):
        centre, radius, members, children = node
        assert (np.linalg.norm(x[members] - x[centre], axis=1) <= radius + 1e-9).all()
        if children:
            assert sorted(np.concatenate([c[2] for c in children]).tolist()) == sorted(members.tolist())
            assert all(c[1] <= radius / 2 + 1e-9 for c in children)
            for c in children:
                check(c)

    check(embedding_dedup.cover_tree(x, np.arange(len(x)), 0, float(np.linalg.norm(x - x[0], axis=1).max()), 0.01))
    i, j = embedding_dedup.links_between(x, x, 0.98, True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = [tuple(sorted(e)) for e in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(set(found)) == len(found)
    assert set(found) == {(a, b) for a, b in np.argwhere(u @ u.T >= 0.98).tolist() if a < b}


# ---- mixing

def test_raking_meets_marginals_and_given_targets(spark):
    random.seed(13)
    docs = spark.createDataFrame([Row(doc_id=i, text="w " * random.randint(0, 50), lang=random.choice(["en", "de", None]),
                                      source=random.choice(["a"] * 5 + ["b", "c"]), n_chars=0, topic="clash") for i in range(600)],
                                 "doc_id long, text string, lang string, source string, n_chars long, topic string")
    topics = spark.createDataFrame([(i, i % 3) for i in range(400)], "vec_id long, label int")
    out = mixing.mixture(docs.drop("topic"), topics, {"lang": {"en": 3, "de": 1, "xx": 5}}).toPandas()
    assert len(out) == 600 and out.probability.max() == 1.0
    taken = (out.tokens * out.probability).groupby(out.lang).sum()
    assert abs(taken["en"] / taken.sum() - 0.75) < 1e-6 and taken.get(mixing.NONE, 0) == 0
    tokens = out.groupby("source").tokens.sum().astype(float)
    share = tokens ** mixing.POWER / (tokens ** mixing.POWER).sum()
    assert abs((out.tokens * out.probability).groupby(out.source).sum() / taken.sum() - share).max() < 1e-6
    picked = {r.doc_id for r in mixing.sampled(docs, topics, {"lang": {"en": 3, "de": 1, "xx": 5}}).collect()}
    assert picked == set(out.doc_id[out.selected])
    assert mixing.sampled(docs, topics).schema == docs.schema
    assert mixing.mixture(docs.limit(0), topics).collect() == []


def test_raking_goes_on_until_sources_of_one_language_meet_their_targets(spark):
    """Sources hold mostly one language and topic, one is hot: 8 sweeps are far off."""
    n, langs, topics = 20, 6, 4
    cells = [(f"s{s}", f"l{i}", f"t{j}", max(1, int((5e7 if s == 0 else 1e6) * (1 if i == s % langs else 0.01) * (1 if j == s % topics else 0.1))))
             for s in range(n) for i in range(langs) for j in range(topics)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {"source": {f"s{s}": 1 + s % 3 for s in range(n)}, "lang": {f"l{i}": 1 + i % 3 for i in range(langs)}}
    raked, errors = mixing.rake(df, targets)
    assert len(errors) > 8 and errors[7] > 1e-3 and errors[-1] <= mixing.TOLERANCE
    out = raked.toPandas()
    assert len(out) == len(cells)
    for d in ("source", "lang"):
        raw = {k: v for k, v in targets[d].items()}
        got = out.groupby(d).weight.sum()
        assert all(abs(got[k] / (v / sum(raw.values())) - 1) <= 2 * mixing.TOLERANCE for k, v in raw.items())


def test_mixing_equals_its_sql_where_eight_sweeps_are_not_enough(spark):
    cells = mixing.counted(read(spark, SF, "documents"), read(spark, SF, "embeddings")).groupBy(*mixing.DIMENSIONS).sum("tokens")
    errors = mixing.rake(cells.withColumnRenamed("sum(tokens)", "tokens"))[1]
    assert len(errors) > mixing.SWEEPS and errors[mixing.SWEEPS - 1] > mixing.TOLERANCE >= errors[-1]
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, tokens, probability, selected FROM ({ORACLES['op5_mixing']})").fetchall()}
    got = by_id(QUERIES["op5_mixing"](spark, SF))
    assert got.keys() == want.keys()
    for i, (tokens, probability, selected) in want.items():
        assert (got[i].tokens, got[i].selected) == (tokens, selected)
        assert got[i].probability == pytest.approx(probability, abs=2e-9)


def test_raking_of_tables_equals_raking_in_the_driver(spark):
    cells = spark.createDataFrame([("a", "x", "t", 900), ("a", "y", "t", 100), ("b", "x", "t", 60), ("b", "y", "t", 300)],
                                  "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 1, "b": 1}, "lang": {"x": 1, "y": 3}}
    (one, errors), (two, others) = mixing.rake(cells, targets, sweeps=2), mixing.rake(cells, targets, sweeps=2, local_cells=0)
    assert len(errors) == len(others) > 2 and errors == pytest.approx(others, rel=1e-6)
    assert {r[:3]: r.weight for r in one.collect()} == pytest.approx({r[:3]: r.weight for r in two.collect()}, rel=1e-9)


def test_raking_ends_where_targets_cannot_be_met(spark, caplog):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, tokens long")
    _, errors = mixing.rake(cells, {"source": {"a": 1, "b": 1}, "lang": {"x": 3, "y": 1}})
    assert len(errors) == mixing.PATIENCE + 1 and errors[-1] > 0.1 and "out of reach" in caplog.text
    assert mixing.rake(cells.limit(0))[0].collect() == []


# ---- pipeline

def test_pipeline_is_its_stages_one_after_another(spark):
    import corpus_pipeline

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = read(spark, SF, "documents")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF)
        assert docs.columns == columns and 0 < docs.count() <= before
    want = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def plain_mix(docs, topic):
    """Raking over a dictionary of cells; docs: id -> (text, lang, source)."""
    import hashlib
    import re

    tokens = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, (t, _, _) in docs.items()}
    cell = {i: (source, lang, str(topic[i]) if i in topic else mixing.NONE) for i, (_, lang, source) in docs.items()}
    total = defaultdict(float)
    for i, c in cell.items():
        total[c] += tokens[i]

    def marginal(values, d):
        out = defaultdict(float)
        for c, v in values.items():
            out[c[d]] += v
        return out

    weight = {c: v for c, v in total.items() if v}
    shares = []
    for d in range(3):
        raw = {k: v ** mixing.POWER for k, v in marginal(weight, d).items()}
        shares.append({k: v / sum(raw.values()) for k, v in raw.items()})
    for _ in range(mixing.SWEEPS):
        for d in range(3):
            now = marginal(weight, d)
            weight = {c: v * shares[d][c[d]] / now[c[d]] for c, v in weight.items()}
    ratio = {c: v / total[c] for c, v in weight.items()}
    top = max(ratio.values())
    draw = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2 ** 32 for i in docs}
    return [i for i in docs if draw[i] < round(ratio.get(cell[i], top) / top, 9)]


def test_pipeline_equals_plain_stages(spark):
    import corpus_pipeline
    from offerflow.llm import bpe, quality_rules
    from tests.llm.test_tokens import ENC

    source = read(spark, SF, "documents")
    chain = quality_rules.train(source, read(spark, SF, "labels"))
    rows = sorted((r.doc_id, r.text, r.lang, r.source) for r in source.collect())
    rows = [r for r in rows if quality_rules.judge(chain, r[1])[6]]
    gone = plain_shared([t for _, t, _, _ in rows])
    kept = []
    for n, (i, text, lang, src) in enumerate(rows):
        left = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in set(gone[n]))
        if not gone[n] or left.split():
            kept.append((i, left, lang, src))
    _, group = plain_jaccard([t for _, t, _, _ in kept])
    docs = {r[0]: r[1:] for n, r in enumerate(kept) if group[n] == n}
    topic = {r.vec_id: r.label for r in read(spark, SF, "embeddings").collect()}
    want = set()
    for i in plain_mix(docs, topic):
        ids = np.array(ENC.encode_ordinary(docs[i][0]), "<u4").tobytes()
        want.add((i, len(ids) // 4, bpe.sha256(ids).hexdigest(), bpe.sha256(docs[i][0].encode()).hexdigest()))
    assert want and {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want
