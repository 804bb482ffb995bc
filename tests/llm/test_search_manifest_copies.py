"""Lexical search, Merkle manifest and exact dedup against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerflow.llm import exact_dedup, lexical_search, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, pos long, rank string, h string, piece string"


def documents(spark, rows, parts=7):
    """Rows (doc_id, text, source) over many partitions, with columns whose names the operators use themselves."""
    full = [(i, t, "en" if t else None, s, None if t is None else len(t), "g", -1, "r", "h", "p") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


# ---- exact dedup

def plain_copies(rows, largest=True):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        first = ids.index(keep)
        for k, i in enumerate(ids):
            out[i, keep, len(ids), k == first, sha256(text.encode()).hexdigest()] += 1
    return out


COPIES = ([(i, "one text that a third of the rows hold " * 30, "s") for i in range(0, 300, 2)]
          + [(i, f"another text, number {i % 40}", "s") for i in range(1, 300, 2)]
          + [(7, None, "s"), (8, "", "s"), (None, "", "s"), (None, "only without id", None), (None, "only without id", None),
             (9, "x" * 300_000, "s"), (10, "x" * 300_000 + "y", "s"), (11, "x" * 300_000, "s"), (12, "Ünïcode\n", "s"),
             (12, "Ünïcode\n", "s"), (12, "ünïcode\n", "s")])


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_copies(spark, keep):
    got = Counter(tuple(r) for r in exact_dedup.exact_copies(documents(spark, COPIES), keep).collect())
    assert got == plain_copies(COPIES, keep == "largest")


def test_exact_copies_cut_into_pieces(spark, monkeypatch):
    """Many small shares: the large group is sorted in pieces, and rows that repeat an id spread over them."""
    monkeypatch.setattr(exact_dedup, "SHARE_BYTES", 4000)
    rows = COPIES + [(5, "the same row again " * 9, "s")] * 60
    docs = documents(spark, rows)
    heavy, parts = exact_dedup._heavy(exact_dedup._keyed(docs, None), 8)
    assert parts > 100 and heavy.agg(F.max("pieces")).first()[0] > 20 and heavy.count() <= parts
    assert Counter(tuple(r) for r in exact_dedup.exact_copies(docs).collect()) == plain_copies(rows)


def test_exact_copies_told_apart_where_hashes_meet(spark, monkeypatch):
    """All texts under one hash and one beginning: only the whole comparison tells them apart."""
    keyed = exact_dedup._keyed
    monkeypatch.setattr(exact_dedup, "_keyed", lambda d, n: keyed(d, n).withColumn("h", F.lit(1).cast("long")).withColumn("head", F.lit("")))
    assert Counter(tuple(r) for r in exact_dedup.exact_copies(documents(spark, COPIES)).collect()) == plain_copies(COPIES)


def test_exact_copies_normalised_and_empty(spark):
    got = exact_dedup.exact_copies(documents(spark, [(1, "A b", "s"), (2, "a B", "s"), (3, "c", "s")]), normalise=F.lower)
    assert {(r.doc_id, r.keep_id, r.kept) for r in got.collect()} == {(1, 2, False), (2, 2, True), (3, 3, True)}
    none = exact_dedup.exact_copies(documents(spark, []))
    assert none.collect() == [] and none.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_exact_copies_plan_shuffles_texts_once(spark):
    rows = exact_dedup._keyed(documents(spark, COPIES).coalesce(1), None)
    heavy = spark.createDataFrame([(1, 2)], "h long, pieces int")
    plan = exact_dedup.sorted_runs(rows, heavy, 8, "largest")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan and "Python" not in plan


# ---- Merkle manifest

def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """(root, per leaf the siblings level by level as (left, right))."""
    paths, level = [[] for _ in leaves], list(leaves)
    spans = [[i] for i in range(len(leaves))]
    while len(level) > 1:
        up, up_spans = [], []
        for at in range(0, len(level), 3):
            run = level[at:at + 3]
            for k in range(len(run)):
                for i in spans[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(h(*run))
            up_spans.append(sum(spans[at:at + 3], []))
        level, spans = up, up_spans
    return (level[0] if level else None), paths


def plain_leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_report(rows):
    full = [(i, s, "en" if t else None, None if t is None else len(t), t) for i, t, s in rows]
    by_source = defaultdict(list)
    for r in full:
        by_source[r[1]].append((r[0] is not None, r[0] or 0, plain_leaf(*r), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        own = sorted(by_source[name], key=lambda x: x[:3])
        trees.append((own, *plain_tree([x[2] for x in own])))
    root, upper = plain_tree([t[1] for t in trees])
    out = Counter()
    for (own, top, paths), tail in zip(trees, upper, strict=True):
        for (_, _, leaf, r), path in zip(own, paths, strict=True):
            path = path + tail
            d = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                d = plain_leaf(*r[:4], None if r[4] is None else r[4].replace("\n", ""))
            for left, right in path:
                d = h(left, d, right)
            out[r[0], leaf, top, root, h(*(x + y for x, y in path)), d, d == root] += 1
    return out


def manifest_rows(seed, n, sources):
    rng = random.Random(seed)
    rows = [(rng.randrange(3 * n), rng.choice(["a\nb", "line", "zwei\nÜ\n", "", None, "x\n" * 2000]),
             rng.choice(sources)) for _ in range(n)]
    return rows + [(None, "no id\n", None), (4, "alone\n", "lone ß"), (4, "same\n", sources[0]), (4, "same\n", sources[0])]


@pytest.mark.parametrize(("n", "sources"), [(0, ["a"]), (30, ["a", "b", None, "B", "é"]), (400, ["hot"] * 30 + [f"s{i}" for i in range(40)])])
def test_manifest(spark, n, sources):
    rows = manifest_rows(n, n, sources)
    got = Counter(tuple(r) for r in merkle.tamper_report(documents(spark, rows)).collect())
    assert got == plain_report(rows)


def test_manifest_of_one_row_and_of_none(spark):
    rows = [(3, "only\n", "s")]
    assert Counter(tuple(r) for r in merkle.tamper_report(documents(spark, rows)).collect()) == plain_report(rows)
    none = merkle.tamper_report(documents(spark, []))
    assert none.collect() == [] and none.columns[-1] == "verified"


def test_proofs_fold_to_the_root_and_no_other_leaf_does(spark):
    rows = manifest_rows(5, 60, ["a", "b"])
    proofs = merkle.proofs(documents(spark, rows))
    got = proofs.select(merkle.folded(F.unhex("leaf"), "path").alias("good"), "root",
                        merkle.folded(merkle.digest(F.lit("other")), "path").alias("bad")).collect()
    assert all(r.good == r.root and r.bad != r.root for r in got)


# ---- lexical search

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, top=10):
    texts = [(i, plain_words(t)) for i, t, _ in docs]
    texts = [(i, w) for i, w in texts if w]
    n, total = len(texts), sum(len(w) for _, w in texts)
    df = Counter(x for _, w in texts for x in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = Counter()
    for item_id, text in items:
        found = []
        for doc_id, w in texts:
            tf, m = Counter(w), 25 + 75 * len(w) * n // total
            score = sum(weight[t] * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in plain_words(text) if t in tf)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, null, doc_id) in enumerate(sorted(found)[:top], 1):
            out[item_id, rank, None if null else doc_id, -score] += 1
    return out


def search_case(seed, n_docs=120, n_items=25):
    rng = random.Random(seed)
    vocabulary = ["the", "OF", "and", "Zürich", "漢字", "x86", "été"] + [f"w{i}" for i in range(60)]
    text = lambda k: rng.choice([" ", ", ", "\n", "-", "_"]).join(
        rng.choices(vocabulary, [40, 30, 20] + [2] * (len(vocabulary) - 3), k=k))
    docs = [(rng.randrange(200), text(rng.randrange(1, 60)), "s") for _ in range(n_docs)]
    docs += [(300, None, "s"), (301, "", "s"), (302, "!! .. --", "s"), (None, "w1 w2 w3", "s"), (303, "w1 w2 w3", "s"),
             (304, "w1 w2 w3", "s"), (304, "w1 w2 w3", "s"), (305, "w5 " * 30_000, "s")]
    items = [(i, text(rng.randrange(1, 30))) for i in range(n_items)]
    items += [(90, None), (91, ""), (92, "nowhere-to-be-found"), (93, "w1 W1 w1 w2 w3"), (94, "w1 W1 w1 w2 w3"), (95, "w5"), (95, "w5 the")]
    return docs, items


@pytest.mark.parametrize("block_terms", [100_000, 40])
def test_search_equals_plain_scores(spark, block_terms):
    docs, items = search_case(block_terms)
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).repartition(3)
    got = lexical_search.search(documents(spark, docs), table, block_terms=block_terms)
    assert Counter(tuple(r) for r in got.collect()) == plain_search(docs, items)


def test_search_of_empty_tables(spark):
    docs, items = search_case(1, 5, 3)
    table = spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.search(documents(spark, []), table).collect() == []
    none = lexical_search.search(documents(spark, docs), table.limit(0))
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("seed", range(6))
def test_shared_sums_give_each_items_own_sum(seed):
    """The graph shares work and every item still gets its own terms, however often repeated."""
    rng = random.Random(seed)
    texts = [[b"t%d" % rng.randrange(25) for _ in range(rng.randrange(0, 30))] for _ in range(20)]
    graph = lexical_search.mine(texts)
    adds = len(graph.pairs) + sum(map(len, graph.items))
    assert graph.pairs and adds < sum(len(set(t)) for t in texts)
    value = {t: rng.randrange(1, 1000) for t in graph.terms}
    n = len(graph.terms)
    got = lexical_search.evaluate(graph, np.zeros(n, np.int64), np.arange(n), np.array([value[t] for t in graph.terms]), 1)
    assert got[:, 0].tolist() == [sum(value[t] for t in text) for text in texts]
    few = lexical_search.mine(texts, rounds=2)
    assert len(few.pairs) == 2 and lexical_search.evaluate(
        few, np.zeros(n, np.int64), np.arange(n), np.array([value[t] for t in few.terms]), 1)[:, 0].tolist() == got[:, 0].tolist()


def test_a_document_is_scored_from_whole_texts_beyond_64_bit_products():
    big = np.array([10 ** 12], np.int64)
    assert lexical_search.lengths(big, 10 ** 9, 10 ** 13).tolist() == [25 + 75 * 10 ** 12 * 10 ** 9 // 10 ** 13]
