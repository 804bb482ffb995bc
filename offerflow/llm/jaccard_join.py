"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

A document is the set of its five-word shingles (lower-cased over A-Z; fewer
words make one shorter shingle). Documents with equal sets are one class with a
count. Each class has one signature of ``deepest`` hashes per tree: its path in a
trie whose nodes are the prefixes that two classes or more share.

How far prefixes are shortened depends on the table. The first tree is matched at
its whole length. The agreement of two signatures estimates a pair's similarity s;
a pair found there stands for 1 / s^deepest pairs, and each of them would be met by
prefixes of another length with chance 1 - (1 - s^depth)^trees. From the deepest
level up, prefixes lose a hash until the links expected to be lost in the whole
table, one more link at the threshold included, are at most ``LOST``, or until a
pair at the threshold itself is met with ``RECALL``, whichever is deeper. Tables
with few links near the threshold end early, tables with many at the second bound.
All classes are then matched in all trees at that level.

Neighbours are compared in two steps. Signatures alone first: pairs whose
signatures agree in under half of their hashes are dropped (at similarity 0.8
that has a chance below 1e-11); a pair belongs to the first tree that holds it.
Only classes with a pair left send their shingle set, only to the groups where
the pair was new, and the set sizes and intersections decide exactly. A prefix
shared by many classes is cut into blocks by a hash; each pair of blocks is a
group of bounded size. Groups return link counts per class and a spanning
forest of their links, never all pairs; classes of links are then connected.

Defined results: null and empty texts have no shingles and link with nothing;
so do rows with a null id, whose class is null; texts are read whole; rows that
repeat an id stay rows of their own; other columns are not read.
"""

from __future__ import annotations

import logging
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerflow.llm.common import Remembered, few_files, map_texts, saved, unused
from offerflow.llm.components import components
from offerflow.llm.embedding_dedup import forest

WIDTH = 5
THRESHOLD = (4, 5)  # a similarity of 4/5
TREES = 20
#: Hashes in a signature per tree: the longest prefix.
DEEPEST = 6
#: Least chance of a pair at the threshold to be met by the shortest prefix.
RECALL = 0.9999
#: Links that may be expected lost in a table that is matched by longer prefixes.
LOST = 0.001
#: Signatures that agree in a smaller share are no link: 3 standard errors below the threshold.
UNLIKE = 0.69
#: Classes in a block of a shared prefix, about.
BLOCK = 256

log = logging.getLogger(__name__)

_STEP = np.uint64(0x9E3779B97F4A7C15)


def met(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """The chance that a pair shares a prefix of this length in a tree or more."""
    return 1 - (1 - similarity ** depth) ** trees


def prefix_depth(trees: int = TREES, deepest: int = DEEPEST, similarity: float = 0.8, recall: float = RECALL) -> int:
    """The longest prefix, shortened from ``deepest``, that keeps the recall."""
    depth = deepest
    while depth > 1 and met(similarity, depth, trees) < recall:
        depth -= 1
    return depth


def expected_loss(agreements: np.ndarray, depth: int, trees: int, deepest: int) -> tuple[float, float]:
    """(links expected lost, recall) when prefixes of ``depth`` are matched in all trees.
    ``agreements[a]`` counts the pairs met by the first tree's whole paths whose
    signatures agree in ``a`` hashes."""
    share = np.arange(len(agreements)) / (len(agreements) - 1)
    low = THRESHOLD[0] / THRESHOLD[1]
    near = np.maximum(share, low)
    pairs = np.where(share >= UNLIKE, agreements, 0) / near ** deepest
    lost = float((pairs * (1 - met(near, depth, trees))).sum() + 1 - met(low, depth, trees))
    return lost, 1 - lost / (float(pairs.sum()) + 1)


_word_hash = Remembered(xxhash.xxh3_64_intdigest, 50_000)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word windows."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    size = min(width, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i:i + n]) * _STEP
        out ^= out >> np.uint64(29)
    return np.unique(out)


GROUP = ("tree", "key", "i", "j")
_TICKET = pa.schema([("tree", pa.int32()), ("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("b", pa.int32()),
                     ("cls", pa.int64()), ("agree", pa.int32()), ("pairs", pa.int64())])


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    return random.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), random.integers(
        0, 1 << 63, n, dtype=np.uint64)


def signature(items: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """MinHash: the upper halves of the smallest value under each hash."""
    a, b = family
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 256):  # bounded memory for long texts, and within the CPU's cache
        x = items[at:at + 256, None] * a
        x += b
        np.minimum(low, x.min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def new_pairs(s: np.ndarray, trees: int, tree: int, depth: int, first: np.ndarray, second: np.ndarray | None):
    """Pairs of signature rows that agree in half their hashes or more and share a prefix
    of this depth in this tree first; among ``first``, or of first with second. And
    the number of hashes that agree."""
    same = second is None
    q = first if same else second
    deepest = s.shape[1] // trees
    left, right, agree = [], [], []
    for at in range(0, len(first), 64):
        p = first[at:at + 64]
        eq = s[p][:, None, :] == s[q][None, :, :]
        total = eq.sum(2)
        i, j = np.nonzero((total * 2 >= s.shape[1]) & eq[:, :, tree * deepest:tree * deepest + depth].all(2))
        if same:
            i, j = i[p[i] < q[j]], j[p[i] < q[j]]
        path = eq[i, j].reshape(len(i), trees, deepest)
        ok = ~path[:, :tree, :depth].all(2).any(1)
        i, j = i[ok], j[ok]
        left.append(p[i])
        right.append(q[j])
        agree.append(total[i, j])
    return np.concatenate(left), np.concatenate(right), np.concatenate(agree)


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """|A & B| for the given pairs."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                         for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    every, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = np.flatnonzero(times > 1)
    column = np.full(len(every), -1)
    column[shared] = np.arange(len(shared))
    column = column[inverse]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, len(shared), 4096):
        low, high = np.searchsorted(column, (at, at + 4096))
        block = np.zeros((len(sets), min(4096, len(shared) - at)), np.float32)
        block[owner[low:high], column[low:high] - at] = 1
        total += block @ block.T
    return total[i, j].astype(np.int64)


def _members(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cls = np.array([m["cls"] for m in rows], np.int64)
    side = np.array([m["b"] for m in rows], np.int64)
    return cls, side, np.stack([np.frombuffer(m["sig"], np.uint32) for m in rows])


def _sides(side: np.ndarray, i: int, j: int):
    return np.flatnonzero(side == i), None if i == j else np.flatnonzero(side == j)


def forest_depth(classes: DataFrame, trees: int, deepest: int, recall: float, block: int) -> tuple[int, float]:
    """The length of prefixes that the classes (cls, sig) are matched by, and the recall expected."""
    met_pairs = saved(_level(classes, trees, 1, deepest, block).where("cls is null"), "agreements")
    agreements = np.zeros(trees * deepest + 1, np.int64)
    for r in met_pairs.groupBy("agree").agg(F.sum("pairs").alias("pairs")).collect():  # a row per hash at most
        agreements[r["agree"]] = r["pairs"]
    depth, last = deepest, prefix_depth(trees, deepest, THRESHOLD[0] / THRESHOLD[1], recall)
    while depth > last and expected_loss(agreements, depth, trees, deepest)[0] > LOST:
        depth -= 1
    lost, reached = expected_loss(agreements, depth, trees, deepest)
    log.info("forest: %d pairs in the first tree, prefixes of %d hashes, %.3g links expected lost, recall %.7f",
             agreements.sum(), depth, lost, reached)
    return depth, reached


def _tickets(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_TICKET)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _TICKET, strict=True)], schema=_TICKET)


def _level(classes: DataFrame, trees: int, used: int, depth: int, block: int) -> DataFrame:
    """Tickets (tree, key, i, j, b, cls) of the classes that have a pair in a group of
    classes which share a prefix of one of the ``used`` first trees, and rows without
    a class, a few per task, that count the pairs by agreement."""
    path = 4 * (F.length("sig") / F.lit(4 * trees)).cast("int")
    keys = F.transform(F.sequence(F.lit(0), F.lit(used - 1)), lambda t: F.xxhash64(t, F.substring("sig", t * path + 1, F.lit(4 * depth))))
    leaves = classes.select("cls", F.posexplode(keys).alias("tree", "key"))
    nodes = leaves.groupBy("tree", "key").agg(F.count("*").alias("m")).where("m > 1")
    inside = (leaves.join(nodes, ["tree", "key"])
              .withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
              .withColumn("b", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("blocks")).cast("int"))
              # one group for each pair of blocks (i <= j) that the member's block is in
              .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("tree", "key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "cls"))

    def meet(batches):
        agreements = Counter()
        for batch in batches:
            out: list[tuple] = []
            for row in range(batch.num_rows):  # one group at a time
                r = batch.slice(row, 1).to_pylist()[0]
                cls, side, s = _members(r["members"])
                first, second = _sides(side, r["i"], r["j"])
                if len(first) and (second is None or len(second)):
                    p, q, agree = new_pairs(s, trees, r["tree"], depth, first, second)
                    out += [(r["tree"], r["key"], r["i"], r["j"], int(side[x]), int(cls[x]), None, None)
                            for x in np.unique(np.concatenate([p, q]))]
                    agreements.update(agree.tolist())
            yield _tickets(out)
        yield _tickets([(*[None] * 6, a, n) for a, n in agreements.items()])

    return (inside.join(classes.select("cls", "sig"), "cls").groupBy(*GROUP)
            .agg(F.collect_list(F.struct("cls", "b", "sig")).alias("members"))
            .mapInArrow(meet, "tree int, key long, i int, j int, b int, cls long, agree int, pairs long"))


def jaccard_links(docs: DataFrame, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL,
                  block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, copies, n_links, class_id) of every document row."""
    return _links(docs, trees, deepest, recall, block).drop("text_hash", "group")


def _links(docs: DataFrame, trees: int, deepest: int, recall: float, block: int) -> DataFrame:
    """The same with ``text_hash``, which tells rows of one id apart, and ``group``, which
    tells classes apart that share their smallest id (null without shingles)."""
    family = hash_family(trees * deepest)

    def sign(_, doc_id, text, text_hash):
        items = shingles(text)
        if doc_id is None or not len(items):
            return doc_id, text_hash, None, len(items), None
        raw = items.tobytes()
        return doc_id, text_hash, xxhash.xxh3_64_intdigest(raw) - (1 << 63), len(items), signature(items, family).tobytes()

    signed = saved(map_texts(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), ["doc_id", "text", "text_hash"],
                             sign, "doc_id long, text_hash long, cls long, n_shingles int, sig binary"), "signatures")
    classes = saved(signed.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "classes")

    depth, _ = forest_depth(classes, trees, deepest, recall, block)
    tickets = saved(_level(classes, trees, trees, depth, block).where("cls is not null").select(*GROUP, "b", "cls"), "tickets")

    # Shingle sets, for classes that hold a ticket.
    wanted = classes.join(tickets.select("cls").distinct(), "cls", "left_semi")

    def spell(_, text, cls, copies, sig):
        items = shingles(text)
        if xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63) != cls:
            items = items[:0]  # another row with the same id: not this class's text
        return cls, copies, sig, items.tobytes()

    sets = (map_texts(docs.select("doc_id", "text").join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id"),
                      ["text", "cls", "copies", "sig"], spell, "cls long, copies long, sig binary, items binary")
            .where("length(items) > 0").dropDuplicates(["cls"]))

    def verify(batches):
        for batch in batches:
            for row in range(batch.num_rows):  # one group at a time: its sets may be large
                r = batch.slice(row, 1).to_pylist()[0]
                cls, side, s = _members(r["members"])
                copies = np.array([m["copies"] for m in r["members"]], np.int64)
                sets = [np.frombuffer(m["items"], np.uint64) for m in r["members"]]
                first, second = _sides(side, r["i"], r["j"])
                if not len(first) or second is not None and not len(second):
                    continue
                p, q, _ = new_pairs(s, trees, r["tree"], depth, first, second)
                size = np.array([len(x) for x in sets], np.int64)
                both = intersections(sets, p, q)
                near = both * THRESHOLD[1] >= (size[p] + size[q] - both) * THRESHOLD[0]
                p, q = p[near], q[near]
                total = np.bincount(p, copies[q], minlength=len(cls)) + np.bincount(q, copies[p], minlength=len(cls))
                at = np.flatnonzero(total)
                links = forest(p, q)
                yield pa.RecordBatch.from_arrays([
                    pa.array([*cls[at].tolist(), *(int(cls[a]) for a, _ in links)], pa.int64()),
                    pa.array([*[None] * len(at), *(int(cls[b]) for _, b in links)], pa.int64()),
                    pa.array([*total[at].astype(np.int64).tolist(), *[0] * len(links)], pa.int64())], ["cls", "other", "links"])

    found = saved(
        tickets.join(sets, "cls").groupBy(*GROUP)
        .agg(F.collect_list(F.struct("cls", "b", "sig", "copies", "items")).alias("members"))
        .mapInArrow(verify, "cls long, other long, links long"), "links")
    counts = found.where("other is null").groupBy("cls").agg(F.sum("links").alias("links"))
    names = classes.select("cls", "rep", "copies")
    # Components of classes, each named by the smallest id in it: an id may be in several.
    groups = components(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")), "jaccard-components")
    groups = groups.select(F.col("node").alias("cls"), F.col("component").alias("group"))
    lowest = groups.join(names, "cls").groupBy("group").agg(F.min("rep").alias("low"))
    groups = groups.join(lowest, "group")
    per_class = (names.join(counts, "cls", "left").join(groups, "cls", "left")
                 .select("cls", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                         F.coalesce("group", "cls").alias("group"), F.coalesce("low", "rep").alias("class_id")))
    return signed.select("doc_id", "text_hash", "cls", "n_shingles").join(per_class, "cls", "left").select(
        "doc_id", "text_hash", "group", "n_shingles", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns, one row of each class: the one with the smallest
    id (of several texts with that id, the one with the smallest hash; of rows
    that repeat id and text, one). Rows without an id or without words stay."""
    rows = _links(docs, TREES, DEEPEST, RECALL, BLOCK).where("group is not null")
    texts = saved(rows.groupBy("doc_id", "text_hash").agg(F.min("group").alias("group"), F.count("*").alias("rows")), "class-texts")
    first = texts.groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    verdicts = saved(few_files(texts.join(first, "group").select(
        "doc_id", "text_hash", "rows", (F.struct("doc_id", "text_hash") == F.col("first")).alias("stays")), texts.count()), "class-verdicts")
    gone_id, gone_text, own_text = unused(docs, "gone_id", "gone_text", "own_text")

    def those(which: str) -> DataFrame:
        return verdicts.where(which).select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_text))

    keyed = docs.withColumn(own_text, F.xxhash64("text"))
    same = (F.col("doc_id") == F.col(gone_id)) & (F.col(own_text) == F.col(gone_text))
    kept = keyed.join(those("not stays"), same, "left_anti")
    if verdicts.where("stays and rows > 1").limit(1).count():  # rows that repeat: one of each
        again = those("stays and rows > 1")
        one = (kept.join(again, same, "left_semi").groupBy("doc_id", own_text)
               .agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(gone_id)).select(f"{gone_id}.*"))
        return kept.join(again, same, "left_anti").select(*docs.columns).unionByName(one)
    return kept.select(*docs.columns)
