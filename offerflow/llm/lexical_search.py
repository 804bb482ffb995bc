"""Ranked lexical search: many items against all documents, shared terms once.

Items are searched in blocks. For a block, term sets that several items share are
mined: first terms that occur in exactly the same items (with the same
repeats) become one atom; then, again and again, the two symbols that most items
hold together become a new symbol, until no two are shared. The result is a
directed acyclic graph from atoms over shared sums to items. Per batch of documents
each node's accumulator (the partial score of every document) is computed once,
from its two parts, and every item adds up the few nodes it is left with.

Documents are read once per block: a pass writes each document's length and the
block's terms in it; counts over that table give the collection's statistics; a
second pass evaluates the graph and keeps the best documents of each item
per task, which Spark ranks in two levels. Only the block's graph and document
frequencies, both bounded by the block, reach the driver and the tasks.

Defined results: words are maximal runs of ASCII letters and digits and all
characters beyond ASCII, A-Z lower-cased; null and empty texts have none and do
not count as documents; a term's weight and a document's part of it follow the
formulas in ``weights`` and ``parts``; documents that repeat an id rank each; a
null id comes after others of equal score; items that repeat an id are searched each
and get the same rows each; an item without a hit has no rows; other columns are
not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerflow.llm.common import saved

TOP = 10
#: Terms (with repeats of items) in a block of items, about; an item is never cut.
BLOCK_TERMS = 100_000
#: Accumulator entries (nodes x documents) that a task holds at a time, about.
HELD = 4_000_000
#: Document bounds of the saturation: 100 - B + B * length / mean length, in hundredths.
B = 75

_SPLIT = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
               for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SPLIT).split()


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1)))."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m = 100 - B + (B n N) div L; Python's integers, as the product may pass 64 bits."""
    return np.array([100 - B + B * x * n_docs // n_terms for x in n.tolist()], np.int64)


def parts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 8 m))."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


# ---- the graph of shared term sets

@dataclass
class Graph:
    """Atoms 0..n-1, then one node per pair (a, b); rows of items are sums of nodes."""

    terms: list[bytes]
    atom: np.ndarray       # per (term, times) entry: its atom
    term: np.ndarray       # its term
    times: np.ndarray      # how often the items of the atom repeat it
    atoms: int
    pairs: list[tuple[int, int]]
    items: list[list[int]]  # per item: its nodes


def mine(texts: list[list[bytes]], rounds: int | None = None) -> Graph:
    """Shared term sets of a block of items. ``rounds`` bounds the pairs that are
    made (less sharing, same sums)."""
    held: dict[tuple[bytes, int], list[int]] = defaultdict(list)
    for i, t in enumerate(texts):
        for entry in sorted(Counter(t).items()):
            held[entry].append(i)
    terms = sorted({t for t, _ in held})
    number = {t: k for k, t in enumerate(terms)}
    atoms: dict[tuple[int, ...], int] = {}
    entry_atom, entry_term, entry_times = [], [], []
    for (t, times), who in held.items():
        entry_atom.append(atoms.setdefault(tuple(who), len(atoms)))
        entry_term.append(number[t])
        entry_times.append(times)
    items: list[set[int]] = [set() for _ in texts]
    who_has: dict[int, set[int]] = {}
    for who, a in atoms.items():
        who_has[a] = set(who)
        for i in who:
            items[i].add(a)

    # Greedy pairs: a heap of (-items that hold both, a, b), counts made true when popped.
    heap: list[tuple[int, int, int]] = []

    def offer(a: int, others) -> None:
        near = Counter()
        for i in who_has[a]:
            near.update(others(i, a))
        for b, n in near.items():
            if n > 1:
                heapq.heappush(heap, (-n, min(a, b), max(a, b)))

    shared = [a for a, who in who_has.items() if len(who) > 1]
    for a in shared:
        offer(a, lambda i, x: (b for b in items[i] if b < x and len(who_has[b]) > 1))
    pairs: list[tuple[int, int]] = []
    new = len(atoms)
    while heap and (rounds is None or len(pairs) < rounds):
        n, a, b = heapq.heappop(heap)
        both = who_has[a] & who_has[b]
        if len(both) < 2:
            continue
        if len(both) < -n:
            heapq.heappush(heap, (-len(both), a, b))
            continue
        pairs.append((a, b))
        who_has[new] = both
        for x in (a, b):
            who_has[x] = who_has[x] - both
        for i in both:
            items[i] -= {a, b}
            items[i].add(new)
        offer(new, lambda i, x: (b for b in items[i] if b != x and len(who_has[b]) > 1))
        new += 1
    return Graph(terms, np.array(entry_atom, np.int64), np.array(entry_term, np.int64), np.array(entry_times, np.int64),
                 len(atoms), pairs, [sorted(s) for s in items])


def evaluate(graph: Graph, doc: np.ndarray, term: np.ndarray, part: np.ndarray, docs: int) -> np.ndarray:
    """Scores [item][document] from postings (document, term, part of one occurrence)."""
    nodes = np.zeros((graph.atoms + len(graph.pairs), docs), np.int64)
    # entries of a term are adjacent in this order
    order = np.argsort(graph.term, kind="stable")
    first = np.searchsorted(graph.term[order], np.arange(len(graph.terms) + 1))
    n = np.diff(first)[term]
    post = np.repeat(np.arange(len(term)), n)
    entry = order[first[term[post]] + np.arange(len(post)) - np.repeat(np.cumsum(n) - n, n)]
    np.add.at(nodes.reshape(-1), graph.atom[entry] * docs + doc[post], part[post] * graph.times[entry])
    for k, (a, b) in enumerate(graph.pairs, graph.atoms):
        np.add(nodes[a], nodes[b], out=nodes[k])
    out = np.zeros((len(graph.items), docs), np.int64)
    for row, own in zip(out, graph.items, strict=True):
        for k in own:
            row += nodes[k]
    return out


# ---- Spark

_POST = "doc_id long, n long, terms binary, tfs binary"


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) per document that has a word: its length, and numbers
    and counts of the given terms in it (little-endian 32-bit)."""

    def run(batches):
        number = {t: k for k, t in enumerate(terms)}
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            out = [[], [], [], []]
            for doc_id, text in zip(ids, texts, strict=True):
                found = words(text)
                if found:
                    tf = Counter(k for k in map(number.get, found) if k is not None)
                    out[0].append(doc_id)
                    out[1].append(len(found))
                    out[2].append(np.fromiter(tf.keys(), "<u4", len(tf)).tobytes())
                    out[3].append(np.fromiter(tf.values(), "<u4", len(tf)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _POST)


def _frequencies(found: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of the block's terms."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            raw = b"".join(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(raw, "<u4"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in found.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


class _Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.item, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, doc: np.ndarray) -> None:
        i, d = np.nonzero(scores >= self.least[:, None])
        self.item = np.concatenate([self.item, i])
        self.doc = np.concatenate([self.doc, doc[d]])
        self.score = np.concatenate([self.score, scores[i, d]])
        order = np.lexsort((self.doc, -self.score, self.item))
        start = np.searchsorted(self.item[order], np.arange(len(self.least)))
        place = np.arange(len(order)) - start[self.item[order]]
        order = order[place < self.top]
        self.item, self.doc, self.score = self.item[order], self.doc[order], self.score[order]
        full = self.item[np.flatnonzero(place[place < self.top] == self.top - 1)]
        self.least[full] = self.score[place[place < self.top] == self.top - 1]


_NULL_ID = np.iinfo(np.int64).max  # ranks after every other id


def _ranked(found: DataFrame, graph: Graph, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc_id, score): the best documents of each item per task."""
    weight = weights(_frequencies(found, len(graph.terms)), n_docs)
    shipped = found.sparkSession.sparkContext.broadcast((graph, weight))
    step = max(1, HELD // max(1, graph.atoms + len(graph.pairs) + len(graph.items)))

    def run(batches):
        graph, weight = shipped.value
        best = _Best(len(graph.items), top)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                doc_ids = b.column(0).fill_null(_NULL_ID).to_numpy()
                m = lengths(b.column(1).to_numpy(), n_docs, n_terms)
                terms = [np.frombuffer(x, "<u4") for x in b.column(2).to_pylist()]
                doc = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
                term = np.concatenate(terms).astype(np.int64)
                tf = np.frombuffer(b"".join(b.column(3).to_pylist()), "<u4").astype(np.int64)
                best.add(evaluate(graph, doc, term, parts(weight[term], tf, m[doc]), len(terms)), doc_ids)
        ids = pa.array(best.doc, pa.int64(), mask=best.doc == _NULL_ID)
        yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int64()), ids, pa.array(best.score, pa.int64())],
                                         ["item", "doc_id", "score"])

    return found.mapInArrow(run, "item long, doc_id long, score long")


def _best(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def blocks_of(items: DataFrame, block_terms: int) -> DataFrame:
    """Items with the number of their block: neighbours in a slice of the table, up to so many terms."""

    def cut(batches):
        total, block, task = 0, 0, None
        for batch in batches:
            out: list[list] = [[], [], []]
            for item_id, text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = len(words(text))
                if total and total + size > block_terms:
                    block, total = block + 1, 0
                total += size
                out[0].append((part << 32) + block)
                out[1].append(item_id)
                out[2].append(text)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                out, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["block", "item_id", "text"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text", F.spark_partition_id().cast("long").alias("part")
                        ).mapInArrow(cut, "block long, item_id long, text string")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents with a score above 0 of every item."""
    blocks = saved(blocks_of(items, block_terms), "search-items")
    names = [r["block"] for r in blocks.select("block").distinct().collect()]  # one number per block
    out = None
    for name in sorted(names):
        own = blocks.where(F.col("block") == name).select("item_id", "text").collect()  # bounded by the block
        graph = mine([words(r["text"]) for r in own])
        found = saved(postings(docs, graph.terms), "search-postings")
        size = found.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        best = _ranked(found, graph, int(size["docs"]), int(size["terms"] or 0), top)
        # two levels, so that one item's rows of all tasks do not meet in one
        best = _best(_best(best.withColumn("part", F.spark_partition_id() % 64), ["item", "part"], top).drop("rank"), ["item"], top)
        ids = docs.sparkSession.createDataFrame(
            pd.DataFrame({"item": range(len(own)), "item_id": pd.array([r["item_id"] for r in own], "Int64")}), "item long, item_id long")
        rows = best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
