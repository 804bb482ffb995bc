"""Near-duplicate vectors: all pairs of equal label with cosine >= threshold.

On unit vectors cosine >= c means distance <= sqrt(2 - 2c). Per label the
vectors are nested in a cover tree: each node has a centre, a covering radius
about half its parent's, and children that cover its members. Two trees (or
one with itself) are walked together; a pair of nodes whose centres are
further apart than both radii and the threshold is dropped with everything
below it, small surviving pairs are compared in double precision. The bounds
are those of the triangle inequality, so the pairs are exact.

Spread over the cluster: the top of the tree, some centres of a bounded sample
per label, is joined by label; every vector goes to its nearest centre, whose
radius is then taken over all its members. Cells are cut into blocks of bounded size
by a hash, the dual walk over the top level names the pairs of cells that may
hold a link, and each pair of blocks is one group of rows (a hot label or cell
is many blocks). Groups return counts per vector and a spanning forest of
their links, never all pairs. Equal vectors are one row with a count first.

Defined results: a vector that is null, empty, zero, or holds null, NaN or
infinite components, or has a null label, links with nothing and is its own
component; vectors of other lengths never link; rows that repeat an id and
vector are one vector, and of rows with the same id and different vectors each
counts; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerflow.llm.common import saved
from offerflow.llm.components import components

#: Vectors of a label that the top centres are chosen from, at most.
SAMPLE = 2000
#: Vectors in a block, about.
BLOCK = 1000
#: Below this many pairs, a pair of nodes is compared outright.
SMALL = 4096


def cover_tree(x: np.ndarray, members: np.ndarray, centre: int, radius: float, least: float):
    """(centre, radius, members, children): children cover the members with
    about half the radius; a node of radius <= least or few members is a leaf."""
    if len(members) <= 24 or radius <= least:
        return centre, radius, members, []
    children, left, half = [], members, radius / 2
    first = centre
    while len(left):
        gap = np.sqrt(np.maximum(((x[left] - x[first]) ** 2).sum(1), 0))
        inside = gap <= half
        mine = left[inside]
        children.append(cover_tree(x, mine, first, float(gap[inside].max()), least))
        left = left[~inside]
        if len(left):
            first = int(left[0])
        if len(children) == 1 and not len(left):  # all lie within half the radius: this level is empty
            return children[0]
    return centre, radius, members, children


def dual_walk(x: np.ndarray, y: np.ndarray, limit: float, same: bool, found) -> None:
    """Call found(i, j) with index arrays of x and y (i < j if same) for blocks
    of pairs that the bounds cannot drop; every pair within limit is in one."""
    if not len(x) or not len(y):
        return

    def tree(v):
        gap = np.sqrt(np.maximum(((v - v[0]) ** 2).sum(1), 0))
        return cover_tree(v, np.arange(len(v)), 0, float(gap.max()), limit / 4)

    a = tree(x)
    b = a if same else tree(y)
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        itself = same and a is b
        if not itself and math.sqrt(max(0.0, float(((x[a[0]] - y[b[0]]) ** 2).sum()))) > a[1] + b[1] + limit:
            continue
        if len(a[2]) * len(b[2]) <= SMALL or not (a[3] or b[3]):
            found(a[2], b[2], itself)
        elif itself:
            for n, child in enumerate(a[3]):
                todo.append((child, child))
                todo += pruned(x, x, child, a[3][n + 1:], limit)
        elif not b[3] or a[3] and a[1] >= b[1]:
            todo += [(child, other) for child, other in ((c, b) for c in a[3])]
        else:
            todo += pruned(x, y, a, b[3], limit)


def pruned(x, y, node, others, limit):
    """The pairs of a node with those of ``others`` that its bound leaves, in one array step."""
    if not others:
        return []
    at = np.array([o[0] for o in others])
    reach = np.array([o[1] for o in others]) + node[1] + limit
    near = ((y[at] - x[node[0]]) ** 2).sum(1) <= reach ** 2
    return [(node, others[i]) for i in np.flatnonzero(near)]


def links_between(x: np.ndarray, y: np.ndarray, cosine: float, same: bool):
    """Index arrays (i, j) of all pairs with cosine >= the threshold, exact."""
    left, right = [], []
    limit = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    # times a power of two: exact, and no square leaves the range of doubles
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0))[1][:, None]) for v in (x, y))
    ux, uy = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)

    def found(i, j, itself):
        near = np.argwhere(ux[i] @ uy[j].T >= cosine - 1e-9)
        if len(near):
            p, q = i[near[:, 0]], j[near[:, 1]]
            exact = (x[p] * y[q]).sum(1) / (nx[p] * ny[q]) >= cosine
            if itself:
                exact &= p < q
            left.append(p[exact])
            right.append(q[exact])

    dual_walk(ux, uy, limit, same, found)
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(left), np.concatenate(right)


def forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (union-find)."""
    parent: dict[int, int] = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return out


def top_centres(classes: DataFrame, sample: int, cells: int) -> DataFrame:
    """(label, dim, net): at most ``cells`` centres per label and vector length,
    a farthest-first net over a bounded sample of its vectors."""
    order = Window.partitionBy("label", "dim").orderBy(F.xxhash64("cls"))
    few = classes.select("label", "dim", "cls", "v").withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample)

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        net = _net(np.stack(f["v"].to_numpy()), cells)
        return pd.DataFrame({"label": f["label"][:1].to_numpy(), "dim": f["dim"][:1].to_numpy(), "net": [net.tolist()]})

    return few.groupBy("label", "dim").applyInPandas(choose, "label long, dim int, net array<array<double>>")


def _net(x: np.ndarray, cells: int) -> np.ndarray:
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    u = u[np.lexsort(u.T)]
    chosen, gap = [0], ((u - u[0]) ** 2).sum(1)
    while len(chosen) < cells and gap.max() > 0.25:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((u - u[chosen[-1]]) ** 2).sum(1))
    return u[chosen]


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, cells: int = 8, block: int = BLOCK,
                    sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("v"))
    good = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False))
            & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
            & F.exists("v", lambda c: c != 0))
    good = F.coalesce(good, F.lit(False))
    # Times a power of two, in two steps as it may pass the range of doubles itself: cosines stay as they are.
    power = F.floor(F.log2(F.array_max(F.transform("v", F.abs)))).cast("int")
    rows = rows.withColumn("power", F.when(good, power)).select(
        "vec_id", "label", F.when(good, F.transform("v", lambda c: c * F.expr("pow(2D, -(power div 2))") * F.expr(
            "pow(2D, -(power - power div 2))"))).alias("v"))
    good = F.col("v").isNotNull()
    alive = rows.where(good).distinct()
    classes = saved(alive.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
                    .withColumn("dim", F.size("v")), "vectors")
    # Rows of one class share the class's links; a representative is named by class, as ids may repeat over classes.
    classes = classes.withColumn("cls", F.xxhash64("label", "v"))
    # Nearest centre and distance of each vector to it; nothing label-sized is collected.
    tops = saved(top_centres(classes, sample, cells), "centres")
    unit = F.transform("v", lambda c: c / F.col("length"))
    dots = F.transform("net", lambda c: F.aggregate(
        F.zip_with(c, F.col("unit"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    placed = saved(
        classes.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, c: t + c * c)))
        .withColumn("unit", unit).join(tops, ["label", "dim"]).withColumn("dots", dots)
        .withColumn("cell", (F.array_position("dots", F.array_max("dots")) - 1).cast("int"))
        .withColumn("gap", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.array_max("dots"))))
        .withColumn("h", F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(1 << 30)))
        .select("label", "dim", "cls", "copies", "rep", "v", "cell", "gap", "h"), "cells")
    # The walk over the top level: pairs of cells that the radius over all members does not rule out.
    limit = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    own = (placed.groupBy("label", "dim", "cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n"))
           .join(tops, ["label", "dim"]).select("label", "dim", F.col("cell").alias("c"), F.col("radius").alias("rc"),
                                                F.ceil(F.col("n") / block).cast("int").alias("bc"),
                                                F.element_at("net", F.col("cell") + 1).alias("vc")))
    other = own.select("label", "dim", F.col("c").alias("d"), F.col("rc").alias("rd"), F.col("bc").alias("bd"), F.col("vc").alias("vd"))
    apart = F.sqrt(F.aggregate(F.zip_with("vc", "vd", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    pairs = saved(own.join(other, ["label", "dim"]).where("c <= d").where(
        (F.col("c") == F.col("d")) | (apart <= F.col("rc") + F.col("rd") + limit)).select("label", "dim", "c", "d", "bc", "bd"),
        "cell-pairs")
    # Each vector goes to every pair of blocks that may hold a partner of it.
    cols = ["label", "dim", "c", "d", "i", "j"]
    base = placed.select("label", "dim", "cell", "h", "cls", "copies", "v")
    left = (base.withColumnRenamed("cell", "c").join(pairs, ["label", "dim", "c"])
            .withColumn("i", F.expr("cast(h % bc as int)"))
            .withColumn("j", F.explode(F.expr("case when c = d then sequence(i, bd - 1) else sequence(0, bd - 1) end")))
            .select(*cols, F.lit(0).alias("side"), "cls", "copies", "v"))
    right = (base.withColumnRenamed("cell", "d").join(pairs, ["label", "dim", "d"])
             .withColumn("j", F.expr("cast(h % bd as int)")).where("c <> d or j > 0")
             .withColumn("i", F.explode(F.expr("case when c = d then sequence(0, j - 1) else sequence(0, bc - 1) end")))
             .select(*cols, F.lit(1).alias("side"), "cls", "copies", "v"))

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        c, d, i, j = (int(f[k].iloc[0]) for k in ("c", "d", "i", "j"))
        same = c == d and i == j
        side = f["side"].to_numpy()
        p = np.flatnonzero(side == 0)
        q = p if same else np.flatnonzero(side == 1)
        cls, copies = f["cls"].to_numpy(), f["copies"].to_numpy()
        if not len(p) or not len(q):
            return pd.DataFrame({"cls": pd.array([], "Int64"), "other": pd.array([], "Int64"), "links": pd.array([], "Int64")})
        v = f["v"].to_numpy()
        x, y = np.stack(v[p]), np.stack(v[q])
        a, b = links_between(x, y, cosine, same)
        counts: dict[int, int] = {}
        for own, other in ((p[a], q[b]), (q[b], p[a])):
            total = np.bincount(own, copies[other], minlength=len(f))
            for at in np.flatnonzero(total):
                counts[at] = counts.get(at, 0) + int(total[at])
        links = forest(p[a], q[b])
        return pd.DataFrame({  # nullable integers: floats would lose digits of the ids
            "cls": pd.array([*(int(cls[k]) for k in counts), *(int(cls[e[0]]) for e in links)], "Int64"),
            "other": pd.array([*[None] * len(counts), *(int(cls[e[1]]) for e in links)], "Int64"),
            "links": pd.array([*counts.values(), *[0] * len(links)], "Int64")})

    found = saved(left.unionByName(right).groupBy(*cols).applyInPandas(
        compare, "cls long, other long, links long"), "vector-links")
    counts = found.where("other is null").groupBy("cls").agg(F.sum("links").alias("links"))
    names = placed.select("cls", "rep", "copies")
    # Component ids are smallest ids, so links are carried over to representatives.
    edges = (found.where("other is not null").select("cls", "other").join(names.select("cls", F.col("rep").alias("a")), "cls")
             .join(names.select(F.col("cls").alias("other"), F.col("rep").alias("b")), "other").select("a", "b"))
    groups = components(edges, "vector-components")
    per_class = (names.join(counts, "cls", "left").join(groups, F.col("rep") == F.col("node"), "left")
                 .select("cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                         F.coalesce("component", "rep").alias("component_id")))
    linked = (rows.withColumn("cls", F.when(good, F.xxhash64("label", "v"))).select("vec_id", "cls")
              .join(per_class, "cls", "left"))
    out = linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
