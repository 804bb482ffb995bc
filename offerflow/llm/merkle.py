"""Merkle manifest of a dataset, with a proof for every row.

A row's leaf is the SHA-256 of its fields, each ``-`` if null, else its UTF-8
length, ``:`` and the value. The leaves of a source, in order of their ids, are
hashed together ``ARITY`` by ``ARITY``, level after level, up to the source's subroot;
the subroots, in order of the sources, likewise give the root. Digests enter a
hash as hex text.

Proofs come from pointer jumping. Every node starts with one segment, its
siblings on the way to its parent. Each round joins the nodes with themselves:
a node appends the segments of the ancestor it points at and then points as far
again, so the distance doubles and the number of rounds is the logarithm of the
height. After the round of distance d only levels that are multiples of d are
pointed at, so the ancestors' side shrinks as the segments grow. The children of a
subroot also get their source's segments through the upper tree, so a leaf that
reaches its subroot has reached the root.

Numbering the leaves takes no task per source: rows are range-partitioned by
(source, id), numbered inside their partition, and shifted by the counts of the
partitions before. High ancestors are few (a count is checked before one is
broadcast); low ones have few leaves each, so no join key is hot. Every level and
round is written to the shared folder.

Defined results: a null source is a source of its own, before the others; null ids
stand first, rows that share an id are ordered by their leaves and each have a
proof; a lone row's leaf is its source's subroot, a lone subroot the root, with an
empty proof; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerflow.llm.common import bounded, saved

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a side that is broadcast, at most.
FEW = 20_000


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(binary: Column | str) -> Column:
    return F.lower(F.hex(binary))


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields."""

    def framed(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return digest(*map(framed, fields))


def numbered(rows: DataFrame, order: Sequence[str], tag: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0, within ``g``, in the given order) and ``size`` (rows of ``g``)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["g", *order, "tie"]  # the tie spreads rows that repeat
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = saved(ranged.drop("tie").select("*", F.spark_partition_id().alias("part"),
                                             F.monotonically_increasing_id().alias("at")), tag)
    counts = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of_g = Window.partitionBy("g")  # a row per partition that holds a part of g
    before = F.sum("n").over(of_g.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("g", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
                           F.sum("n").over(of_g).alias("size"))
    return placed.join(bounded(shifts, FEW), ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop(
        "part", "at", "shift")


def build(leaves: DataFrame, tag: str, arity: int = ARITY) -> tuple[DataFrame, DataFrame, int]:
    """(steps, tops, levels) of one tree per ``g``; leaves: g, pos, size, digest, item.

    steps: one row per node below a top: g, level, pos, digest, item, its siblings
    to the left and right, the parent's pos, and whether the parent is the top."""
    now = saved(leaves.select("g", "pos", "size", "digest", "item"), f"{tag}-leaves")
    nothing = F.lit(None).cast(now.schema["item"].dataType)
    tops, steps, level = [now.where("size = 1")], [], 0
    while now.where("size > 1").limit(1).count():
        runs = (now.where("size > 1").groupBy("g", F.floor(F.col("pos") / arity).alias("up"))
                .agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("pos", "digest", "item"))).alias("kids")))
        runs = saved(runs, f"{tag}-runs")
        digests = F.col("kids.digest")
        join = lambda a: F.aggregate(a, F.unhex(F.lit("")), lambda x, y: F.concat(x, y))
        steps.append(runs.select("g", "up", "size", digests.alias("ds"), F.posexplode("kids").alias("i", "kid")).select(
            "g", F.lit(level).alias("level"), "kid.pos", "kid.digest", "kid.item", F.col("up"),
            join(F.slice("ds", F.lit(1), F.col("i"))).alias("left"),
            join(F.slice("ds", F.col("i") + 2, F.lit(arity))).alias("right"), (F.col("size") <= arity).alias("last")))
        now = runs.select("g", F.col("up").alias("pos"), F.ceil(F.col("size") / arity).alias("size"),
                          digest(F.array_join(F.transform("kids.digest", hexed), "")).alias("digest"), nothing.alias("item"))
        tops.append(now.where("size = 1"))
        level += 1
    every = steps or [now.where("size < 1").select(
        "g", F.lit(0).alias("level"), "pos", "digest", "item", F.col("pos").alias("up"), F.col("digest").alias("left"),
        F.col("digest").alias("right"), F.lit(True).alias("last"))]
    out, top = every[0], tops[0]
    for s in every[1:]:
        out = out.unionByName(s)
    for t in tops[1:]:
        top = top.unionByName(t)
    return out, top.select("g", "digest", "item"), level


_SEGMENT = "array<struct<left:binary,right:binary>>"


def climb(steps: DataFrame, tops: DataFrame, levels: int, tails: DataFrame | None, tag: str) -> DataFrame:
    """(digest, item, top, path) of every leaf: the segments to its tree's top, then
    those of ``tails`` (g, tail)."""
    ends = tops.select("g", F.col("digest").alias("top"))
    ends = (ends.join(tails, "g") if tails is not None else ends.withColumn("tail", F.array().cast(_SEGMENT)))
    ends = saved(ends, f"{tag}-ends")
    path = F.array(F.struct("left", "right")).cast(_SEGMENT)
    cols = ["g", "level", "pos", "digest", "item", "up", "top", "path"]
    below = steps.withColumn("path", path)
    # the children of a top have arrived: `top` is set from then on
    arrived = below.where("last").join(ends, "g").withColumn("path", F.concat("path", "tail")).select(*cols)
    moving = below.where("not last").withColumn("top", F.lit(None).cast("binary")).select(*cols)
    nodes = saved(moving.unionByName(arrived), f"{tag}-jump")
    far = 1
    while far < levels:
        low = nodes.where(F.col("level") % (2 * far) == 0)
        high = nodes.where(F.col("level") % (2 * far) == far).select(
            "g", (F.col("level") - far).alias("level"), F.col("pos").alias("up"), F.col("up").alias("up2"),
            F.col("top").alias("top2"), F.col("path").alias("path2"))
        jumped = (low.where("top is null").join(bounded(high, FEW), ["g", "level", "up"])
                  .select("g", "level", "pos", "digest", "item", F.col("up2").alias("up"), F.col("top2").alias("top"),
                          F.concat("path", "path2").alias("path")))
        nodes = saved(low.where("top is not null").select(*cols).unionByName(jumped.select(*cols)), f"{tag}-jump")
        far *= 2
    # a tree of one leaf: only leaves have an item
    alone = tops.where("item is not null").join(ends, "g").select("digest", "item", "top", F.col("tail").alias("path"))
    return nodes.where("level = 0").select("digest", "item", "top", "path").unionByName(alone)


def proofs(docs: DataFrame, also: Column | None = None, arity: int = ARITY) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, also): the path is the list of segments
    from the leaf to the root, each the siblings to the left and to the right as
    concatenated digests (binary); ``also``, a column over ``docs``, comes along."""
    g = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), "source"))
    also = F.lit(None).cast("binary") if also is None else also
    # stored, as the sampling of the ranges below would hash every text once more
    rows = saved(docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("doc_id"),
                             leaf([F.col(c) for c in FIELDS]).alias("digest"), also.alias("also")), "manifest-digests")
    leaves = numbered(rows, ["doc_id", "digest"], "manifest-rows").select(
        "g", "pos", "size", "digest", F.struct("doc_id", "also").alias("item"))
    steps, tops, levels = build(leaves, "manifest", arity)
    tops = saved(tops, "subroots")
    upper = numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), ["name"], "manifest-sources").select(
        "g", "pos", "size", "digest", F.struct("name").alias("item"))
    steps2, tops2, levels2 = build(upper, "sources", arity)
    over = climb(steps2, tops2, levels2, None, "sources")
    found = climb(steps, tops, levels, over.select(F.col("item.name").alias("g"), F.col("path").alias("tail")), "manifest")
    root = tops2.first()
    return found.select("item.doc_id", hexed("digest").alias("leaf"), hexed("top").alias("subroot"),
                        F.lit(root["digest"].hex() if root else "").alias("root"), "path", F.col("item.also").alias("also"))


def folded(leaf: Column, path: Column | str) -> Column:
    """The root (hex) that a leaf (binary) and a path give."""
    return hexed(F.aggregate(path, leaf, lambda d, s: digest(hexed(s["left"]), hexed(d), hexed(s["right"]))))


def proof_text(path: Column | str) -> Column:
    """The siblings of a path as hex text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), "")


def tamper_report(docs: DataFrame) -> DataFrame:
    """Every row's proof, folded from its leaf or, where 2 divides the CRC-32 of its
    id, from the leaf of the row without the line breaks of its text: (doc_id, leaf,
    subroot, root, proof_sha256, folded_root, verified)."""
    stripped = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("long").cast("string")) % 2 == 0
    p = proofs(docs, F.when(hit, leaf(stripped)))
    out = p.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text("path"), 256).alias("proof_sha256"),
                   folded(F.coalesce("also", F.unhex("leaf")), "path").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
