"""Line dedup: delete from later documents the blocks they share with earlier ones.

Every line of ``MIN_WORDS`` words or more is hashed (surrounding white space
aside). A shorter or blank line counts only in its place: its hash takes in the
nearest longer line before it (or else after it) and what stands between, so
"The end." alone never matches, but goes when the passage around it goes.
Shorter lines in a row (verse, lists, tables) also count by their own content:
every smallest run of them that starts at a line and together reaches
``MIN_WORDS`` is hashed, whatever stands before it, and is deleted whole where
an earlier document has it. Where words have no spaces between them (Chinese,
Japanese, Thai and the like), two letters count as a word.

A line that occurs in more than one document belongs to the earliest (smallest
id). Each later document is paired with the owners of its shared lines, rarest
line first: as many pairs as shared lines at most, however common a line is,
and every shared line is in one. Each pair is aligned by patience diff: lines
unique in both, their longest increasing subsequence, and between them the same
again; what remains (moved or repeated passages) is aligned anew until nothing
shared is left. Aligned lines adjacent in both texts form blocks, and the
blocks are deleted from the later document.

Spark shuffles line hashes with their positions, joins them with their owners
(a line in very many documents is a skewed join key, which adaptive execution
splits) and gathers each later document's own matches, no more than its lines.

Defined results: null texts and rows with a null id are left as they are; rows
that share an id never take lines from one another, and each text of such an id
loses its own lines; a line is deleted only if the text at hand really has it there; the order of other lines is kept; a
document of which no word is left has an empty text, and ``remove_shared`` drops
it; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerflow.llm.common import map_texts, saved, unused

MIN_WORDS = 5
#: Letters of scripts that put no spaces between words: Thai, Lao, Tibetan, Burmese,
#: Khmer, kana, Han.
UNSPACED = re.compile("[\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u3400-\u4DBF"
                      "\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\U00020000-\U0003FFFF]")
#: So many of them count as a word.
LETTERS = 2


def sizes(text: str | None) -> tuple[list[bytes], list[int]]:
    """The lines without surrounding white space, and the words of each."""
    lines = [x.strip() for x in (text or "").encode().split(b"\n")]
    counts = [len(x.split()) for x in lines]
    for i, x in enumerate(lines):
        if not x.isascii():
            counts[i] = max(counts[i], len(UNSPACED.findall(x.decode())) // LETTERS)
    return lines, counts


def window_keys(text: str | None, min_words: int = MIN_WORDS) -> dict[int, tuple[int, int, int]]:
    """First line -> (key, words, lines) of each smallest run of lines under
    ``min_words`` words that together reach them."""
    lines, counts = sizes(text)
    out: dict[int, tuple[int, int, int]] = {}
    start = end = words = 0  # the run is lines[start:end]
    while end < len(lines):
        if counts[end] >= min_words:
            start, end, words = end + 1, end + 1, 0
            continue
        words += counts[end]
        end += 1
        while words >= min_words:
            if counts[start]:  # the same run without leading blank lines
                key = xxhash.xxh3_64_intdigest(b"\n".join(lines[start:end]), seed=1) - (1 << 63)
                out[start] = (key, words, end - start)
            words -= counts[start]
            start += 1
    return out


def line_keys(text: str | None, min_words: int = MIN_WORDS) -> list[tuple[int | None, int]]:
    """(key, words) of each line; the key is None where nothing around a short
    line tells it from others like it."""
    lines, counts = sizes(text)
    out: list[tuple[int | None, int]] = [(None, n) for n in counts]
    before, first = None, None
    for i, (line, n) in enumerate(zip(lines, counts, strict=True)):
        if n >= min_words:
            before = xxhash.xxh3_64_intdigest(line) - (1 << 63)
            out[i] = (before, n)
            first = i if first is None else first
        elif before is not None:  # the chain since the longer line
            before = xxhash.xxh3_64_intdigest(line, seed=before & 0xFFFFFFFF) - (1 << 63) ^ before
            out[i] = (before, n)
    if first:
        after = out[first][0]
        for i in range(first - 1, -1, -1):
            after = xxhash.xxh3_64_intdigest(lines[i], seed=after & 0xFFFFFFFF) - (1 << 63) ^ after ^ 1
            out[i] = (after, counts[i])
    return out


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tops: list[int] = []
    at: list[int] = []
    back = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        tops[k:k + 1], at[k:k + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(d: dict[int, int], o: dict[int, int]) -> list[tuple[int, int]]:
    """Aligned (line of d, line of o); d and o: line number -> key, of shared lines."""
    out: list[tuple[int, int]] = []
    todo = [(sorted(d), sorted(o))]
    while todo:
        ds, os = todo.pop()
        lo, n = 0, min(len(ds), len(os))
        while lo < n and d[ds[lo]] == o[os[lo]]:
            lo += 1
        out += zip(ds[:lo], os[:lo], strict=True)
        ds, os = ds[lo:], os[lo:]
        hi, n = 0, min(len(ds), len(os))
        while hi < n and d[ds[-1 - hi]] == o[os[-1 - hi]]:
            hi += 1
        if hi:
            out += zip(ds[-hi:], os[-hi:], strict=True)
            ds, os = ds[:-hi], os[:-hi]
        if not ds or not os:
            continue
        once: dict[int, int] = {}
        for p in ds:
            once[d[p]] = -1 if d[p] in once else p
        other: dict[int, int] = {}
        for q in os:
            other[o[q]] = -1 if o[q] in other else q
        anchors = [(p, other[k]) for k, p in once.items() if p >= 0 and other.get(k, -1) >= 0]
        if not anchors:
            continue
        anchors.sort()
        chain = [anchors[i] for i in increasing([q for _, q in anchors])]
        i = j = 0
        for p, q in chain:
            out.append((p, q))
            i2, j2 = bisect_left(ds, p), bisect_left(os, q)
            if i < i2 and j < j2:
                todo.append((ds[i:i2], os[j:j2]))
            i, j = i2 + 1, j2 + 1
        if i < len(ds) and j < len(os):
            todo.append((ds[i:], os[j:]))
    return out


def align(d: dict[int, int], o: dict[int, int]) -> list[tuple[int, int]]:
    """Patience diff, again over the lines of d that are left, until all that o has are aligned."""
    where: dict[int, list[int]] = {}
    for q in sorted(o):
        where.setdefault(o[q], []).append(q)
    left = {p: k for p, k in d.items() if k in where}
    out = []
    while left:
        made = patience(left, o)
        if not made:  # repeated lines only: the first, and what follows it in both
            p = min(left)
            q = where[left[p]][0]
            while p in left and o.get(q) == left[p]:
                made.append((p, q))
                p, q = p + 1, q + 1
        out += made
        for p, _ in made:
            del left[p]
    return out


def blocks(pairs: list[tuple[int, int]], words: dict[int, int], least: int) -> list[tuple[int, int]]:
    """(first line, lines) of runs adjacent in both texts with ``least`` words or more."""
    out, run = [], []
    for p, q in [*sorted(pairs), (-9, -9)]:
        if run and (p != run[-1][0] + 1 or q != run[-1][1] + 1):
            if sum(words[x] for x, _ in run) >= least:
                out.append((run[0][0], len(run)))
            run = []
        run.append((p, q))
    return out


def shared_blocks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, lines, keys, partners): per later document the numbers (from 0)
    and keys of the lines to delete, and the earlier documents that have them. A
    run of short lines has its window key and the number of its first line."""

    def spread(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc_id, text, text_hash in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc_id is None or not text:
                    continue
                places: dict[int, list] = {}
                for i, (key, n) in enumerate(line_keys(text, min_words)):
                    if key is not None:
                        places.setdefault(key, [n, []])[1].append(i)
                runs: dict[int, list] = {}
                for i, (key, n, size) in window_keys(text, min_words).items():
                    runs.setdefault(key, [n, [], size])[1].append(i)
                for found, size in ((places, 0), (runs, None)):
                    cols[0] += found
                    cols[1] += [doc_id] * len(found)
                    cols[2] += (x[0] for x in found.values())
                    cols[3] += (x[1] for x in found.values())
                    cols[4] += (x[2] if size is None else size for x in found.values())
                    cols[5] += [text_hash] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                cols, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int64()), strict=True)],
                ["key", "doc", "words", "at", "run", "text"])

    lines = docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(
        spread, "key long, doc long, words int, at array<int>, run int, text long")
    owners = lines.groupBy("key").agg(F.min("doc").alias("owner"), F.count("*").alias("df")).where("df > 1")
    shared = saved(lines.join(owners, "key"), "shared-lines")
    # a document is an id and a text: of several texts with the owner's id the one with the smallest hash is aligned with
    first = shared.where("doc = owner").groupBy("key").agg(F.min_by("at", "text").alias("there"))
    # a set: rows that repeat id and text send the same matches
    matches = (shared.where("doc <> owner").join(first, "key").groupBy("doc", "text")
               .agg(F.collect_set(F.struct("owner", "df", "key", "words", "at", "there", "run")).alias("m")))

    def delete(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, text_hash, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, by, runs = {}, {}, []
                for m in found:
                    if m["run"]:  # long enough by itself, so there is nothing to align
                        runs += ((p, m["key"], m["run"], m["owner"]) for p in m["at"])
                        continue
                    rarest, d, o = by.setdefault(m["owner"], [m["df"], {}, {}])
                    by[m["owner"]][0] = min(rarest, m["df"])
                    for p in m["at"]:
                        d[p], words[p] = m["key"], m["words"]
                    for q in m["there"]:
                        o[q] = m["key"]
                gone: dict[int, int] = {}
                partners = []
                for owner, (_, d, o) in sorted(by.items(), key=lambda x: (x[1][0], x[0])):
                    d = {p: k for p, k in d.items() if p not in gone}
                    cut = {p + i for p, n in blocks(align(d, o), words, min_words) for i in range(n)}
                    if cut:
                        partners.append(owner)
                        gone |= {p: d[p] for p in cut}
                within = {p + i for p, _, size, _ in runs for i in range(size)}
                # A short line shared with one owner may continue a block shared with another.
                if gone or runs:
                    every = {p: k for _, d, _ in by.values() for p, k in d.items()}
                    for p in sorted(every.keys() - gone.keys()):
                        if any(x in gone or x in within for x in (p - 1, p + 1)):
                            gone[p] = every[p]
                    cut = sorted([*gone.items(), *((p, key) for p, key, _, _ in runs)])
                    cols[0].append(doc)
                    cols[1].append([p for p, _ in cut])
                    cols[2].append([key for _, key in cut])
                    cols[3].append(sorted({*partners, *(owner for *_, owner in runs)}))
                    cols[4].append(text_hash)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                cols, (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()), strict=True)],
                ["doc_id", "lines", "keys", "partners", "text_hash"])

    return matches.mapInArrow(delete, "doc_id long, lines array<int>, keys array<long>, partners array<long>, text_hash long")


def without(text: str | None, lines: list[int] | None, keys: list[int] | None) -> tuple[str | None, int, int]:
    """(text without the lines, lines before, lines deleted)."""
    if text is None:
        return None, 0, 0
    rows = text.split("\n")
    if not lines:
        return text, len(rows), 0
    real = line_keys(text)
    runs = window_keys(text)
    gone = set()
    for p, k in zip(lines, keys, strict=True):
        if p < len(real) and real[p][0] == k:
            gone.add(p)
        elif p in runs and runs[p][0] == k:
            gone.update(range(p, p + runs[p][2]))
    return "\n".join(x for i, x in enumerate(rows) if i not in gone), len(rows), len(gone)


def _with_blocks(docs: DataFrame, *names: str) -> DataFrame:
    """The rows with their lines, keys and partners to delete, under names that ``docs`` does not have."""
    id_, hash_, own = unused(docs, *(f"{n}_" for n in ("doc_id", "text_hash", "own_hash")))
    found = shared_blocks(docs).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_),
                                       *(F.col(c).alias(n) for c, n in zip(("lines", "keys", "partners"), names)))
    keyed = docs.withColumn(own, F.xxhash64("text"))
    return keyed.join(found, (F.col("doc_id") == F.col(id_)) & (F.col(own) == F.col(hash_)), "left").drop(id_, hash_, own)


def dedup_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, partners, text_sha256) of every document."""

    def row(_, doc_id, text, lines, keys, partners):
        kept, before, gone = without(text, lines, keys)
        return doc_id, before, gone, partners or [], sha256((kept or "").encode()).hexdigest()

    return map_texts(_with_blocks(docs.select("doc_id", "text"), "lines", "keys", "partners"), ["doc_id", "text", "lines", "keys", "partners"], row,
                     "doc_id long, n_lines long, n_removed long, partners array<long>, text_sha256 string")


def remove_shared(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with shared blocks deleted (and ``n_chars``
    set anew where there is such a column); those with no word left are dropped."""
    names = docs.columns
    at = names.index("text")
    size = names.index("n_chars") if "n_chars" in names else None
    cut = unused(docs, "lines", "keys")

    def run(batches):
        for batch in batches:
            cols = [batch.column(i) for i in range(len(names))]
            lines, keys = (batch.column(batch.schema.names.index(c)).to_pylist() for c in cut)
            texts = cols[at].to_pylist()
            keep = [True] * len(texts)
            for i, (a, k) in enumerate(zip(lines, keys, strict=True)):
                if a:
                    texts[i], _, gone = without(texts[i], a, k)
                    keep[i] = not gone or bool(texts[i].split())
            old = cols[at]
            cols[at] = pa.array(texts, old.type)
            if size is not None:
                new = pc.cast(pc.utf8_length(cols[at]), cols[size].type)
                cols[size] = pc.if_else(pa.array([bool(a) for a in lines]), new, cols[size])
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep, pa.bool_()))

    return _with_blocks(docs, *cut).mapInArrow(run, docs.schema)
