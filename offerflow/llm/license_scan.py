"""License scan by a positional index of rare licence words.

Notices (templates) are posted word by word with their positions. The words'
document frequencies over the whole corpus give their IDF. A file's licence
words are looked up rarest first, per notice: each occurrence at word p of a
word posted at position q votes for the notice to begin at p - q; agreeing
votes give candidate places, which must then cover enough of the notice's IDF
weight at the relative positions (a drift of a few words is allowed) and hold
its mandatory key phrases word for word. Key phrases and base phrases are
found through their own rarest word, so no place is missed.

Defined results: words are lower-cased over A-Z; null text counts as empty and
has no labels; counts cover whole texts; repeated rows give repeated rows;
other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerflow.llm.common import map_texts

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, wording, mandatory phrases of public licence notices.
NOTICES = [
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3.0", "licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "2 0"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction",
     ["permission is hereby granted", "without restriction"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", ["permission to use copy modify"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["unencumbered software", "public domain"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0", ["cc0"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
    # file headers
    ("gpl-3.0", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
                "by the free software foundation either version 3 of the license or at your option any later version",
     ["gnu general public license", "version 3"]),
    ("gpl-2.0", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
                "by the free software foundation either version 2 of the license or at your option any later version",
     ["gnu general public license", "version 2"]),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published "
             "by the free software foundation either version 3 of the license or at your option any later version",
     ["gnu lesser general public license"]),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published "
             "by the free software foundation either version 2 1 of the license or at your option any later version",
     ["gnu lesser general public license"]),
    ("agpl-3.0", "free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published "
                 "by the free software foundation either version 3 of the license or at your option any later version",
     ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
     ["apache license version 2 0"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    # openings of the full texts
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", ["gnu general public license version 3"]),
    ("gpl-2.0", "gnu general public license version 2 june 1991", ["gnu general public license version 2"]),
    ("lgpl", "gnu lesser general public license version 3 29 june 2007", ["gnu lesser general public license version 3"]),
    ("lgpl", "gnu lesser general public license version 2 1 february 1999", ["gnu lesser general public license version 2 1"]),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007", ["gnu affero general public license version 3"]),
    ("apache-2.0", "apache license version 2 0 january 2004", ["apache license version 2 0"]),
    ("mpl-2.0", "mozilla public license version 2 0", ["mozilla public license version 2 0"]),
    # SPDX lines
    *((label, f"spdx license identifier {name}", [f"spdx license identifier {name}"]) for label, name in (
        ("mit", "mit"), ("apache-2.0", "apache 2 0"), ("gpl-2.0", "gpl 2 0"), ("gpl-3.0", "gpl 3 0"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"),
        ("agpl-3.0", "agpl 3 0"), ("mpl-2.0", "mpl 2 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("isc", "isc"),
        ("unlicense", "unlicense"), ("cc0-1.0", "cc0 1 0"), ("cc-by-4.0", "cc by 4 0"), ("cc-by-sa-4.0", "cc by sa 4 0"))),
]


@dataclass
class Notice:
    label: str
    words: list[bytes]
    keys: list[list[bytes]]


def notices(rows=NOTICES) -> list[Notice]:
    return [Notice(label, text.encode().split(), [k.encode().split() for k in keys]) for label, text, keys in rows]


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall((text or "").encode().lower())  # bytes.lower() changes A-Z only


class Index:
    """Postings of the notices, with the IDF of their words in a corpus."""

    def __init__(self, idf: dict[bytes, float], templates: list[Notice] | None = None, base: dict | None = None,
                 lookups: int = 4, drift: int = 2, least: float = 0.8):
        self.idf, self.templates = idf, notices() if templates is None else templates
        self.base = [(p.encode().split(), label) for p, label in (BASE if base is None else base).items()]
        self.lookups, self.drift, self.least = lookups, drift, least
        self.postings: list[dict[bytes, list[int]]] = []
        self.weight = []
        for t in self.templates:
            at: dict[bytes, list[int]] = {}
            for q, w in enumerate(t.words):
                at.setdefault(w, []).append(q)
            self.postings.append(at)
            self.weight.append(sum(idf[w] for w in t.words))
        self.vocabulary = vocabulary(self.templates, [p for p, _ in self.base])

    def places(self, words: list[bytes], phrase: list[bytes], at: dict[bytes, list[int]]) -> list[int]:
        """Starts of a phrase, found from its rarest word."""
        q = max(range(len(phrase)), key=lambda i: self.idf[phrase[i]])
        return [p - q for p in at.get(phrase[q], ()) if p >= q and words[p - q:p - q + len(phrase)] == phrase]

    def matches(self, words: list[bytes], present: set[bytes], at: dict[bytes, list[int]]):
        """(label, start, share) of every notice that stands in the file."""
        for t, postings, weight in zip(self.templates, self.postings, self.weight, strict=True):
            mine = sorted(present & postings.keys(), key=lambda w: (-self.idf[w], w))
            if not mine or sum(self.idf[w] * len(postings[w]) for w in mine) < self.least * weight:
                continue  # its words are not there, so its weight cannot be
            # Any place with the least share holds one of the rarest words that together weigh more than the rest.
            hits: set[int] = set()
            spent = 0.0
            for n, w in enumerate(mine):
                if n >= self.lookups and spent > (1 - self.least) * weight:
                    break
                spent += self.idf[w] * len(postings[w])
                hits.update(p - q for p in at[w] for q in postings[w])
            # a word may stand off its place by the drift, so may the start that it votes for
            starts = {h + d for h in hits for d in range(-self.drift, self.drift + 1)}
            keys = [self.places(words, k, at) for k in t.keys]
            best, where = 0.0, -1
            for start in sorted(starts):
                low, high = start - self.drift, start + len(t.words) + self.drift
                # places ascend: the first one from `low` on is the only one to look at
                if not all((i := bisect_left(found, low)) < len(found) and found[i] + len(k) <= high
                           for k, found in zip(t.keys, keys, strict=True)):
                    continue
                got = 0.0
                for q, w in enumerate(t.words):
                    near = words[max(0, start + q - self.drift):max(0, start + q + self.drift + 1)]
                    if w in near:
                        got += self.idf[w]
                if got > best:
                    best, where = got, max(0, start)
            if weight and best / weight >= self.least:
                yield t.label, where, best / weight

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        present = self.vocabulary.intersection(words)
        found: list[int] = []
        base, labels, score = set(), set(), 0.0
        if present:
            at: dict[bytes, list[int]] = {w: [] for w in present}
            for i, w in enumerate(words):
                if w in at:
                    at[w].append(i)
            for phrase, label in self.base:
                if set(phrase) <= present and (places := self.places(words, phrase, at)):
                    found += places
                    base.add(label)
                    score = 1.0
            for label, _, share in self.matches(words, present, at):
                labels.add(label)
                score = max(score, min(1.0, share))
        return (len(words), len(found), min(found, default=None), max(found, default=None),
                ",".join(sorted(base)), ",".join(sorted(base | labels)), score)


def vocabulary(templates: list[Notice], phrases: list[list[bytes]]) -> set[bytes]:
    return {w for t in templates for w in t.words} | {w for t in templates for k in t.keys for w in k} | {
        w for p in phrases for w in p}


def document_frequencies(docs: DataFrame, words: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """Documents, and how many hold each of the (some hundred) licence words."""

    def count(batches):
        n, df = 0, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                df.update(words.intersection(words_of(text)))
        rows = [("", n), *((w.decode(), c) for w, c in sorted(df.items()))]
        yield pa.RecordBatch.from_pydict({"word": [w for w, _ in rows], "n": pa.array([c for _, c in rows], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r["word"].encode(): int(r["n"]) for r in rows}
    return got.pop(b"", 0), got


def build_index(docs: DataFrame, templates: list[Notice] | None = None, base: dict | None = None) -> Index:
    templates = notices() if templates is None else templates
    words = vocabulary(templates, [p.encode().split() for p in (BASE if base is None else base)])
    n, df = document_frequencies(docs, words)
    return Index({w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-9 for w in words}, templates, base)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Base places, labels and score of every document."""
    index = build_index(docs)

    def row(state: Index, doc_id, text):
        return doc_id, *state.scan(text)

    return map_texts(docs, ["doc_id", "text"], row,
                     "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                     "base_labels string, labels string, score double", lambda: index)
