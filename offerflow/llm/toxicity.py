"""Toxicity scores from a factorization machine over hashed terms.

A document is the set of its terms: its words (lower-cased over A-Z) and the
first 4 and 5 characters of longer ones, which stand for a stem, each hashed to
one of 2^18 columns. The score is the logistic of a bias, one weight per term, and
the inner products of factor vectors for every pair of terms present, which is
how an insult next to a group's name can weigh more than both alone. All pairs
cost one pass: (sum v)^2 - sum v^2.

Trained by logistic loss with per-weight step sizes on a bounded sample of
labelled documents; only hashed term sets of that sample reach the driver.
Terms that fewer than ``least_docs`` sampled documents hold have no weight, nor
have terms that tell nothing: their toxic share differs from the sample's by
under ``least_z`` standard errors, and they are in no pair (``joint_terms``)
whose toxic share differs from what its two terms say one by one. Sums over the
thousands of indifferent terms of a long text would only add noise.
The model (2^18 x (factors + 1) single-precision numbers) is of fixed size and
is broadcast; scoring is one pass without a shuffle.

Defined results: null or empty text scores the bias alone; without labelled
rows every score is 0.5; texts are read whole; repeated rows give repeated
rows; labels, language, source and ids are never inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerflow.llm.common import Remembered, labelled_sample, map_texts

TERMS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BITS = 18
#: Labelled documents that the machine is fitted on, at most.
SAMPLE_DOCS = 12000


def word_columns(word: bytes) -> tuple[int, ...]:
    """Columns of a word and of its stems."""
    text = word.decode()
    stems = [text[:n] + "*" for n in (4, 5) if len(text) > n]
    return tuple(zlib.crc32(t) & ((1 << BITS) - 1) for t in (word, *(s.encode() for s in stems)))


_columns = Remembered(word_columns)


def term_ids(text: str | None) -> np.ndarray:
    """Sorted distinct columns of a text's terms."""
    words = set(TERMS.findall((text or "").encode().lower()))
    return np.array(sorted({i for w in words for i in _columns[w]}), np.int32)


@dataclass
class Machine:
    bias: float = 0.0
    linear: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 1), np.float32))

    def raw(self, ids: np.ndarray) -> float:
        v = self.factors[ids].astype(np.float64)
        total = v.sum(0)
        return float(self.bias + self.linear[ids].sum(dtype=np.float64) + 0.5 * (total @ total - (v * v).sum()))

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.raw(term_ids(text)), -35, 35))))


def joint_terms(rows: list[tuple[np.ndarray, int]], least_toxic: int = 5, chance: float = 0.01, block: int = 512) -> np.ndarray:
    """Columns of pairs that are toxic more or less often than their terms' own
    log odds add up to. A pair counts when the Chernoff bound of its difference is
    below ``chance`` over all pairs tested; equal term sets count once. Terms of
    fewer than ``least_toxic`` toxic documents are not tested: so few documents
    could hardly pass. All pairs are counted, block by block, from one bit per
    term and document."""
    once = {(x.tobytes(), t): (x, t) for x, t in rows}
    rows = sorted(once.values(), key=lambda r: (-r[1], r[0].tobytes()))
    n, bad_n = len(rows), sum(t for _, t in rows)
    every = np.bincount(np.concatenate([x for x, _ in rows]), minlength=1 << BITS)
    toxic = np.bincount(np.concatenate([np.empty(0, np.int64), *(x for x, t in rows if t)]).astype(np.int64), minlength=1 << BITS)
    terms = np.flatnonzero(toxic >= least_toxic)
    if len(terms) < 2 or bad_n == n:
        return terms[:0]
    share = bad_n / n
    base = np.log(share / (1 - share))
    own = (toxic[terms] + 10 * share) / (every[terms] + 10)  # of rare terms nearer to the share of all
    odds = np.log(own / (1 - own))
    level = np.log(len(terms) * (len(terms) - 1) / 2 / chance)
    place = np.full(1 << BITS, -1, np.int64)
    place[terms] = np.arange(len(terms))
    bits = np.zeros((len(terms), (n + 7) // 8), np.uint8)
    for d, (x, _) in enumerate(rows):
        p = place[x]
        bits[p[p >= 0], d >> 3] |= 128 >> (d & 7)

    def dense(at):
        return np.unpackbits(bits[at:at + block], axis=1, count=n).astype(np.float32)

    found = np.zeros(len(terms), bool)
    for a in range(0, len(terms), block):
        left = dense(a)
        for b in range(a, len(terms), block):
            right = left if a == b else dense(b)
            both = left @ right.T
            i, j = np.nonzero(both >= least_toxic)
            if a == b:
                i, j = i[i < j], j[i < j]
            docs = both[i, j].astype(float)
            seen = (left[:, :bad_n] @ right[:, :bad_n].T)[i, j] / docs
            want = 1.0 / (1.0 + np.exp(-np.clip(odds[a + i] + odds[b + j] - base, -20, 20)))
            with np.errstate(divide="ignore", invalid="ignore"):
                away = np.where(seen > 0, seen * np.log(seen / want), 0) + np.where(seen < 1, (1 - seen) * np.log((1 - seen) / (1 - want)), 0)
            told = docs * away >= level
            found[a + i[told]] = found[b + j[told]] = True
    return terms[found]


def fit(rows: list[tuple[np.ndarray, int]], factors: int = 4, epochs: int = 15, rate: float = 0.15,
        decay: float = 1e-4, batch: int = 64, least_docs: int = 3, least_z: float = 3.0, toxic_weight: float = 2.0,
        seed: int = 5) -> Machine:
    """Minimise logistic loss plus squared weights; steps shrink per weight."""
    if not rows or len({y for _, y in rows}) < 2:
        return Machine()
    every = np.bincount(np.concatenate([x for x, _ in rows]), minlength=1 << BITS)
    toxic = np.bincount(np.concatenate([x for x, t in rows if t]), minlength=1 << BITS)
    share = sum(t for _, t in rows) / len(rows)
    z = np.abs(toxic - every * share) / np.sqrt(np.maximum(every, 1) * share * (1 - share))
    telling = z >= least_z
    telling[joint_terms(rows)] = True
    used = np.flatnonzero((every >= least_docs) & telling)
    if not len(used):
        return Machine()
    place = np.full(1 << BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    sets = [p[p >= 0] for p in (place[x] for x, _ in rows)]
    y = np.array([t for _, t in rows], float)
    random = np.random.default_rng(seed)
    theta = np.concatenate([np.zeros((len(used), 1)), random.normal(0, 0.01, (len(used), factors))], 1)
    power = np.full_like(theta, 1e-4)
    bias, bias_power = float(np.log(share / (1 - share))), 1e-4
    for _ in range(epochs):
        order = random.permutation(len(sets))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            sizes = np.array([len(sets[i]) for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), sizes)
            ids = np.concatenate([sets[i] for i in chosen])
            rows_at = theta[ids]
            sums = np.zeros((len(chosen), factors + 1))
            np.add.at(sums, owner, rows_at)
            squares = np.bincount(owner, (rows_at[:, 1:] ** 2).sum(1), minlength=len(chosen))
            raw = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)
            miss = 1.0 / (1.0 + np.exp(-np.clip(raw, -35, 35))) - y[chosen]
            miss *= np.where(y[chosen] > 0, toxic_weight, 1.0)
            slope = np.empty_like(rows_at)
            slope[:, 0] = miss[owner]
            slope[:, 1:] = miss[owner, None] * (sums[owner, 1:] - rows_at[:, 1:])
            touched, inverse = np.unique(ids, return_inverse=True)
            grad = np.zeros((len(touched), factors + 1))
            np.add.at(grad, inverse, slope)
            grad = grad / len(chosen) + decay * theta[touched]
            power[touched] += grad ** 2
            theta[touched] -= rate * grad / np.sqrt(power[touched])
            g = float(miss.mean())
            bias_power += g * g
            bias -= rate * g / np.sqrt(bias_power)
    machine = Machine(bias, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, factors), np.float32))
    machine.linear[used] = theta[:, 0]
    machine.factors[used] = theta[:, 1:]
    return machine


def held_out():
    """Column: documents whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Machine:
    def row(_, doc_id, text, toxic):
        return doc_id, int(toxic), term_ids(text).tobytes()

    sample = labelled_sample(docs, labels, "toxic", sample_docs, ~held_out())
    rows = map_texts(sample, ["doc_id", "text", "toxic"], row, "doc_id long, toxic int, ids binary").collect()
    return fit([(np.frombuffer(bytes(r["ids"]), np.int32), r["toxic"])
                for r in sorted(rows, key=lambda r: (r["doc_id"], bytes(r["ids"])))])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def row(state: Machine, doc_id, held, text):
        score = state.score(text)
        return doc_id, bool(held), score, int(score >= 0.7)

    marked = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    return map_texts(marked, ["doc_id", "held_out", "text"], row,
                     "doc_id long, held_out boolean, score double, predicted int", lambda: shared.value)
