"""Quality rules: a linear-chain CRF marks each line as content or boilerplate.

Every line with a word becomes a set of binary features (symbols, case, pipes,
repeated words, length, ending, ...), one bit mask. The chain has two labels,
one weight per feature, and weights for the start and the four transitions;
Viterbi decoding labels the lines, and the share of word characters in content
lines decides whether a document stays. Simple base rules come first.

The chain is trained by maximum conditional likelihood (forward-backward) on a
bounded sample of documents with a quality label, none of over ``SAMPLE_LINES``
lines, as the driver steps through the longest one. Lines of good documents are
content. Lines of bad documents are boilerplate unless their features occur
about as often in good ones. Without a label the weights are zero and ties go
to content, so only the base rules decide.

Defined results: null text has no words and fails the base rules; texts are
read whole; a document fails the base when it has under 10 words or more than
a fifth of them stand in repeated five-word windows; repeated rows give
repeated rows; other columns pass through ``keep_good`` unchanged.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
from pyspark.sql import DataFrame

from offerflow.llm.common import keep_rows, labelled_sample, map_texts

SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
FEATURES = 18
#: Labelled documents that the chain is fitted on, at most.
SAMPLE_DOCS = 4000
#: Lines with a word of such a document, at most; longer ones are scored, but not fitted on.
SAMPLE_LINES = 2000
#: Least share of word characters in content lines.
CONTENT_SHARE = 0.5


def line_mask(line: bytes, words: list[bytes], seen: bool) -> int:
    """Binary features of a line that has a word, as bits of an integer."""
    n, size = len(words), len(line)
    symbols = size - len(line.translate(None, SYMBOLS))
    upper = size - len(line.translate(None, UPPER))
    pipes, bangs = line.count(b"|"), line.count(b"!!")
    same = sum(map(eq, words, words[1:]))
    distinct = len(set(words))
    mean = sum(map(len, words)) / n
    digits = size - len(line.translate(None, DIGITS))
    return (
        1
        | (symbols > 0) << 1
        | (symbols * 20 > size) << 2
        | (symbols * 2 > n) << 3
        | (upper * 2 > size) << 4
        | (bangs * 3 > n) << 5
        | (pipes > 1) << 6
        | (pipes * 3 > n) << 7
        | (same * 3 > n) << 8
        | (n >= 10 and distinct * 2 < n) << 9
        | bool(seen) << 10
        | (n <= 2) << 11
        | (n >= 6) << 12
        | (n >= 15) << 13
        | (line.rstrip()[-1:] in b".?!") << 14
        | (digits * 5 > size) << 15
        | (b"http" in line or b"www." in line or b"@" in line) << 16
        | (mean > 12 or mean < 3) << 17
    )


def read_lines(text: str | None) -> tuple[list[int], list[int], int]:
    """(mask, word bytes) of each line with a word; lines equal to an earlier one."""
    masks, sizes, seen, repeats = [], [], set(), 0
    for line in (text or "").encode().split(b"\n"):
        words = line.split()  # bytes split at \x20 and \x09-\x0D only
        if not words:
            continue
        again = line in seen
        repeats += again
        seen.add(line)
        masks.append(line_mask(line, words, again))
        sizes.append(sum(map(len, words)))
    return masks, sizes, repeats


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that stand in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:n + i] for i in range(width)), strict=True))
    if len(set(windows)) == n:
        return 0
    times = Counter(windows)
    covered = last = 0  # last: end of what has been counted
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + width - max(last, i)
            last = i + width
    return covered


def base_counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    raw = (text or "").encode()
    words = raw.split()
    chars = sum(map(len, words)) if raw.isascii() else sum(len(w.decode()) for w in words)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    repeat = repeated_words(words)
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    return len(words), chars, symbols, read_repeats(raw), repeat, failed


def read_repeats(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x and not x.isspace() and x.split()]
    return len(lines) - len(set(lines))


@dataclass
class Chain:
    """Weights for label content against boilerplate: features, start, transitions [from][to]."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def __post_init__(self):
        self._known: dict[int, float] = {}

    def emission(self, mask: int) -> float:
        got = self._known.get(mask)
        if got is None:
            got = self._known[mask] = float(sum(self.weights[i] for i in range(FEATURES) if mask >> i & 1))
        return got

    def decode(self, masks: list[int]) -> list[int]:
        """The best label sequence (1 content, 0 boilerplate); ties go to content."""
        if not masks:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        bad, good = float(self.start[0]), float(self.start[1]) + self.emission(masks[0])
        back = []
        for mask in masks[1:]:
            to_bad, to_good = good + m10 >= bad + m00, good + m11 >= bad + m01
            back.append((to_bad, to_good))
            bad, good = (good + m10 if to_bad else bad + m00), (good + m11 if to_good else bad + m01) + self.emission(mask)
        label = int(good >= bad)
        out = [label]
        for to_bad, to_good in reversed(back):
            label = int(to_good if label else to_bad)
            out.append(label)
        return out[::-1]


def weak_labels(rows: list[tuple[int, list[int]]]) -> list[list[int]]:
    """Line labels from document labels: see the module's text."""
    good, bad = Counter(), Counter()
    for quality, masks in rows:
        (good if quality else bad).update(masks)
    n_good, n_bad = sum(good.values()) + 1, sum(bad.values()) + 1
    odd = {m for m in bad if bad[m] / n_bad > 2 * (good[m] + 0.5) / n_good}
    return [[1] * len(masks) if quality else [int(m not in odd) for m in masks] for quality, masks in rows]


def fit(rows: list[tuple[int, list[int]]], steps: int = 120, rate: float = 0.3, decay: float = 1e-3) -> Chain:
    """Maximum conditional likelihood by gradient steps with per-weight scaling.

    All chains advance together, longest first, so a step of the recursions is
    one array operation over the chains that still have a line."""
    pairs = [(m, y) for (_, m), y in zip(rows, weak_labels(rows), strict=True) if m]
    if not pairs or len({v for _, y in pairs for v in y}) < 2:
        return Chain()
    pairs.sort(key=lambda p: -len(p[0]))
    kinds = sorted({m for masks, _ in pairs for m in masks})
    bits = np.array([[m >> i & 1 for i in range(FEATURES)] for m in kinds], float)
    number = {m: i for i, m in enumerate(kinds)}
    length = len(pairs[0][0])
    alive = [sum(len(m) > t for m, _ in pairs) for t in range(length)] if length < 64 else np.searchsorted(
        -np.array([len(m) for m, _ in pairs]), -np.arange(length), side="left").tolist()
    seq = [np.array([number[m[t]] for m, _ in pairs[:alive[t]]]) for t in range(length)]
    lab = [np.array([y[t] for _, y in pairs[:alive[t]]]) for t in range(length)]
    total = sum(alive)
    seen = sum((bits[s][y == 1].sum(0) for s, y in zip(seq, lab, strict=True)), np.zeros(FEATURES))
    seen_start = np.bincount(lab[0], minlength=2).astype(float)
    seen_moves = np.zeros((2, 2))
    for t in range(1, length):
        np.add.at(seen_moves, (lab[t - 1][:alive[t]], lab[t]), 1)
    theta, power = np.zeros(FEATURES + 6), np.full(FEATURES + 6, 1e-8)
    for _ in range(steps):
        w, s, m = theta[:FEATURES], theta[FEATURES:FEATURES + 2], theta[FEATURES + 2:].reshape(2, 2)
        emit = bits @ w
        forward = []
        for t in range(length):
            e = np.stack([np.zeros(alive[t]), emit[seq[t]]], 1)
            a = s + e if t == 0 else np.logaddexp(*(forward[-1][:alive[t], i, None] + m[i] for i in (0, 1))) + e
            forward.append(a)
        hope, hope_start, hope_moves = np.zeros(len(kinds)), np.zeros(2), np.zeros((2, 2))
        b = np.zeros((0, 2))
        for t in range(length - 1, -1, -1):
            full = np.zeros((alive[t], 2))
            if len(b):
                n = len(b)
                ahead = b + np.stack([np.zeros(n), emit[seq[t + 1]]], 1)
                step = m[None] + ahead[:, None, :]
                full[:n] = np.logaddexp(step[:, :, 0], step[:, :, 1])
                z = np.logaddexp(*(forward[t][:n] + full[:n]).T)
                hope_moves += np.exp(forward[t][:n, :, None] + step - z[:, None, None]).sum(0)
            b = full
            p = forward[t] + b
            p = np.exp(p - np.logaddexp(*p.T)[:, None])
            hope += np.bincount(seq[t], p[:, 1], minlength=len(kinds))
            if t == 0:
                hope_start = p.sum(0)
        slope = np.concatenate([seen - hope @ bits, seen_start - hope_start, (seen_moves - hope_moves).ravel()]) / total
        slope -= decay * theta
        power += slope ** 2
        theta = theta + rate * slope / np.sqrt(power)
    return Chain(theta[:FEATURES].copy(), theta[FEATURES:FEATURES + 2].copy(), theta[FEATURES + 2:].reshape(2, 2).copy())


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Chain:
    """Fit the chain on at most ``sample_docs`` labelled documents, those of over
    ``sample_lines`` lines left out; only their line masks reach the driver."""

    def row(_, doc_id, text, quality):
        masks = read_lines(text)[0]
        return doc_id, int(quality), masks if len(masks) <= sample_lines else None

    sample = labelled_sample(docs, labels, "quality", sample_docs)
    rows = map_texts(sample, ["doc_id", "text", "quality"], row, "doc_id long, quality int, masks array<int>").where("masks is not null").collect()
    return fit([(r["quality"], r["masks"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["masks"]))])


def judge(chain: Chain, text: str | None) -> tuple:
    base = base_counts(text)
    masks, sizes, _ = read_lines(text)
    labels = chain.decode(masks)
    content = sum(size for size, label in zip(sizes, labels, strict=True) if label)
    share = content / sum(sizes) if sizes else 0.0
    return *base, not base[-1] and share >= CONTENT_SHARE, share, len(labels), sum(labels)


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, verdict and content share of every document."""
    chain = train(docs, labels)

    def row(state: Chain, doc_id, text):
        return doc_id, *judge(state, text)

    return map_texts(docs, ["doc_id", "text"], row,
                     "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                     "n_repeat_words long, base_failed boolean, kept boolean, content_share double, "
                     "n_lines long, n_content_lines long", lambda: chain)


def label_lines(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, line_labels): 1 content, 0 boilerplate, per line with a word."""
    chain = train(docs, labels)

    def row(state: Chain, doc_id, text):
        return doc_id, state.decode(read_lines(text)[0])

    return map_texts(docs, ["doc_id", "text"], row, "doc_id long, line_labels array<int>", lambda: chain)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    chain = train(docs, labels)
    return keep_rows(docs, "text", lambda state, texts: [judge(state, t)[6] for t in texts], lambda: chain)
