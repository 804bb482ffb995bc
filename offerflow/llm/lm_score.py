"""Language-model scores: deleted interpolation of n-gram estimates.

A token's probability is a mixture of its bigram estimate c(h w) / c(h), its
unigram estimate c(w) / N and a uniform 1 / (V + 1), with weights that depend
on how often the context h was seen (buckets of powers of two). The weights
come from expectation-maximisation on a held-out part of the training texts,
whose own counts are deleted from the estimates there. Scores then use all
training counts.

Counts of a corpus of words do not fit one machine, so no table of them is
broadcast or collected. Texts are read once and written as chunks of about half a
million tokens (64-bit word hashes, the position of each token in them). Every
chunk asks for its distinct n-grams: sorted hashes and own counts, cut into
buckets by their leading bits. A bucket adds up all chunks' counts and answers
each chunk; answers and chunks meet again by chunk. A very frequent n-gram is
one entry per chunk. Only the counts of tokens and the histogram of (bucket,
quantised estimates) that the mixture is fitted on, of bounded size, reach the
driver.

Defined results: words are lower-cased over A-Z; null texts count as empty and
consist of the end mark alone; the context of a first word is the end mark; a
null id counts as training; without training texts every estimate is uniform;
repeated rows count and score each; other columns are not read. N-grams are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerflow.llm.common import Remembered, saved

CHUNK_TOKENS = 500_000
BUCKET_KEYS = 1_000_000
#: Kinds of documents by crc32(id) mod 5: 1 is held out, 0 fits the mixture weights, the rest train only.
HELD, FIT, TRAIN = 1, 0, 2
#: Steps per factor of two in the histogram of estimates.
FINE = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


_word_hash = Remembered(xxhash.xxh3_64_intdigest, 200_000)
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))  # no word holds a line break


def token_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, then of the end mark."""
    words = (text or "").encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def bigram_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; texts follow one another, so
    the context of a first word is an end mark."""
    before = np.empty_like(h)
    before[:1] = END
    before[1:] = h[:-1]
    x = (before * _STEP) ^ (h + (before >> np.uint64(31)))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB)


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers by byte plane, so that the shuffle's compression finds the zero bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def kind_of(doc_id: int | None) -> int:
    if doc_id is None:
        return TRAIN
    mod = zlib.crc32(str(doc_id).encode()) % 5
    return mod if mod in (HELD, FIT) else TRAIN


_CHUNK = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())),
                    ("sizes", pa.binary()), ("vocabulary", pa.binary()), ("tokens", pa.binary())])


def chunks_of(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    def run(batches):
        held: dict[int, list] = {}  # kind: ids, hashes of each text, tokens so far

        def flush(kind):
            ids, parts, _ = held.pop(kind)
            h = np.concatenate(parts)
            vocabulary, tokens = np.unique(h, return_inverse=True)
            sizes = np.array([len(p) for p in parts], "<u4").tobytes()
            tokens = np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
            vocabulary = vocabulary.tobytes()
            # all that a chunk holds: chunks of one name are the same texts and get the same answers
            name = xxhash.xxh3_64_intdigest(b"".join([repr(ids).encode(), sizes, vocabulary, tokens])) >> 1
            return pa.RecordBatch.from_pylist([{"chunk": name, "kind": kind, "n": len(h), "ids": ids, "sizes": sizes,
                                                "vocabulary": vocabulary, "tokens": tokens}], _CHUNK)

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = kind_of(doc_id)
                own = held.setdefault(kind, [[], [], 0])
                own[0].append(doc_id)
                own[1].append(token_hashes(text))
                own[2] += len(own[1][-1])
                if own[2] >= chunk_tokens:
                    yield flush(kind)
        for kind in list(held):
            yield flush(kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "chunk long, kind int, n long, ids array<long>, sizes binary, vocabulary binary, tokens binary")


class Chunk:
    """A chunk's tokens, and its distinct unigrams and bigrams in hash order."""

    def __init__(self, vocabulary: bytes, tokens: bytes):
        self.words = np.frombuffer(vocabulary, np.uint64)
        self.tokens = np.ascontiguousarray(np.frombuffer(tokens, np.uint8).reshape(4, -1).T).view("<u4").ravel()
        self.pairs, self.pair = np.unique(bigram_hashes(self.words[self.tokens]), return_inverse=True)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted hashes pass from one bucket (leading bits) to the next."""
    edge = np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets)
    return np.concatenate([[0], np.searchsorted(keys, edge), [len(keys)]])


def answers(chunks: DataFrame, buckets: int) -> DataFrame:
    """(chunk, kind, gram, bucket, all, fit, seen, kept): per chunk and bucket the
    training counts of its n-grams in hash order, all and (for chunks of the
    fitting part) in the fitting part;
    seen and kept: distinct n-grams with a training count, with and without that part."""

    def ask(batches):
        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk(r["vocabulary"], r["tokens"])
                for gram, keys, which in ((1, c.words, c.tokens), (2, c.pairs, c.pair)):
                    times = np.bincount(which, minlength=len(keys))
                    cut = _cuts(keys, buckets)
                    at = [b for b in range(buckets) if cut[b] < cut[b + 1]]
                    parts = [slice(cut[b], cut[b + 1]) for b in at]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r["chunk"]] * len(at), pa.int64()), pa.array([r["kind"]] * len(at), pa.int32()),
                        pa.array([gram] * len(at), pa.int32()), pa.array(at, pa.int32()),
                        pa.array([pack(np.diff(keys[p], prepend=np.uint64(0))) for p in parts], pa.binary()),
                        pa.array([pack(times[p]) for p in parts], pa.binary())],
                        ["chunk", "kind", "gram", "bucket", "keys", "times"])

    def total(f: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unpack(k), dtype=np.uint64) for k in f["keys"]]
        times = [unpack(t) for t in f["times"]]
        kinds = f["kind"].to_numpy()
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])
        n = int(at.max()) + 1
        every, fit = np.zeros(n, np.int64), np.zeros(n, np.int64)
        parts = [slice(e - len(k), e) for e, k in zip(ends, keys, strict=True)]
        for p, t, kind in zip(parts, times, kinds, strict=True):
            if kind != HELD:
                every[at[p]] += t.astype(np.int64)  # distinct within a chunk
            if kind == FIT:
                fit[at[p]] += t.astype(np.int64)
        out = f[["chunk", "kind", "gram", "bucket"]].copy()
        out["all"] = [pack(every[at[p]]) for p in parts]
        out["fit"] = [pack(fit[at[p]]) if kind == FIT else b"" for p, kind in zip(parts, kinds, strict=True)]
        first = np.arange(len(f)) == 0
        out["seen"] = np.where(first, int((every > 0).sum()), 0)
        out["kept"] = np.where(first, int((every > fit).sum()), 0)
        return out

    asked = chunks.select("chunk", "kind", "vocabulary", "tokens").mapInArrow(
        ask, "chunk long, kind int, gram int, bucket int, keys binary, times binary")
    return asked.groupBy("gram", "bucket").applyInPandas(
        total, "chunk long, kind int, gram int, bucket int, all binary, fit binary, seen long, kept long")


def _counts(answer: pd.DataFrame, column: str) -> dict[int, np.ndarray]:
    """gram -> counts in the order of the chunk's distinct n-grams."""
    rows = answer.drop_duplicates(["gram", "bucket"]).sort_values(["gram", "bucket"])
    return {g: np.concatenate([unpack(x) for x in part[column]]).astype(np.int64) for g, part in rows.groupby("gram")}


def _estimates(c: Chunk, one: np.ndarray, two: np.ndarray, n: int):
    """Per token: context bucket, bigram and unigram estimate."""
    times = one[c.tokens]
    end = np.searchsorted(c.words, END)
    context = np.empty_like(times)
    context[:1] = one[end]
    context[1:] = times[:-1]
    pair = two[c.pair]
    p2 = np.divide(pair, context, out=np.zeros(len(times)), where=context > 0)
    bucket = np.ceil(np.log2(context + 1.0)).astype(np.int64)  # 0: context not seen
    return bucket, p2, times / max(n, 1)


def fit_weights(histogram: list[tuple[int, int, int, float]], uniform: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights [context bucket][uniform, unigram, bigram] by expectation-
    maximisation. Histogram: (bucket, bigram step, unigram step, tokens), a step
    being FINE times -log2 of the estimate, -1 for an estimate of zero."""
    weights = np.full((64, 3), 1 / 3)
    weights[0] = 0.5, 0.5, 0.0
    if not histogram:
        return weights
    rows = np.array(histogram, float)
    bucket = rows[:, 0].astype(int)
    p = np.stack([np.full(len(rows), uniform), *(np.where(rows[:, k] < 0, 0.0, 2.0 ** (-rows[:, k] / FINE)) for k in (2, 1))], 1)
    for _ in range(rounds):
        joint = weights[bucket] * p
        joint /= joint.sum(1, keepdims=True)
        got = np.full((64, 3), 0.01)  # a trace of each, so no weight becomes zero
        got[0, 2] = 0.0
        np.add.at(got, bucket, joint * rows[:, 3:4])
        weights = got / got.sum(1, keepdims=True)
    # A bucket without held-out tokens takes the weights of the nearest lower one.
    some = np.bincount(bucket, rows[:, 3], minlength=64) > 0
    for b in range(2, 64):
        if not some[b] and some[1:b].any():
            weights[b] = weights[b - 1]
    return weights


def score_texts(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    chunks = saved(chunks_of(docs, chunk_tokens), "chunks")
    tokens = {r["kind"]: int(r["n"]) for r in chunks.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    n_fit = tokens.get(FIT, 0)
    n_train = tokens.get(TRAIN, 0) + n_fit
    buckets = 1 << max(3, (max(1, sum(tokens.values()) // bucket_keys) - 1).bit_length())
    replies = saved(answers(chunks, buckets), "answers")
    size = replies.where("gram = 1").agg(F.sum("seen").alias("seen"), F.sum("kept").alias("kept")).first()
    v_all, v_kept = int(size["seen"] or 0), int(size["kept"] or 0)
    n_kept = n_train - n_fit

    def spread(chunk: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        out = []
        every, own = _counts(answer, "all"), _counts(answer, "fit")
        for r in chunk.itertuples():
            c = Chunk(r.vocabulary, r.tokens)
            bucket, p2, p1 = _estimates(c, every[1] - own[1], every[2] - own[2], n_kept)
            step = [np.where(p > 0, np.rint(-np.log2(np.maximum(p, 1e-300)) * FINE), -1).astype(np.int64) for p in (p2, p1)]
            rows, times = np.unique(np.stack([bucket, *step], 1), axis=0, return_counts=True)
            out.append(pd.DataFrame(rows, columns=["bucket", "s2", "s1"]).assign(n=times))
        return pd.concat(out)

    def met(kinds):
        a, b = (t.where(kinds) if kinds is not None else t for t in (chunks, replies.drop("seen", "kept")))
        return a.groupBy("chunk").cogroup(b.groupBy("chunk"))

    histogram = (met(F.col("kind") == FIT).applyInPandas(spread, "bucket long, s2 long, s1 long, n long")
                 .groupBy("bucket", "s2", "s1").agg(F.sum("n").alias("n")).collect()) if n_fit and n_kept else []
    weights = fit_weights(sorted((r["bucket"], r["s2"], r["s1"], float(r["n"])) for r in histogram), 1 / (v_kept + 1))

    def score(chunk: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        out = []
        every = _counts(answer, "all")
        for r in chunk.itertuples():
            c = Chunk(r.vocabulary, r.tokens)
            sizes = np.frombuffer(r.sizes, "<u4").astype(np.int64)
            start = np.cumsum(sizes) - sizes
            bucket, p2, p1 = _estimates(c, every[1], every[2], n_train)
            w = weights[bucket]
            p = np.log10(w[:, 0] / (v_all + 1) + w[:, 1] * p1 + w[:, 2] * p2)
            times = every[1][c.tokens]
            base = np.log10((times + 0.5) / (n_train + 0.5 * (v_all + 1)))
            out.append(pd.DataFrame({
                "doc_id": pd.array([None if x is None or x != x else int(x) for x in r.ids], "Int64"),
                "held_out": r.kind == HELD, "n_tokens": sizes, "n_known": np.add.reduceat((times > 0).astype(np.int64), start),
                "train_tokens": n_train, "base_score": np.add.reduceat(base, start), "score": np.add.reduceat(p, start)}))
        return pd.concat(out)

    return met(None).applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                          "base_score double, score double")
