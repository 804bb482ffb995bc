"""Byte-level BPE: encode texts to token ids and decode ids to bytes.

Two tiers. A minimal perfect hash over the vocabulary resolves a pre-token
that is a token itself with a few array reads and one comparison. Every other
pre-token starts as linked single bytes; a heap of (rank, position) merges the
lowest-ranked adjacent pair, leftmost first, until no pair is in the
vocabulary. Vocabulary (about 50,000 tokens, a fixed file) is loaded by each
Python worker from its path; no document leaves its task, nothing is shuffled.

Defined results: null text counts as empty; an empty text has no ids, and both
hashes are those of the empty byte string; special-token strings are ordinary
text; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import struct
from functools import lru_cache
from hashlib import sha256

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame

from offerflow.llm.common import Remembered, map_texts


class PerfectHash:
    """Minimal perfect hash of distinct byte strings onto 0..n-1.

    Level by level, keys that own a cell of a bit table alone settle there
    (their index is the rank of the bit); the others go on to the next,
    smaller table with another hash seed."""

    def __init__(self, keys: list[bytes], spread: float = 2.0):
        self.tables: list[np.ndarray] = []
        self.index = np.full(len(keys), -1, np.int64)
        left, settled = np.arange(len(keys)), 0
        while len(left):
            size = max(16, int(spread * len(left)))
            cell = np.array([self._hash(keys[i], len(self.tables)) for i in left], np.uint64) % np.uint64(size)
            cell = cell.astype(np.int64)
            alone = np.bincount(cell, minlength=size) == 1
            rank = np.where(alone, settled + np.cumsum(alone) - 1, -1)
            self.tables.append(rank)
            mine = alone[cell]
            self.index[left[mine]] = rank[cell[mine]]
            settled += int(alone.sum())
            left = left[~mine]
        self._lists = [t.tolist() for t in self.tables]

    @staticmethod
    def _hash(key: bytes, level: int) -> int:
        return xxhash.xxh3_64_intdigest(key, seed=level)

    def __call__(self, key: bytes) -> int:
        """The index of a member; any index or -1 for other keys."""
        for level, table in enumerate(self._lists):
            at = table[xxhash.xxh3_64_intdigest(key, seed=level) % len(table)]
            if at >= 0:
                return at
        return -1


class Codec:
    def __init__(self, tokens: dict[bytes, int], pattern: str):
        self.ranks = tokens
        self.pattern = regex.compile(pattern)
        keys = list(tokens)
        self.hash = PerfectHash(keys)
        self.slots: list[tuple[bytes, int]] = [(b"", -1)] * len(keys)
        for key, at in zip(keys, self.hash.index.tolist(), strict=True):
            self.slots[at] = (key, tokens[key])
        self.vocabulary = {i: t for t, i in tokens.items()}
        self._packed = Remembered(self._pack)

    def whole(self, piece: bytes) -> int:
        """First tier: the id of a pre-token that is itself a token, else -1."""
        at = self.hash(piece)
        if at >= 0:
            key, token = self.slots[at]
            if key == piece:
                return token
        return -1

    def merge(self, piece: bytes) -> list[int]:
        """Second tier: heap of adjacent pairs over linked byte spans."""
        n = len(piece)
        ranks = self.ranks
        end = list(range(1, n + 1))  # end[i]: where the span that starts at i ends; 0 when it was merged away
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(piece[i:i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            rank, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= stop or end[mid] != stop:
                continue  # one of the two spans has changed since
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                last = end[stop]
                rank = ranks.get(piece[i:last])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, last))
            first = before[i]
            if first >= 0:
                rank = ranks.get(piece[first:stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, first, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._packed.__getitem__, self.pattern.findall(text)))

    def _pack(self, piece: str) -> bytes:
        raw = piece.encode()
        token = self.whole(raw)
        if token >= 0:
            return token.to_bytes(4, "little")
        ids = self.merge(raw)
        return struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def codec(path: str | None = None) -> Codec:
    """The codec of a rank file, once per Python process. The path is one that
    every worker can open; None: the installed multi-language vocabulary."""
    import public_tokenizers

    return Codec(read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def encode_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every document, as array<int>."""

    def row(state: Codec, doc_id, text):
        return doc_id, np.frombuffer(state.encode(text or ""), "<u4").astype(np.int32).tolist()

    return map_texts(docs, ["doc_id", "text"], row, "doc_id long, ids array<int>", lambda: codec(path))


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text): the bytes of the ids as UTF-8 (invalid sequences replaced)."""

    def row(state: Codec, doc_id, ids):
        return doc_id, state.decode(np.array(ids or [], "<u4").tobytes()).decode("utf-8", "replace")

    return map_texts(encoded, ["doc_id", "ids"], row, "doc_id long, text string", lambda: codec(path))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, decode again, and return counts and hashes of both per document."""

    def row(state: Codec, doc_id, text):
        ids = state.encode(text or "")
        return doc_id, len(ids) // 4, sha256(ids).hexdigest(), sha256(state.decode(ids)).hexdigest()

    return map_texts(docs, ["doc_id", "text"], row,
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: codec(path))
