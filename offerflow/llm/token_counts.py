"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each
position; the dynamic programme carries only the best score and its piece
count per position, no back pointers and no pieces. Tie rule of the unigram
tokenizer: among equal scores the candidate that starts first stays (its last
piece is the longest). A character without a piece of its own may stand as an
unknown one at the lowest score minus 10; it counts as its UTF-8 bytes, as the
vocabulary falls back to byte pieces.

No piece has a word mark after another character, and none holds a line break,
tab or carriage return (checked when the vocabulary is loaded), so best paths
pass through the start of every word and such characters: each word is solved
alone and remembered. Scores are added in double precision, as the public
``tokenizers`` unigram model does, whose counts these equal.

Defined results: null text counts as empty, an empty text has no pieces and
score 0; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from offerflow.llm.common import Remembered, map_texts

MARK = "▁"
#: Unigram tokenizers score an unknown character this much below the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Words of more characters are solved anew each time, so that none of them stays in memory.
REMEMBERED = 256


class Counter:
    def __init__(self, pieces: dict[str, float]):
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        inner = any(MARK in p.lstrip(MARK) for p in pieces)
        breaks = "".join(c for c in "\n\t\r" if not any(c in p for p in pieces))
        self.split = re.compile(".+" if inner else f"{MARK}*[^{MARK}{breaks}]+|{MARK}+|[{breaks}]"
                                if breaks else f"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        self._solved = Remembered(self.solve)

    def solve(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best path through one word."""
        n = len(word)
        if not n:
            return 0, 0.0
        # No path reaches back further than the longest piece, and matches come in order of
        # their ends, so a ring of that length holds all that is needed of a word of any size.
        ring = self.longest + 1
        score, count = [0.0] * ring, [0] * ring
        found = self.machine.iter(word)
        end, match = next(found, (n, None))
        for at in range(n):
            ending = []
            while end == at:
                ending.append(match)
                end, match = next(found, (n, None))
            best, pieces = None, 0
            for length, value in sorted(ending, reverse=True):  # earliest start first; a tie keeps it
                total = score[(at + 1 - length) % ring] + value
                if best is None or total > best:
                    best, pieces = total, count[(at + 1 - length) % ring] + 1
            if word[at] not in self.single:
                total = score[at % ring] + self.unknown
                if best is None or total > best:
                    best, pieces = total, count[at % ring] + len(word[at].encode())
            score[(at + 1) % ring], count[(at + 1) % ring] = best, pieces
        return count[n % ring], score[n % ring]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        pieces, score = 0, 0.0
        for word in self.split.findall(MARK + text.replace(" ", MARK)):
            n, s = self._solved[word] if len(word) <= REMEMBERED else self.solve(word)
            pieces += n
            score += s
        return pieces, score


@lru_cache(maxsize=2)
def counter(path: str | None = None) -> Counter:
    """The counter of a piece model, once per Python process: its normal pieces
    and their scores are read as a unigram vocabulary."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    ids = [i for i in range(model.get_piece_size())
           if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Counter({model.id_to_piece(i): model.get_score(i) for i in ids})


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_chars, n_tokens, best_score) of every document."""

    def row(state: Counter, doc_id, text):
        return doc_id, len(text or ""), *state.count(text or "")

    return map_texts(docs, ["doc_id", "text"], row, "doc_id long, n_chars long, n_tokens long, best_score double",
                     lambda: counter(path))
