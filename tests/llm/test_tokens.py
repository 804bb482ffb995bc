"""Byte-level BPE and unigram counts against the public libraries."""

import random

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from offerflow.llm import bpe, token_counts
from tests.llm.conftest import by_id

TRICKY = [None, "", " ", "\n\n\t ", "a" * 5000 + "é" * 300, "Hello  wörld\r\n 12345 漢字😀 ▁x", "don't they'll",
          "<|endoftext|>", "\u0085   x\x1c", "of of", "of of"]


def reference():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def unigram():
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [("<unk>", 0.0)] + [(model.id_to_piece(i), model.get_score(i)) for i in range(3, model.get_piece_size())]
    return Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))


ENC, UNI = reference(), unigram()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_tiktoken(text):
    ids = bpe.codec().encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == ENC.encode_ordinary(text)
    assert bpe.codec().decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\tthe ing▁é漢😀ab1.'", min_size=1, max_size=60))
def test_unigram_counts_equal_library(text):
    assert token_counts.counter().count(text)[0] == len(UNI.encode("▁" + text.replace(" ", "▁")).ids)


def test_perfect_hash_is_minimal_and_refuses_strangers():
    codec = bpe.codec()
    assert sorted(codec.hash.index.tolist()) == list(range(len(codec.ranks)))
    assert codec.whole(b" the") == codec.ranks[b" the"]
    assert codec.whole(b"no such token, surely") == -1


def test_heap_merges_leftmost_of_equal_ranks():
    codec = bpe.Codec({bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaa": 300}, public_tokenizers.PATTERN)
    assert codec.merge(b"aaaa") == [256, 256]
    assert codec.merge(b"aaaaa") == [256, 300]


def test_unigram_tie_goes_to_the_earlier_start():
    counter = token_counts.Counter({"a": -1.0, "b": -1.0, "c": -1.0, "ab": -1.5, "bc": -1.5, "abc": -2.5, "▁": -1.0})
    assert counter.solve("abc") == (1, -2.5)  # abc, ab+c and a+bc tie at -2.5
    assert counter.solve("xé")[0] == 3  # unknown characters count their bytes


def test_a_long_word_without_spaces_takes_bounded_memory():
    import tracemalloc

    counter = token_counts.counter()
    word = "".join(random.Random(3).choices("abcdefgh\u6f22\u5b57", k=150_000))
    encoded = UNI.encode(word[:20_000])
    text = token_counts.MARK + word[:20_000]
    assert counter.solve(text)[0] == len(UNI.encode(text).ids) and len(encoded.ids) > 1000
    tracemalloc.start()
    counter.count(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(word)  # copies of the text, nothing per match


def test_queries_on_tricky_rows(table):
    docs = table(TRICKY)
    out = by_id(bpe.round_trip(docs))
    for i, text in enumerate(TRICKY):
        ids = np.array(ENC.encode_ordinary(text or ""), "<u4").tobytes()
        assert (out[i].n_tokens, out[i].ids_sha256) == (len(ids) // 4, bpe.sha256(ids).hexdigest())
        assert out[i].decoded_sha256 == bpe.sha256((text or "").encode()).hexdigest()
    counts = by_id(token_counts.token_counts(docs))
    assert counts[0].n_tokens == counts[1].n_tokens == 0 and counts[9].n_tokens == counts[10].n_tokens
    assert counts[5].n_tokens == len(UNI.encode("▁" + TRICKY[5].replace(" ", "▁")).ids)
    back = by_id(bpe.decode_ids(bpe.encode_ids(docs)))
    assert [back[i].text for i in range(len(TRICKY))] == [t or "" for t in TRICKY]
    assert bpe.round_trip(docs.limit(0)).collect() == [] == token_counts.token_counts(docs.limit(0)).collect()


def test_memory_of_solved_words_is_bounded_and_right():
    from offerflow.llm.common import Remembered

    calls = []
    memory = Remembered(lambda k: calls.append(k) or k * 2, limit=3)
    random.seed(1)
    assert all(memory[k] == 2 * k for k in (random.randrange(6) for _ in range(200)))
    assert len(memory) <= 3 and len(memory.old) <= 3
