"""Token counts and the streaming codec against the libraries."""

import random
from array import array

import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillweave.llm import bpe_stream, token_count
from tests.llm.conftest import TEXTS

PARTS = [
    "a", "b", "the", " ", "  ", "\n", "'s", "'re", "\x1c", "\x85", "é", "é", "İ", "Σ", "ΑΣ", "ς", "1", "٣", "½", "!!", "$",
    "<|endoftext|>", "<|startoftext|>", "</w>", "▁", "漢", "👍🏽", "̸", "ﬁ", "ẞ", "\x00", "﻿", "　", "ing" * 50, "한",
]


def random_texts(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def counter(piece_file):
    return token_count.PieceCounter(piece_file)


@pytest.fixture(scope="module")
def coders(word_file):
    return bpe_stream.StreamEncoder(word_file), bpe_stream.StreamDecoder(word_file)


def coded(coders, text):
    encoder, decoder = coders
    ids, said = b"", ""
    for block in encoder.encode(text):
        ids += block
        said += decoder.push(block)
    return ids, said + decoder.finish()


def by_library(tokenizer, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    return array("I", ids).tobytes(), tokenizer.decode(ids, skip_special_tokens=False)


def test_counts_equal_the_library(counter, piece_file):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_file)
    texts = random_texts(3000) + ["".join(random.Random(3).choice("ab \n") for _ in range(5000))]
    assert [counter.count(t) for t in texts] == [len(library.encode(t)) for t in texts]


def test_codec_equals_the_library(coders, word_file):
    library = Tokenizer.from_file(word_file)
    for text in random_texts(3000):
        assert coded(coders, text) == by_library(library, text), repr(text)


@pytest.mark.parametrize("letters", ["ab", "in", "thean", "aing", "erono", "esst", "lo", "0"])
def test_windows_of_long_words(coders, word_file, letters):
    """Words far longer than the window: what is emitted early must be what the whole word gives."""
    library = Tokenizer.from_file(word_file)
    r = random.Random(letters)
    for n in (1500, 9000):
        text = "".join(r.choice(letters) for _ in range(n))
        assert coded(coders, text) == by_library(library, text)


def test_window_stays_small(coders):
    encoder, _ = coders
    word = bpe_stream.WordTransducer(encoder.merges, encoder.suffix, encoder.lookahead)
    out = 0
    for _ in range(50):
        out += sum(len(t) for t in word.push("thon" * 200))
        assert len(word.held) <= word.window
    assert out > 35_000


def test_lookahead_of_a_small_merge_list():
    merges = bpe_stream.MergeList([("a", "b"), ("b", "c"), ("c", "a"), ("ab", "c")], {"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "ca": 5, "abc": 6})
    reach = merges.lookahead()
    r = random.Random(0)
    for _ in range(300):
        text = "".join(r.choice("abc") for _ in range(40))
        whole = merges.merge(list(text))
        for cut in range(reach, 40):
            at = 0
            for mine, full in zip(merges.merge(list(text[:cut])), whole):
                if at + len(mine) > cut - reach:
                    break
                assert mine == full
                at += len(mine)


def test_bytes_come_back(coders, word_file):
    encoder, _ = coders
    decoder = bpe_stream.StreamDecoder(word_file, style="bytes")
    text = "grün 漢字 été x"
    said = "".join(decoder.push(b) for b in encoder.encode(text)) + decoder.finish()
    assert said.split() == text.split()


def test_split_characters_wait(word_file):
    decoder = bpe_stream.StreamDecoder(word_file, style="bytes")
    symbols = bpe_stream.byte_symbols()
    encoder = bpe_stream.StreamEncoder(word_file)
    ids = [array("I", [encoder.vocab[symbols[b]]]).tobytes() for b in "漢".encode()]
    assert [decoder.push(i) for i in ids] == ["", "", "漢"]


def test_operators_on_odd_rows(odd_documents, no_documents, word_file, piece_file):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_file)
    tokenizer = Tokenizer.from_file(word_file)
    counts = token_count.over_limit(token_count.token_counts(odd_documents, piece_file), 4096)
    want = sorted(((k, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for k, t in TEXTS), key=repr)
    assert sorted(map(tuple, counts.collect()), key=repr) == want
    coded_rows = bpe_stream.encode_decode(odd_documents, word_file).collect()
    want = sorted(((k, len(p[0]) // 4, p[0], p[1]) for k, t in TEXTS for p in [by_library(tokenizer, t or "")]), key=repr)
    assert sorted(((r[0], r[1], bytes(r[2]), r[3]) for r in coded_rows), key=repr) == want
    assert token_count.token_counts(no_documents, piece_file).collect() == []
    assert bpe_stream.encode_digests(no_documents, word_file).collect() == []
