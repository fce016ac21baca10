"""Cross-tokenizer alignment against a comparison of all token pairs."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillweave.llm import token_overlap
from quillweave.llm.bpe_stream import byte_symbols
from tests.llm.conftest import TEXTS
from tests.llm.test_codecs import random_texts

BACK = {s: b for b, s in enumerate(byte_symbols())}


@pytest.fixture(scope="module")
def files():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries(files):
    library = Tokenizer.from_file(files[0])
    library.encode_special_tokens = True
    return library, sentencepiece.SentencePieceProcessor(model_file=files[1])


def by_hand(libraries, texts):
    """Tokens, links, groups and scores, every pair of tokens compared."""
    one, other = libraries
    docs = []
    for text in texts:
        a = b = []
        if text:
            a = one.encode(" " + text, add_special_tokens=False).ids
            b = other.encode(text)
        bytes_a = [one.id_to_token(i).encode() if one.id_to_token(i) == "<|endoftext|>" else bytes(BACK[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[1:-1], 16)]) if other.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, other.id_to_piece(i)) for i in b)]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            a = b = bytes_a = bytes_b = []

        def ranges(parts):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            return out

        range_a, range_b = ranges(bytes_a), ranges(bytes_b)
        links = [(i, j) for i, (s, e) in enumerate(range_a) for j, (t, f) in enumerate(range_b) if s < f and t < e]
        ends = sorted({e for _, e in range_a} & {e for _, e in range_b})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, (_, e) in zip(ids, spans) if start < e <= end) for ids, spans in ((a, range_a), (b, range_b))))
            start = end
        docs.append((a, b, links, groups))
    counts = Counter((a[i], b[j]) for a, b, links, _ in docs for i, j in links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    rows = []
    for a, b, links, groups in docs:
        n = [counts[a[i], b[j]] for i, j in links]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), len(groups), len(links), sum(x == best[b[j]] for x, (_, j) in zip(n, links)), sum(n), digest))
    return rows


ODD = ["▁", "a▁b", "<s> x </s>", "<|endoftext|>", "  two  spaces ", "\n\n x", "Ünïcödé 漢字 👍🏽\U0001e900", "é" * 40, "x\x00y", "0x41 <0x41>", "ab" * 300, "'s 're don't"]


@pytest.mark.parametrize("sent", [token_overlap.SENT_PAIRS, 0])
def test_query_by_brute_force(spark, files, libraries, sent):
    texts = [t for _, t in TEXTS if t is None or len(t) < 2000] + ODD + random_texts(150, seed=12) + ["the same text here"] * 30
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, row int").repartition(3)
    result = token_overlap.overlaps(df, *files, sent=sent)
    assert result.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [t for _, t in result.dtypes] == ["bigint"] * 7 + ["string"]
    got = [tuple(r)[1:] for r in sorted(result.collect())]
    assert got == by_hand(libraries, texts)


def test_spans(spark, files, libraries):
    texts = ["A text of two tokenizers.", "", "encyclopaedia 漢字"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for row, want in zip(sorted(token_overlap.spans(df, *files).collect()), by_hand(libraries, texts)):
        assert (len(row.a_ids), len(row.b_ids), len(row.groups), len(row.links)) == want[:4]
        cuts = [*row.groups, None]
        said = ";".join(
            ",".join(map(str, row.a_ids[c.a : d and d.a])) + "|" + ",".join(map(str, row.b_ids[c.b : d and d.b])) for c, d in zip(cuts, cuts[1:])
        )
        assert (hashlib.sha256(said.encode()).hexdigest() if said else "") == want[-1]


def test_fast_ranks_equal_the_file(files, libraries):
    """Below ``SETTLED`` both libraries split alike: every character, in several places."""
    side = token_overlap.ByteLevel(files[0])
    texts = [f"a{c}b {c}{c} 1{c}2  {c} {c}'s" for c in map(chr, range(ord(token_overlap.SETTLED)))]
    texts += random_texts(2000, seed=7) + ["<|endoftext|>"]
    assert side.encode(texts) == [libraries[0].encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_documents(odd_documents, no_documents, files):
    rows = token_overlap.overlaps(odd_documents, *files).collect()
    assert len(rows) == len(TEXTS)
    assert all((r.n_links == r.n_a + r.n_b - r.n_groups) and (r.groups_sha256 == "") == (r.n_a == 0) for r in rows)
    assert sum(r.n_a == 0 for r in rows) == 3
    assert token_overlap.overlaps(no_documents, *files).count() == 0
