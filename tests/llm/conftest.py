import public_tokenizers
import pytest
from pyspark.sql import types as T

#: columns that clash with names the operators use inside
EXTRA = ("size", "n", "key", "score", "rank", "taken", "sid", "label", "shard", "_text", "target", "v")

LONG = " ".join(f"word{i % 977} and then some" for i in range(12_000))

#: (doc_id, text): nulls, empty and blank texts, copies, repeated rows, a very long text, odd characters
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank"),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, "Released under the MIT License.\nSecond line"),
    (7, "one two"),
    (8, "ONE two"),
    (9, LONG),
    (10, "a" * 30_000),
    (None, "no key but a text of several words here"),
    (None, None),
    (11, "Ünïcödé   İΣ 漢字 \x00 \x1c <|endoftext|> '%s"),
    (12, "!!! $$$ ### " * 50),
]


@pytest.fixture(scope="session")
def odd_documents(spark):
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    fields += [T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    fields += [T.StructField(c, T.StringType()) for c in EXTRA]
    rows = []
    for i, (key, text) in enumerate(TEXTS):
        source = (None, "b", "a", "c", "")[i % 5]
        rows.append((key, text, (None, "en")[i % 2], source, None if i % 3 else len(text or ""), *("x" for _ in EXTRA)))
    return spark.createDataFrame(rows, T.StructType(fields)).repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.filter("false")


@pytest.fixture(scope="session")
def word_file():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def piece_file():
    return public_tokenizers.path("piece_bpe_32k.model")
