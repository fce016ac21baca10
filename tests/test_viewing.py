import pytest
from pyspark.sql import functions as F

from quillweave.operators import viewing


def test_row_format(spark):
    df = spark.createDataFrame(
        [(0, "q", "r", None), (1, "q", "", []), (2, None, "r", None), (3, "q", "r", ["m"])],
        "i int, query string, response string, messages array<string>",
    )
    got = [r[1] for r in df.select("i", viewing.row_format(df)).orderBy("i").collect()]
    assert got == ["pair", "messages", "unknown", "pair"]
    bare = spark.range(1)
    assert bare.select(viewing.row_format(bare)).first()[0] == "unknown"


@pytest.mark.parametrize("start,size", [(0, 1), (0, 10), (57, 25), (295, 10), (300, 5), (10, 0), (0, 300)])
def test_page(spark, start, size):
    keys = sorted({(i * i * 7919) % 100_003 - 50 for i in range(300)})
    df = spark.createDataFrame([(k, str(k)) for k in keys], "k bigint, t string")
    got = sorted((r["rank"], r["k"], r["t"]) for r in viewing.page(df, "k", start, size).collect())
    assert got == [(i, k, str(k)) for i, k in enumerate(keys)][start : start + size]


@pytest.mark.parametrize("few", [3, 20_000])
def test_page_of_outliers_and_full_range(spark, monkeypatch, few):
    monkeypatch.setattr(viewing, "FEW_ROWS", few)
    keys = sorted([-(1 << 63), (1 << 63) - 1, *range(0, 4000, 3), 10**15, 10**15 + 1])
    df = spark.createDataFrame([(k,) for k in [*keys, None]], "k bigint")
    for start, size in ((0, 2), (500, 7), (len(keys) - 3, 10)):
        got = sorted((r["rank"], r["k"]) for r in viewing.page(df, "k", start, size).collect())
        assert got == list(enumerate(keys))[start : start + size]


def test_page_bounds(spark):
    with pytest.raises(ValueError):
        viewing.page(spark.range(3), "id", -1, 2)
    assert viewing.page(spark.range(0), "id", 0, 2).count() == 0


def test_display_text(spark):
    text = "\\(a\\) \\[b\\]\n<i> \\"
    row = spark.range(1).select(
        viewing.display_text(F.lit(text)), viewing.display_text(F.lit(text), latex=True)
    ).first()
    assert row[0] == "$a$ $b$<br>&lt;i&gt; \\"
    assert row[1] == "\\(a\\) \\[b\\]<br>&lt;i&gt; \\"


def test_message_blocks(spark):
    df = spark.createDataFrame(
        [(0, [("user", "a"), ("assistant", "b")]), (1, [])], "k int, messages array<struct<role:string,content:string>>"
    )
    got = sorted(tuple(r) for r in viewing.message_blocks(df, ["k"]).collect())
    assert got == [(0, 0, "USER", "a"), (0, 1, "ASSISTANT", "b")]


def test_indexed_pages(spark, tmp_path):
    """Keys with gaps, outliers and nulls; every page equals the counted one, and is bounded by keys in its scan."""
    keys = [*range(0, 3000, 7), -(10**15), 10**15, 5_000_001]
    df = spark.createDataFrame([(k, f"t{k}") for k in keys] + [(None, "x")], "k long, t string").repartition(3)
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    index = viewing.write_page_index(stored, "k", str(tmp_path / "index"), step=50)
    want = sorted(keys)
    for start, size in ((0, 10), (49, 2), (50, 100), (len(keys) - 3, 20), (len(keys), 5), (10, 0)):
        rows = sorted((r["rank"], r["k"]) for r in viewing.indexed_page(stored, "k", index, start, size).collect())
        assert rows == [(i, want[i]) for i in range(start, min(start + size, len(want)))]
    with pytest.raises(ValueError):
        viewing.indexed_page(stored, "k", index, -1, 2)
    empty = viewing.write_page_index(stored.filter("false"), "k", str(tmp_path / "none"))
    assert viewing.indexed_page(stored.filter("false"), "k", empty, 0, 5).count() == 0
