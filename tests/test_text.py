import pytest
from pyspark.sql import functions as F

from quillweave.functions.fixed import PYTHON_SPACE
from quillweave.functions.text import canonical, fill, joined_answer, strip


def test_space_list_is_pythons():
    assert set(PYTHON_SPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_strip_and_canonical_follow_python(spark):
    texts = ["", "  ", "\n a\t", " x　", "a b", "\x1f\x85x", "x​", "\U0001f600 ", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", strip(F.col("t")).alias("s"), canonical(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r["s"] for r in got] == [t if t is None else t.strip() for t in texts]
    assert [r["c"] for r in got] == ["" if t is None else t.strip() for t in texts]


def test_canonical_of_numbers(spark):
    assert spark.range(3, 4).select(canonical(F.col("id"))).first()[0] == "3"


@pytest.mark.parametrize(
    "first,last,wanted",
    [("t", "a", "t\n\nFinal Answer:\na"), ("", "a", "a"), ("t", "", "t"), ("", "", "")],
)
def test_joined_answer(spark, first, last, wanted):
    assert spark.range(1).select(joined_answer(F.lit(first), F.lit(last))).first()[0] == wanted


def test_fill_counts_places():
    with pytest.raises(ValueError):
        fill("{} {}")
