import pytest
from pyspark.sql import functions as F

from quillweave.functions.fixed import CORPORA
from quillweave.operators import gate, qa
from quillweave.operators.masking import MASKERS
from quillweave.operators.turns import conversation_rows
from quillweave.plans import builds


def rows(df):
    return sorted((r["row_id"], r["q"], r["a"]) for r in df.collect())


def test_registries_hold_every_corpus():
    assert tuple(qa.QA_BUILDERS) == CORPORA == tuple(MASKERS)


def test_trim_and_drop_empty(spark):
    df = spark.createDataFrame(
        [(0, " a\n", "b "), (1, "", "b"), (2, "a", " 　"), (3, None, "b"), (4, "a", None)],
        "row_id bigint, article string, highlights string",
    )
    assert rows(qa.qa_cnn_daily_mail(df)) == [(0, "a", "b")]


def test_required_column_missing_is_an_error(spark):
    df = spark.createDataFrame([(0, "a")], "row_id bigint, article string")
    with pytest.raises(Exception, match="highlights"):
        qa.qa_cnn_daily_mail(df)


def test_optional_column_missing_is_empty(spark):
    df = spark.createDataFrame([(0, "p", "a")], "row_id bigint, prompt string, answer string")
    assert rows(qa.qa_hk_o1aw(df)) == [(0, "p", "a")]
    assert rows(qa.qa_numina_math(spark.createDataFrame([(0, "p")], "row_id bigint, problem string"))) == []


def test_joining_rule(spark):
    df = spark.createDataFrame(
        [(0, "s", "r ", " t"), (1, "s", None, "t"), (2, "s", "r", ""), (3, "s", None, None)],
        "row_id bigint, source string, rationale string, target string",
    )
    assert rows(qa.qa_kaist_cot(df)) == [(0, "s", "r\n\nFinal Answer:\nt"), (1, "s", "t"), (2, "s", "r")]


def test_cut_chain(spark):
    df = spark.createDataFrame(
        [(0, "q", " c #### z #### y", "a"), (1, "q", "#### z", "a"), (2, "q", "c", None)],
        "row_id bigint, question string, longCOT string, answer string",
    )
    assert rows(qa.qa_o1_journey(df)) == [(0, "q", "c\n\nFinal Answer:\na"), (1, "q", "a"), (2, "q", "c")]


def test_steps(spark):
    df = spark.createDataFrame(
        [
            (0, "p", [" a ", "", None, "b"], -1, True), (1, "p", ["a"], 0, True),
            (2, "p", ["a"], -1, None), (3, "p", [" "], -1, True), (4, "p", None, -1, True),
        ],
        "row_id bigint, problem string, steps array<string>, label int, final_answer_correct boolean",
    )
    assert rows(qa.qa_process_bench(df)) == [(0, "p", "a\nb")]


def test_news_keeps_empty_lines_inside(spark):
    df = spark.createDataFrame(
        [(0, "h", None, "b", "r"), (1, None, None, "b ", "r"), (2, None, None, None, "r")],
        "row_id bigint, headLine string, broadcastDate string, newsBeginning string, newsRemainder string",
    )
    assert rows(qa.qa_uhgeval(df)) == [(0, "h\n\nb", "r"), (1, "b", "r")]


def test_conversation_pairs_from_lists_and_from_rows(spark):
    data = [(0, ["a ", "b", "c", "d", "odd"]), (1, ["a"]), (2, []), (3, None), (4, ["", "b", "c", "d"])]
    lists = spark.createDataFrame(data, "row_id bigint, conversations array<string>")
    wanted = [(0, 0, "a", "b"), (0, 1, "c", "d"), (4, 1, "c", "d")]
    got = sorted((r["row_id"], r["pair"], r["q"], r["a"]) for r in qa.qa_lima(lists).collect())
    assert got == wanted
    turns = lists.select("row_id", F.posexplode("conversations").alias("pos", "text"))
    got = sorted(tuple(r) for r in qa.qa_from_turns(turns, "row_id").collect())
    assert got == wanted


def test_repeated_positions_are_refused(spark):
    turns = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 1, "c")], "conv_id bigint, pos bigint, text string")
    with pytest.raises(Exception, match="repeats within a conversation"):
        qa.qa_from_turns(turns).collect()


def test_conversation_rows_keep_every_turn(spark):
    data = [(1, 2, "c"), (1, 0, "a"), (1, 1, "b"), (2, 0, "x" * 40_000), (2, 1, "y" * 40_000), (3, 5, "é"), (4, 1, "q"), (4, 1, "p")]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, text string")
    got = {r["conv_id"]: r["conversations"] for r in conversation_rows(df).collect()}
    assert got == {1: ["a", "b", "c"], 2: ["x" * 40_000, "y" * 40_000], 3: ["é"], 4: ["p", "q"]}
    pairs = gate.with_validity(MASKERS["lima"](conversation_rows(df), ["conv_id"]))
    assert {r["conv_id"]: r["is_valid"] for r in pairs.collect()} == {1: True, 2: True, 3: False, 4: True}


def test_builds(spark):
    corpora = {
        "cnn_daily_mail": spark.createDataFrame([(i, f"article {i} text", "h") for i in range(25)], "row_id bigint, article string, highlights string"),
        "lima": spark.createDataFrame([(i, ["a", "b", "c", "d"]) for i in range(6)], "row_id bigint, conversations array<string>"),
    }
    built = builds.build_qa(corpora).groupBy("subset", "split").count().collect()
    assert {(r["subset"], r["split"]): r["count"] for r in built} == {
        ("cnn_daily_mail", "train"): 22, ("cnn_daily_mail", "test"): 3, ("lima", "train"): 10, ("lima", "test"): 2,
    }
    pairs = builds.build_pairs(corpora, ["lima"])
    assert pairs.count() == 6 and pairs.filter("not is_valid").count() == 0
    with pytest.raises(KeyError, match="nope"):
        builds.build_pairs(corpora, ["nope"])
