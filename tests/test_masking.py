import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillweave.functions import fixed
from quillweave.functions.grammar import DEFAULT as G
from quillweave.functions.wording import DEFAULT as W
from quillweave.operators import gate, masking


def texts(n=300):
    rng = random.Random(2)
    alphabet = "ab \nçß中\U0001f600<|>"
    sizes = [0, 1, 2, 3, 5, 8] + [rng.randrange(10, 400) for _ in range(n)]
    return ["".join(rng.choice(alphabet) for _ in range(k)) for k in sizes]


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(list(enumerate(texts())), "row_id bigint, article string")


def test_filling_in_gives_the_text_again(articles):
    pairs = masking.mask_cnn_daily_mail(articles)
    restored = pairs.select("row_id", G.restore(F.col("query"), F.col("response")).alias("t"))
    got = {r["row_id"]: r["t"] for r in restored.collect()}
    assert got == dict(enumerate(texts()))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab\n é\U0001f600　", max_size=60), min_size=1, max_size=40), st.integers(0, 10**6))
def test_round_trip_property(spark, batch, seed):
    df = spark.createDataFrame(list(enumerate(batch)), "row_id bigint, article string")
    pairs = masking.mask_cnn_daily_mail(df, seed=seed)
    rows = pairs.select("row_id", G.restore(F.col("query"), F.col("response")).alias("t")).collect()
    assert {r["row_id"]: r["t"] for r in rows} == dict(enumerate(batch))


def test_ranges_are_sorted_disjoint_and_inside(articles):
    n = F.char_length("article")
    rows = articles.select(
        n.alias("n"),
        masking.mask_count(n, 4, 1, F.col("row_id")).alias("m"),
    ).withColumn("id", F.monotonically_increasing_id()).select(
        "n", "m", masking.mask_ranges(F.col("n"), F.col("m"), 1, F.col("id")).alias("r")
    ).collect()
    assert any(r["m"] == 0 for r in rows) and any(r["m"] > 3 for r in rows)
    for row in rows:
        flat = [x for r in row["r"] for x in (r["s"], r["e"])]
        assert len(row["r"]) == row["m"]
        assert flat == sorted(set(flat))
        assert all(0 <= x < row["n"] for x in flat)  # so the last character is never masked


def test_short_texts_hold_fewer_masks(spark):
    df = spark.range(3000).select(F.lit("abc").alias("t"), "id")
    top = df.select(masking.mask_count(F.char_length("t"), 4, 0, F.col("id")).alias("m")).agg(F.max("m")).first()[0]
    assert top == 1


def test_positions_are_uniform(spark):
    df = spark.range(4000).select("id", F.lit(10).alias("n"), F.lit(2).alias("m"))
    rows = (
        df.select(F.explode(masking.mask_ranges(F.col("n"), F.col("m"), 0, F.col("id"))).alias("r"))
        .select(F.explode(F.array("r.s", "r.e")).alias("p"))
        .groupBy("p")
        .count()
        .collect()
    )
    counts = [r["count"] for r in rows]
    assert len(counts) == 10 and sum(counts) == 16000
    assert sum((c - 1600) ** 2 / 1600 for c in counts) < 28  # 0.1% point, 9 degrees


def test_all_four_shapes_occur(articles):
    query = masking.mask_cnn_daily_mail(articles).agg(F.concat_ws("", F.collect_list("query"))).first()[0]
    assert re.search(r'<\|MASKED id="m_\d+"\|>', query) and "<|MASKED|>" in query
    assert f'<|MASKED desc="{W.span_plain}"|>' in query
    assert re.search(rf'<\|MASKED id="m_\d+" desc="{W.span_numbered}"\|>', query)


def test_result_does_not_depend_on_partitions(spark, articles):
    def rows(df):
        return sorted(map(tuple, masking.mask_cnn_daily_mail(df, seed=3).collect()))

    assert rows(articles.repartition(7)) == rows(articles.coalesce(1))
    assert rows(articles) != sorted(map(tuple, masking.mask_cnn_daily_mail(articles, seed=4).collect()))


def test_null_text_is_set_aside(spark):
    df = spark.createDataFrame([(0, None), (1, "some text")], "row_id bigint, article string")
    good, bad = gate.split_valid(masking.mask_cnn_daily_mail(df))
    assert [r["row_id"] for r in good.collect()] == [1]
    assert [r["row_id"] for r in bad.collect()] == [0]


def test_delimiter_in_the_text_is_set_aside_or_refused(spark):
    df = spark.createDataFrame([(0, "a <|MASKED|> b " * 9)], "row_id bigint, article string")
    pairs = masking.mask_cnn_daily_mail(df)
    good, bad = gate.split_valid(pairs)
    assert (good.count(), bad.count()) == (0, 1)
    with pytest.raises(Exception, match="bad masked pair"):
        gate.require_valid(pairs).collect()
    with pytest.raises(Exception, match="bad masked pair"):
        gate.require_valid(pairs).select("row_id").collect()
    fine = masking.mask_cnn_daily_mail(spark.createDataFrame([(0, "a b " * 9)], df.schema))
    assert gate.require_valid(fine).collect() == fine.collect()


# ---- tagged reasoning ------------------------------------------------------------------------
def python_tags(text):
    found = re.findall(r"[<‹](\w+)[>›](.*?)(?:</|‹/|</›)\1[>›]", text or "", re.DOTALL)
    last = {name: value.strip() for name, value in found}
    return tuple(last.get(n, "") for n in fixed.REASONING_TAGS)


def test_tag_extraction_follows_python(spark):
    rng = random.Random(1)
    pieces = [f"{o}{n}{e}" for n in ("thinking", "output", "other", "réf") for o, e in ("<>", "‹›", "<›")]
    pieces += [f"{c}{n}{e}" for n in ("thinking", "output", "other", "réf") for c in ("</", "‹/", "</›") for e in ">›"]
    pieces += [" ", "\n", "x", "<", "　"]
    cases = [None, "", "<thinking>a</thinking><thinking> b </thinking>", "<other><output>x</output></other>"]
    cases += ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(600)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    rows = df.select("i", masking.extract_tags(F.col("t")).alias("x")).orderBy("i").collect()
    assert [tuple(r["x"]) for r in rows] == [python_tags(c) for c in cases]
    assert any(any(python_tags(c)) for c in cases)


def test_structured_needs_all_tags(spark):
    full = "".join(f"<{n}> {n[:3]} </{n}>" for n in fixed.REASONING_TAGS)
    df = spark.createDataFrame(
        [(0, " q ", full), (1, "q", full + "<output> </output>"), (2, "q", "<output>x</output>"), (3, "q", None)],
        "row_id bigint, question string, generation string",
    )
    (row,) = masking.mask_gsm8k_reasoning(df).collect()
    assert row["row_id"] == 0
    assert row["query"] == "<|M_INPUT|>q" + "".join(
        f'\n\n<|MASKED desc="{d}"|><|/MASKED|>' for d in W.tag_desc
    ) + "<|/M_INPUT|>"
    assert row["response"] == "<|M_OUTPUT|>" + "".join(
        f'<|MASKED id="m_{i}"|>{n[:3]}<|/MASKED|>' for i, n in enumerate(fixed.REASONING_TAGS)
    ) + "<|/M_OUTPUT|>"


# ---- the other rules ----------------------------------------------------------------------------
def valid_share(df):
    return gate.with_validity(df).agg(F.avg(F.col("is_valid").cast("int"))).first()[0]


def test_between_uses_every_layout(spark):
    df = spark.range(300).select(
        F.col("id").alias("row_id"), F.lit(" p ").alias("prompt"), F.lit("t ").alias("thinking"), F.lit(" a").alias("answer")
    )
    pairs = masking.mask_hk_o1aw(df)
    rows = pairs.collect()
    wanted = {
        "<|M_INPUT|>" + lay.format("p", f'<|MASKED desc="{d}"|><|/MASKED|>', " a") + "<|/M_INPUT|>"
        for lay in W.between_layout
        for d in W.between_desc
    }
    assert {r["query"] for r in rows} == wanted
    assert {r["response"] for r in rows} == {'<|M_OUTPUT|><|MASKED id="m_0"|>t <|/MASKED|><|/M_OUTPUT|>'}
    assert valid_share(pairs) == 1


def test_two_part_and_solution_and_chain_variants(spark):
    df = spark.range(600).select(
        F.col("id").alias("row_id"),
        *[F.lit(v).alias(n) for n, v in {
            "source": " s ", "rationale": "r", "target": "t", "problem": " p ", "solution": "x",
            "question": " q ", "longCOT": " c ####z", "answer": " a ",
        }.items()],
    )
    for build, variants in (
        (masking.mask_kaist_cot, len(W.rationale_lead) * len(W.target_lead)),
        (masking.mask_numina_math, len(W.solution_desc) * len(W.solution_layout)),
        (masking.mask_o1_journey, len(W.chain_desc) * len(W.answer_desc)),
    ):
        pairs = build(df)
        assert pairs.select("query").distinct().count() == variants
        assert valid_share(pairs) == 1
    assert masking.mask_o1_journey(df).first()["response"] == (
        '<|M_OUTPUT|><|MASKED id="m_0"|>c<|/MASKED|><|MASKED id="m_1"|>a<|/MASKED|><|/M_OUTPUT|>'
    )


def test_one_turn(spark):
    turns = [["a"], [], None, ["a", "b"], ["a", "b", "c"], ["a", None], ["1", "2", "3", "4", "5"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(turns)], "row_id bigint, conversations array<string>")
    pairs = masking.mask_lima(df)
    good, bad = gate.split_valid(pairs)
    assert sorted(r["row_id"] for r in bad.collect()) == [0, 1, 2, 5]
    for row in good.collect():
        given = turns[row["row_id"]]
        shown = given[: len(given) // 2 * 2]
        hidden = re.fullmatch(r'<\|M_OUTPUT\|><\|MASKED id="m_0"\|>(.*)<\|/MASKED\|><\|/M_OUTPUT\|>', row["response"])[1]
        place = shown.index(hidden)
        masked = ["<|MASKED|><|/MASKED|>" if i == place else t for i, t in enumerate(shown)]
        possible = {
            "<|M_INPUT|>" + "".join(lay.format(*masked[i : i + 2]) for i in range(0, len(masked), 2)) + "<|/M_INPUT|>"
            for lay in W.dialogue_layout
        }
        assert row["query"] in possible


def test_fields_are_masked_half_the_time_and_numbered(spark):
    df = spark.range(1200).select(
        F.col("id").alias("row_id"), *[F.lit(f"v{i}").alias(n) for i, n in enumerate(fixed.INSTRUCTION_FIELDS)]
    )
    pairs = masking.mask_magpie_reasoning(df)
    assert valid_share(pairs) == 1
    rows = pairs.collect()
    shares = []
    for i, name in enumerate(fixed.INSTRUCTION_FIELDS):
        shown = sum(f"{name}: v{i}\n" in r["query"] for r in rows)
        shares.append(shown / len(rows))
    assert all(abs(s - 0.5) < 0.06 for s in shares)
    assert any(r["response"] == "<|M_OUTPUT|><|/M_OUTPUT|>" for r in rows)


def test_steps(spark):
    df = spark.createDataFrame(
        [
            (0, " p ", ["a", "b"], -1, True), (1, "p", ["a"], 0, True), (2, "p", ["a"], -1, False),
            (3, "p", ["a"], -1, None), (4, "p", None, -1, True), (5, "p", [], -1, True),
        ],
        "row_id bigint, problem string, steps array<string>, label int, final_answer_correct boolean",
    )
    good, bad = gate.split_valid(masking.mask_process_bench(df))
    rows = {r["row_id"]: r for r in good.collect()}
    assert sorted(rows) == [0, 5] and [r["row_id"] for r in bad.collect()] == [4]
    assert rows[0]["query"].startswith("<|M_INPUT|>## Question\n\np\n\n## CoT Reasoning\n\n<|MASKED")
    assert rows[5]["query"] == "<|M_INPUT|>## Question\n\np\n\n## CoT Reasoning<|/M_INPUT|>"


def test_composed_fields_are_not_trimmed(spark):
    df = spark.createDataFrame([(0, " h", "d", "b", "r ")], "row_id bigint, headLine string, broadcastDate string, newsBeginning string, newsRemainder string")
    row = masking.mask_uhgeval(df).select(G.restore(F.col("query"), F.col("response"))).first()
    assert row[0] == " h\nd\nb\nr "


def test_masking_is_one_stage(spark, plan_of, tmp_path):
    spark.createDataFrame([(0, "a b c", "x")], "row_id bigint, article string, other string").write.parquet(str(tmp_path / "t"))
    plan = plan_of(masking.mask_cnn_daily_mail(spark.read.parquet(str(tmp_path / "t"))))
    assert "Exchange" not in plan and "Python" not in plan
    assert "struct<row_id:bigint,article:string>" in plan


def test_many_unclosed_tags_take_no_long(spark):
    text = "<p>" * 50_000 + "<output> yes </output>" + "<output>" * 1000
    df = spark.createDataFrame([(text,), ("<output>a" * 20_000 + "</output>",)], "t string")
    began = time.time()
    rows = [r[0]["output"] for r in df.select(masking.extract_tags(F.col("t"))).collect()]
    assert rows == ["yes", "<output>".join(["a"] * 20_000)] and time.time() - began < 60


def test_unclosed_tags_do_not_swallow(spark):
    cases = {"<a><output>x</output>": "x", "</a><a><output>x</output>": "x", "<a><output>x</output></a>": "", "<output>1</output><a><output>2</output>": "2"}
    df = spark.createDataFrame(list(cases.items()), "t string, w string")
    assert all(r[0]["output"] == r[1] for r in df.select(masking.extract_tags(F.col("t")), "w").collect())


def test_a_text_is_scanned_once_for_its_tags(spark):
    tags = masking.extract_tags(F.col("t"))
    df = spark.createDataFrame([("<a>x</a>‹output›y‹/output› <thinking>1</›thinking› ‹/›a› <output>z</output›é",), ("none",), (None,)], "t string")
    text = df.select(tags.alias("g"))._jdf.queryExecution().analyzed().toString()
    assert text.count("regexp_extract_all(") == 1 and text.count("split(") == 1
    assert [(r["g"]["thinking"], r["g"]["output"]) for r in df.select(tags.alias("g")).collect()] == [("1", "z"), ("", ""), ("", "")]


def test_validity_counts_no_characters(spark):
    df = spark.createDataFrame([("<|M_INPUT|>é<|MASKED|><|/MASKED|><|/M_INPUT|>", '<|M_OUTPUT|><|MASKED id="m_0"|>é<|/MASKED|><|/M_OUTPUT|>')], "query string, response string")
    checked = gate.with_validity(df)
    assert checked.first()["is_valid"] and "char_length(" not in checked._jdf.queryExecution().analyzed().toString()
