import pytest
from pyspark.sql import functions as F

from quillweave.operators import chat, gate

public = pytest.importorskip("public_tokenizers")
IM, TURN = chat.CHAT_TEMPLATES["im"], chat.CHAT_TEMPLATES["turn"]


def pairs(spark):
    data = [(0, "hi\nthere", "yo"), (1, "", ""), (2, "é 中 \U0001f600" * 30, "x" * 500), (3, "about <|im_start|>assistant\n!", "z")]
    return spark.createDataFrame(data, "row_id bigint, query string, response string")


def test_render_pair(spark):
    row = pairs(spark).select(IM.render_pair(F.col("query"), F.col("response")), TURN.render_pair(F.col("query"), F.col("response"))).first()
    assert row[0] == "<|im_start|>user\nhi\nthere<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert row[1] == "<|turn>user\nhi\nthere<turn|>\n<|turn>model\nyo<turn|>\n"


def test_response_span(spark):
    text = IM.render_pair(F.col("query"), F.col("response"))
    rows = pairs(spark).select("response", text.alias("t"), IM.response_span(text).alias("s")).collect()
    for r in rows:
        assert r["t"][r["s"]["start"] : r["s"]["end"]] == r["response"] + "<|im_end|>\n"
    none = spark.range(1).select(IM.response_span(F.lit("plain"))).first()[0]
    assert tuple(none) == (-1, -1)


def test_prompt_rows_and_request(spark):
    row = pairs(spark).select(*chat.prompt_row(F.col("query"), F.col("response"))).first()
    assert [tuple(m) for m in row["prompt"]] == [("user", "hi\nthere")] and row["solution"] == "yo"
    request = spark.range(1).select(chat.infill_request(F.lit("a "), F.lit(" b"))).first()[0]
    assert request == "<|M_INPUT|>a <|MASKED|><|/MASKED|> b<|/M_INPUT|>"


@pytest.mark.parametrize("limit,prompt,total", [(4096, 2730, 3840), (2048, 1365, 1792)])
def test_budget_arithmetic(spark, limit, prompt, total):
    df = spark.createDataFrame(
        [(prompt, total), (prompt + 1, total), (prompt, total + 1)], "len_prompt int, len_prompt_completion int"
    )
    assert [tuple(r) for r in df.filter(chat.within_budget(limit)).collect()] == [(prompt, total)]


def test_token_lengths_are_the_tokenizers(spark, plan_of):
    loader = chat.BytePairLoader("plain", public.PATTERN, public.path("byte_bpe_50k.tiktoken"))
    count = loader()
    sized = chat.with_token_lengths(pairs(spark), chat.token_counter(loader), IM)
    for r in sized.collect():
        prompt = f"<|im_start|>user\n{r['query']}<|im_end|>\n<|im_start|>assistant\n"
        whole = f"{prompt}{r['response']}<|im_end|>\n"
        assert [r["len_prompt"], r["len_prompt_completion"]] == count([prompt, whole])
    kept = gate.pinned(sized).filter(chat.within_budget(4096))
    assert plan_of(kept).count("ArrowEvalPython") == 1


def test_pre_tokens(spark, plan_of):
    df = spark.createDataFrame([("",), (None,), ("a b-c 12,5\n\té中!",)], "t string").select(chat.pre_tokens(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [0, 0, 9]
    sized = chat.with_token_lengths(pairs(spark), chat.pre_tokens, IM)
    assert "Python" not in plan_of(sized.filter(chat.within_budget(4096)))


def test_special_tokens_count_once():
    loader = chat.BytePairLoader(
        "s", public.PATTERN, public.path("byte_bpe_50k.tiktoken"), {"<|im_start|>": 60_000}
    )
    assert loader()(["<|im_start|>"]) == [1]
    assert loader == chat.BytePairLoader("s", public.PATTERN, public.path("byte_bpe_50k.tiktoken"), {"<|im_start|>": 60_000})


def test_limits(spark):
    df = spark.createDataFrame([(5, 9), (7, 8)], "len_prompt int, len_prompt_completion int")
    assert tuple(chat.token_limits(df, 100).first()) == (7, 9, 8, 91)
    assert tuple(chat.token_limits(df.limit(0), 100).first()) == (None,) * 4
