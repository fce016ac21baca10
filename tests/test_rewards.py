import math
import random
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillweave.functions.grammar import DEFAULT as G
from quillweave.operators import rewards
from tests.test_grammar import lenient, tag, valid, wrap_q, wrap_r

Q = wrap_q("x " + tag(0) + " y " + tag())
GOLD = wrap_r(tag(0, content="cat") + tag(1, content="1/2"))
CASES = [
    (Q, GOLD, GOLD),
    (Q, wrap_r(tag(0, content=" cat ") + tag(1, content="2/4")), GOLD),
    (Q, wrap_r(tag(0, content="dog") + tag(1, content="0.5")), GOLD),
    (Q, wrap_r(tag(0, content="cat")), GOLD),
    (Q, tag(0, content="cat"), GOLD),
    (Q, "junk", GOLD),
    (Q, wrap_r(tag(0, content="cat " * 12) + tag(1, content="1/2")), GOLD),
    (Q, wrap_r(tag(0, content="cat " * 90) + tag(1, content="1/2")), GOLD),
    (Q, wrap_r(tag(content="cat") + tag(content="1/2")), GOLD),
    (Q, GOLD, "no tags"),
    ("not a query", GOLD, GOLD),
    (wrap_q("no mask"), wrap_r(""), wrap_r("")),
    (Q, "", GOLD),
]
NUMBERS = {"1/2": 0.5, "2/4": 0.5, "0.5": 0.5}


def factor(r):
    return 1.0 if r <= 1.2 else 1.0 - 0.3 * (r - 1.2) / 0.8 if r <= 2 else 0.7 * math.exp(-(r - 2))


def scored(query, completion, golden):
    strict, pred, real = valid(query, completion), lenient(query, completion), lenient(query, golden)
    ratio = len(completion) / max(len(golden), 1)
    out = {
        "format_v1": 2 if strict else 1 if real is not None else -1,
        "format": 2 if strict else 1 if pred is not None else -1,
        "length_sign": 1 if len(completion) <= len(golden) else -1,
        "length_clip": max(-1, min(1, 1 - ratio)),
        "tags": 0, "accuracy_length": -1, "strict_length": -1, "loose_length": -1,
    }
    if pred is not None and real is not None:
        exact = sum(a == b for a, b in zip(pred, real))
        loose = sum(
            a is not None and b is not None
            and (a.strip() == b.strip() or (a in NUMBERS and NUMBERS.get(b) == NUMBERS[a]))
            for a, b in zip(pred, real)
        )
        acc = exact / max(len(real), 1)
        out["tags"] = exact
        out["accuracy_length"] = (2 * acc - 1) * factor(ratio) + (0.5 if acc == 1 else 0)
        if strict:
            out["strict_length"] = exact * factor(ratio)
            out["loose_length"] = loose * factor(ratio)
    return out


@pytest.fixture(scope="module")
def rollouts(spark):
    data = [(i, i // 4, *c) for i, c in enumerate(CASES)]
    return spark.createDataFrame(data, "row_id bigint, step bigint, query string, completion string, golden string")


def test_all_rewards(rollouts):
    rows = rewards.score(rollouts, list(rewards.REWARDS)).orderBy("row_id").collect()
    for row, case in zip(rows, CASES):
        for name, wanted in scored(*case).items():
            assert row[name] == pytest.approx(wanted), (name, case)


def test_unknown_reward(rollouts):
    with pytest.raises(KeyError):
        rewards.score(rollouts, ["nope"])


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("1/2", "2/4", True), ("0.5", "1/2", True), ("1,000", "1000", True), ("$5", "5.00", True),
        (r"\boxed{7}", "7", True), (r"\frac{3}{6}", "1/2", True), ("-1/2", "-0.5", True),
        ("1/3", "0.333333", False), ("1/0", "1/0", False), ("x", "x+0", False), ("1", "2", False),
        ("0.1234567890123", "0.1234567890124", False), ("12345678901234567890.5", "12345678901234567890.50", True),
        ("0.1234567/1", "0.1234568", False), ("", "", False), ("3.14159265358979", "3.141592653589790", True), ("1/-2", "-.5", True), ("1.", "1", True),
        ("10000000000000/20000000000000", "1/2", True), ("123456789012345678901234567.0", "123456789012345678901234567", True),
        ("0.1234567", "1234567/10000000", True), ("1" * 60 + "/3", "2" * 60 + "/6", True), ("1" * 60 + "/3", "2" * 59 + "1/6", False),
        ("1 2", "12", False), ("1,2", "12", False), ("2 3/4", "23/4", False), ("2 3/4", "2 3/4", False), ("1e3", "1000", False), ("50%", "0.5", False),
        ("1,23", "123", False), ("12,345,678", "12345678", True), ("1234,567", "1234567", False), ("1,000/2,000", ".5", True), (" $ 7 $\n", "7", True),
        (r"$\boxed{\frac{1}{2}}$", "0.5", True), (r"-\dfrac{ 3 }{4}", "-.75", True), (r"\boxed{1}{2}", "12", False), ("1 /2", "1/2", False),
        ("7" * 40 + "/" + "3" * 40, "7" * 41 + "/" + "3" * 41, True), ("7" * 40 + "/" + "3" * 40, "7" * 40 + "/" + "3" * 39 + "4", False),
        ("9" * 45 + "/7", "9" * 44 + ".9/.7", True), ("1" + "0" * 50 + "/3", "1" + "0" * 49 + "/.3", True),
        ("-0", "0", True), ("0/7", "0/9", True), (None, None, False), ("1", None, False),
    ],
)
def test_numeric_equality(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(rewards.numerically_equal(F.col("a"), F.col("b"))).first()[0] is same


def test_long_numbers_take_linear_time(spark):
    n = 100_000
    pairs = [
        ("7" * n + "/3", "7" * (n - 1) + "8/3"), ("7" * n + "/30", "7" * n + "0/300"), ("1" * n, "1" * n + ".000"),
        ("7" * n + "/" + "3" * n, "7" * (n - 1) + "8/" + "3" * n), ("7" * n + "/" + "3" * n, "7" * (n + 1) + "/" + "3" * (n + 1)),
    ]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    began = time.perf_counter()
    assert [r[0] for r in df.select(rewards.numerically_equal(F.col("a"), F.col("b"))).collect()] == [False, True, True, False, True]
    assert time.perf_counter() - began < 60


def test_ratios_by_fractions(spark):
    """Random ratios against exact rational numbers, short ones and ones beyond 38 digits."""
    r, pairs = random.Random(4), []
    for _ in range(300):
        size = r.choice([1, 3, 9, 18, 19, 25, 60])
        top, bottom, factor = r.randint(0, 10**size), r.randint(1, 10**size), r.randint(1, 10 ** r.choice([1, 20]))
        near = r.choice([0, 0, 1])
        pairs.append((f"{r.choice(['', '-', '+'])}{top}/{bottom}", f"{r.choice(['', '-'])}{top * factor + near}/{bottom * factor}"))
    got = spark.createDataFrame(pairs, "a string, b string").select(rewards.numerically_equal(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in got] == [Fraction(a) == Fraction(b) for a, b in pairs]


def test_each_text_is_parsed_once(rollouts, plan_of):
    for names in (["loose_length"], list(rewards.REWARDS)):
        plan = plan_of(rewards.score(rollouts, names))
        assert plan.count(r"(.*?)<\|/MASKED") == 3  # the pattern of a whole tag: query, completion, golden


@pytest.mark.parametrize(
    "query,response,reason,at",
    [
        (wrap_q("x " + tag(0)), wrap_r(tag(0, content="a")), None, None),
        (None, wrap_r(""), "query: missing", None), (wrap_q(""), None, "response: missing", None), ("x", wrap_r(""), "query: not wrapped", 0),
        (wrap_q("ab" + tag(1)), wrap_r(tag(0, content="a")), "query: tag number out of order", 13), (wrap_q("ab<|M_OUTPUT|>"), wrap_r(""), "query: delimiter out of place", 13),
        (wrap_q(tag()), wrap_r(tag(0, content="a") + " " + tag(1, content="b")), "response: text between tags", 44),
        (wrap_q(tag()), wrap_r(tag(0, content="a") + "."), "response: text between tags", 44), (wrap_q(tag()), wrap_r(tag(content="a")), "response: tag number out of order", 12),
        (wrap_q(tag()), wrap_r(""), "response: another number of tags", None),
    ],
)
def test_trouble_is_named(spark, query, response, reason, at):
    row = spark.createDataFrame([(query, response)], "q string, c string").select(G.trouble(F.col("q"), F.col("c")).alias("t")).first()["t"]
    assert (row and row["reason"], row and row["at"]) == (reason, at)


@pytest.mark.parametrize("seed", [1, 2])
def test_validity_of_parsed_tags(spark, seed):
    """The same as the validity of the texts, on sound pairs and broken ones."""
    r = random.Random(seed)
    bits = [tag(0, content="a"), tag(1, content="b"), tag(0), tag(), tag(1, content="<|M_INPUT|>"), "<|MASKED", "|>", "<|/MASKED|>", " x ", '<|MASKED id="m_00"|>c<|/MASKED|>', '<|MASKED desc="<|MASKED|>"|>d<|/MASKED|>', "<|M_OUTPUT|>"]
    rows = [(None, None), (wrap_q(tag()), None)]
    for _ in range(400):
        k = r.randint(0, 3)
        query, response = "z".join(tag(i) if r.random() < 0.5 else tag() for i in range(k)), "".join(tag(i, content="v") for i in range(k))
        if r.random() < 0.6:
            query += r.choice(bits)
        if r.random() < 0.6:
            response = r.choice([response + r.choice(bits), r.choice(bits) + response, r.choice(bits)])
        rows.append((wrap_q(query), wrap_r(response) if r.random() < 0.9 else response))
    q, c = F.col("q"), F.col("c")
    got = spark.createDataFrame(rows, "q string, c string").select(G.is_valid_pair(q, c), G.is_valid_parsed(q, c, G.tags(q), G.tags(c)), G.trouble(q, c)).collect()
    assert [x[0] for x in got] == [x[1] for x in got]
    assert [(row, x[2]) for row, x in zip(rows, got) if x[0] != (x[2] is None)] == []
    assert 50 < sum(x[0] for x in got) < 350


def test_loose_match_of_null_is_no_match(spark):
    df = spark.createDataFrame([(None, None), (None, "a"), (" a\n", "a")], "a string, b string")
    assert [r[0] for r in df.select(rewards.loose_match(F.col("a"), F.col("b"))).collect()] == [False, False, True]


def test_statistics_and_failures(rollouts):
    stats = {r["step"]: r for r in rewards.batch_statistics(rewards.details(rollouts)).collect()}
    assert (stats[0]["failures"], stats[0]["rollouts"]) == (1, 4)
    assert stats[0]["correct_tags"] == pytest.approx((2 + 2 + 1) / 3)
    assert stats[3]["failures"] == 1 and stats[3]["reward"] is None  # nothing could be scored
    assert stats[1]["ratio"] == pytest.approx(
        sum(len(CASES[i][1]) / len(GOLD) for i in (6, 7)) / 2
    )


def test_sample_dump(rollouts):
    last = {r["step"]: r for r in rewards.sample_dump(rollouts, every=2).collect()}
    assert sorted(last) == [1, 3] and last[1]["row_id"] == 7
    first = rewards.sample_dump(rollouts, every=1, last=False, cut=(5, 6, 7)).collect()
    shown = {r["step"]: r for r in first}
    assert shown[0]["row_id"] == 0 and shown[0]["query"] == Q[:5] and shown[0]["golden"] == GOLD[:7]
    assert shown[1]["row_id"] == 6 and 3 not in shown


def test_scoring_is_one_stage(rollouts, plan_of):
    assert "Exchange" not in plan_of(rewards.score(rollouts, ["loose_length"]))
