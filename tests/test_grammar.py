import random
import re
import time

from pyspark.sql import functions as F

from quillweave.functions.grammar import DEFAULT as G
from quillweave.functions.grammar import TagGrammar

TAG = re.compile(r'(?s)<\|MASKED(?: id="m_(\d+)")?(?: desc="([^"]*)")?\|>(.*?)<\|/MASKED\|>')
DELIMITER = re.compile(r"<\|/?(?:MASKED|M_INPUT|M_OUTPUT)")


def body(text, name):
    first, last = f"<|{name}|>", f"<|/{name}|>"
    if text is None or not text.startswith(first) or not text.endswith(last):
        return None
    return text[len(first) : -len(last)] if len(text) >= len(first) + len(last) else None


def valid(query, response):
    q, r = body(query, "M_INPUT"), body(response, "M_OUTPUT")
    if q is None or r is None:
        return False
    qt, rt = list(TAG.finditer(q)), list(TAG.finditer(r))
    free = TAG.sub("", q)
    return (
        TAG.sub("", r) == ""
        and len(qt) == len(rt)
        and [t[1] for t in rt] == [str(i) for i in range(len(rt))]
        and all(t[1] is None or t[1] == str(i) for i, t in enumerate(qt))
        and not any(DELIMITER.search(t[3]) for t in qt + rt)
        and not DELIMITER.search(free)
    )


def lenient(query, response):
    q = body(query, "M_INPUT")
    if q is None or response is None:
        return None
    given = [(t[1], t[3]) for t in TAG.finditer(response)]
    out = []
    for i, _ in enumerate(TAG.finditer(q)):
        same = [c for n, c in given if n == str(i)]
        if same:
            out.append(same[0])
        elif i < len(given) and given[i][0] is None:
            out.append(given[i][1])
        else:
            out.append(None)
    return out


def tag(i=None, desc=None, content=""):
    head = "<|MASKED" + (f' id="m_{i}"' if i is not None else "") + (f' desc="{desc}"' if desc is not None else "")
    return f"{head}|>{content}<|/MASKED|>"


def wrap_q(x):
    return f"<|M_INPUT|>{x}<|/M_INPUT|>"


def wrap_r(x):
    return f"<|M_OUTPUT|>{x}<|/M_OUTPUT|>"


HAND = [
    (wrap_q("a" + tag(0) + "b"), wrap_r(tag(0, content="x"))),
    (wrap_q("no mask"), wrap_r("")),
    (wrap_q(""), wrap_r("")),
    (wrap_q("no mask"), wrap_r(" ")),
    (wrap_q(tag()), wrap_r(tag(0, content="a\nb"))),
    (wrap_q(tag() + tag(1)), wrap_r(tag(0) + tag(1))),
    (wrap_q(tag(1) + tag(0)), wrap_r(tag(0) + tag(1))),
    (wrap_q(tag() + tag()), wrap_r(tag(1) + tag(0))),
    (wrap_q(tag() + tag()), wrap_r(tag(0) + " " + tag(1))),
    (wrap_q(tag() + tag()), wrap_r(tag(0))),
    (wrap_q(tag()), wrap_r(tag(content="no id"))),
    (wrap_q(tag()), tag(0, content="bare")),
    (wrap_q(tag()), "junk"),
    (wrap_q(tag()), None),
    (None, wrap_r("")),
    ("no wrapper" + tag(), wrap_r(tag(0))),
    (wrap_q(tag()), wrap_r("<|MASKED|>" + tag(0) + "<|/MASKED|>")),
    (wrap_q("<|/MASKED|>" + tag()), wrap_r(tag(0))),
    (wrap_q(tag()), wrap_r(tag(0, content="see <|M_INPUT|>"))),
    (wrap_q(tag(desc="a &quot;b&quot; &amp;")), wrap_r(tag(0, desc="d", content="\U0001f600"))),
    ("<|M_INPUT|>", wrap_r("")),
    ("<|M_INPUT|></|M_INPUT|>", wrap_r("")),
    (wrap_q('<|MASKED id="x"|><|/MASKED|>'), wrap_r("")),
    (wrap_q('<|MASKED id="m_0" <|/MASKED|>'), wrap_r(tag(0))),
    (wrap_q('<|MASKED desc="a<|/MASKED|>'), wrap_r(tag(0))),
    (wrap_q("<|MASKED|><|/MASKED"), wrap_r(tag(0))),
    (wrap_q(tag() + "<|M_OUTPUT|>"), wrap_r(tag(0))),
    (wrap_q(tag(desc="<|MASKED|>")), wrap_r(tag(0))),
    (wrap_q(tag(desc="x|>")), wrap_r(tag(0, desc="|>"))),
    (wrap_q(tag()), wrap_r(tag(0) + "<|/M_OUTPUT|>")),
    (wrap_q(tag("00")), wrap_r(tag(0))),
    (wrap_q(tag()), wrap_r(tag("00"))),
    (wrap_q(tag() * 11), wrap_r("".join(tag(i, content=str(i)) for i in range(11)))),
]


def random_pairs(n=400):
    rng = random.Random(5)
    bits = ["a", " ", "\n", "<", "<|", "|>", "<|/MASKED|>", "<|MASKED|>", "é", "\U0001f600"]

    def text(k):
        return "".join(rng.choice(bits[: rng.choice([6, 6, 10])]) for _ in range(rng.randrange(k)))

    out = []
    for _ in range(n):
        k = rng.randrange(4)
        q = "".join(text(3) + tag(rng.choice([None, i, i, 9]), rng.choice([None, "d"])) for i in range(k))
        order = list(range(k)) if rng.random() < 0.8 else [rng.randrange(3) for _ in range(k)]
        r = rng.choice(["", "", "", " "]).join(
            tag(rng.choice([i, i, i, None]), None, text(3)) for i in order
        )
        out.append((wrap_q(q + text(3)), rng.choice([wrap_r(r), wrap_r(r), r])))
    return out


def frame(spark, pairs):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, q string, r string")


def test_validate_and_infill_follow_the_contract(spark):
    pairs = HAND + random_pairs()
    q, r = F.col("q"), F.col("r")
    got = (
        frame(spark, pairs)
        .select(
            "i",
            G.is_valid_pair(q, r).alias("valid"),
            G.infill_lenient(q, r).alias("lenient"),
            G.infill_strict(q, r).alias("strict"),
        )
        .orderBy("i")
        .collect()
    )
    seen = set()
    for row, (query, response) in zip(got, pairs):
        wanted = valid(query, response)
        seen.add(wanted)
        assert row["valid"] == wanted, (query, response)
        filled = lenient(query, response)
        have = None if row["lenient"] is None else [t["content"] for t in row["lenient"]]
        assert have == filled, (query, response)
        assert (row["strict"] is None) == (not wanted)
    assert seen == {True, False}


def test_render_and_parse_are_inverse(spark):
    desc = 'say "hi" & <go>'
    row = spark.range(1).select(
        G.render(id=3, desc=desc, content=F.lit("x<y\n")).alias("t"),
        G.render(id=3, desc=F.lit(desc), content="x<y\n").alias("c"),
    ).select("t", "c", G.tags(F.col("t")).alias("tags")).first()
    assert row["t"] == row["c"]
    assert row["t"] == '<|MASKED id="m_3" desc="say &quot;hi&quot; &amp; &lt;go&gt;"|>x<y\n<|/MASKED|>'
    assert [tuple(t) for t in row["tags"]] == [("3", desc, "x<y\n")]


def test_four_query_shapes(spark):
    shapes = [G.render(id=0), G.render(), G.render(desc="d"), G.render(id=0, desc="d")]
    row = spark.range(1).select(*[s.alias(f"s{i}") for i, s in enumerate(shapes)]).first()
    assert list(row) == [
        '<|MASKED id="m_0"|><|/MASKED|>',
        "<|MASKED|><|/MASKED|>",
        '<|MASKED desc="d"|><|/MASKED|>',
        '<|MASKED id="m_0" desc="d"|><|/MASKED|>',
    ]


def test_delimiters_are_parameters(spark):
    g = TagGrammar(tag="GAP", id_prefix="g", query_wrap="ASK", response_wrap="TELL")
    row = spark.range(1).select(
        g.wrap_query(F.concat(F.lit("a "), g.render(id=0))).alias("q"),
        g.wrap_response(g.render(id=0, content="b")).alias("r"),
    ).select("q", "r", g.is_valid_pair(F.col("q"), F.col("r")).alias("ok"), g.restore(F.col("q"), F.col("r")).alias("t")).first()
    assert row["q"] == '<|ASK|>a <|GAP id="g0"|><|/GAP|><|/ASK|>'
    assert row["ok"] and row["t"] == "a b"


def test_null_content_makes_the_tag_null(spark):
    tag_ = G.render(id=0, content=F.lit(None).cast("string"))
    assert spark.range(1).select(tag_).first()[0] is None


def test_many_tags_are_filled_in_seconds(spark):
    n = 50_000
    query = "<|M_INPUT|>" + "<|MASKED|><|/MASKED|>" * n + "<|/M_INPUT|>"
    given = [f'<|MASKED id="m_{i}"|>{i}<|/MASKED|>' for i in range(n - 1, -1, -1)] + ['<|MASKED id="m_0"|>late<|/MASKED|>']
    df = spark.createDataFrame([(query, "<|M_OUTPUT|>" + "".join(given) + "<|/M_OUTPUT|>")], "q string, r string")
    began = time.time()
    filled = df.select(TagGrammar().infill_lenient(F.col("q"), F.col("r"))).first()[0]
    assert [t["content"] for t in filled] == [str(i) for i in range(n)] and time.time() - began < 60
