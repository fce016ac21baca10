"""Views that give the driver's tables the shapes of the corpora.

The same SQL text runs on Spark and on DuckDB; ``{documents}`` and the like are table
names.  Every view covers all rows and the whole text; the ``%`` cases only vary the shape
of a row (missing parts, odd brackets), they leave no row out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.sources.readers import spread

TABLES = ("documents", "conversations", "labels")

#: sources of the documents table as a stand-in for subsets, 12 / 4 / 4 of them per tier
SOURCES = [f"src{i}" for i in range(20)]
TIER_SOURCES = {"high": SOURCES[:12], "mid": SOURCES[12:16], "low": SOURCES[16:]}
KIND_SOURCES = {"poisson": SOURCES[:5], "semantic": SOURCES[5:]}
FOUR_TIER_SOURCES = {
    "verifiable": ["src0", "src1", "src1", "src1"],
    "high": SOURCES[2:10],
    "mid": SOURCES[10:15],
    "low": SOURCES[15:],
}

_LINE = "case when instr(text, chr(10)) = 0 then text else substr(text, 1, instr(text, chr(10)) - 1) end"
_REST = f"substr(text, length({_LINE}) + 2)"
_HALF = "cast(floor(length(text) / 2) as int)"
_FIFTH = "cast(floor(length(text) / 5) as int)"


def _tagged() -> str:
    names = ("thinking", "reasoning", "reflection", "adjustment", "output")
    parts = [f"substr(text, {i} * {_FIFTH} + 1, {_FIFTH})" for i in range(4)]
    parts.append(f"substr(text, 4 * {_FIFTH} + 1)")
    full = "concat(" + ", ".join(f"'<{n}>', {p}, '</{n}>'" for n, p in zip(names, parts)) + ")"
    return (
        f"select doc_id as row_id, {_LINE} as question, case doc_id % 6 when 0 then null "
        f"when 1 then concat('<thinking>', text, '</thinking>') "
        f"when 2 then replace(replace({full}, '<', '‹'), '>', '›') "
        f"when 3 then concat({full}, '<output>', source, '</output>') "
        f"when 4 then concat({full}, '<output> </output>') else {full} end as generation "
        "from {documents}"
    )


def _rollouts() -> str:
    def tag(number, content):
        return f"'<|MASKED id=\"m_{number}\"|>', {content}, '<|/MASKED|>'"

    def out(*tags):
        return "concat('<|M_OUTPUT|>', " + ", ".join(tags) + ", '<|/M_OUTPUT|>')"

    whole = "concat(lang, ' ', source)"
    ratio = "concat('1/', cast(doc_id % 9 + 2 as varchar(9)))"
    same = "concat('2/', cast(2 * (doc_id % 9 + 2) as varchar(9)))"
    kinds = (("1 2", "12"), ("1,2", "12"), ("2 3/4", "23/4"), (" 1,234.50 ", "1234.5"), ("1e3", "1000"), ("$7$", "7"), ("50%", "50"), ("1,000/2,000", "0.5"))
    said, meant = (" ".join(f"when {i} then '{pair[side]}'" for i, pair in enumerate(kinds)) for side in (0, 1))
    said, meant = (f"case cast(floor(doc_id / 12) as int) % 9 {x} else {ratio} end" for x in (said, meant))
    second = (
        f"case doc_id % 12 when 2 then {meant} when 9 then '-3.141592653589790' when 10 then '10000000000000/20000000000000' else {ratio} end"
    )
    query = (
        "concat(case when doc_id % 12 = 11 then '' else '<|M_INPUT|>' end, text, '<|MASKED id=\"m_0\"|><|/MASKED|> and "
        "<|MASKED desc=\"a &amp; b\"|><|/MASKED|><|/M_INPUT|>')"
    )
    cases = [
        out(tag(0, whole), tag(1, ratio)),
        out(tag(0, f"concat(' ', {whole}, ' ')"), tag(1, same)),
        out(tag(0, "source"), tag(1, said)),
        out(tag(0, whole)),
        f"concat({tag(0, whole)})",
        out(tag(0, whole), tag(1, f"concat(source, ' ', {whole}, ' ', {whole}, ' ', source)")),
        out(tag(0, whole), tag(1, "text")),
        f"concat('junk ', {out(tag(1, whole), tag(0, 'source'))})",
        "null",
        out(tag(0, whole), tag(1, "'-003.14159265358979'")),
        out(tag(0, whole), tag(1, "case when lang = 'en' then '.5' else '-1/-2' end")),
        out(tag(0, whole), tag(1, ratio)),
    ]
    chosen = " ".join(f"when {i} then {c}" for i, c in enumerate(cases))
    return (
        f"select doc_id as row_id, cast(floor(doc_id / 8) as bigint) as step, {query} as query, "
        f"case when doc_id % 36 <> 20 then {out(tag(0, whole), tag(1, second))} end as golden, "
        f"case doc_id % 12 {chosen} end as completion from " + "{documents}"
    )


VIEWS: dict[str, str] = {
    "article": f"select doc_id as row_id, text as article, {_LINE} as highlights from {{documents}}",
    "news": (
        f"select doc_id as row_id, {_LINE} as headLine, source as broadcastDate, "
        f"substr(text, 1, {_HALF}) as newsBeginning, substr(text, {_HALF} + 1) as newsRemainder "
        "from {documents}"
    ),
    "problem": f"select doc_id as row_id, {_LINE} as problem, {_REST} as solution from {{documents}}",
    "chain": (
        f"select doc_id as row_id, {_LINE} as question, case when doc_id % 5 = 0 then text else "
        f"concat(substr(text, 1, {_HALF}), ' #### ', substr(text, {_HALF} + 1)) end as longCOT, "
        "case when doc_id % 7 = 0 then null else concat(' ', lang, ' ') end as answer from {documents}"
    ),
    "reason": (
        f"select doc_id as row_id, concat(chr(10), {_LINE}, ' ') as prompt, case when doc_id % 5 = 0 "
        f"then null else {_REST} end as thinking, case when doc_id % 7 = 0 then '  ' else source end "
        "as answer from {documents}"
    ),
    "steps": (
        "select d.doc_id as row_id, d.source as problem, d.text as steps_text, case when l.toxic = 0 "
        "then -1 else 0 end as label, case when l.doc_id % 11 = 0 then null else l.quality = 1 end as "
        "final_answer_correct from {documents} d left join {labels} l on d.doc_id = l.doc_id"
    ),
    "tagged": _tagged(),
    "fields": (
        f"select doc_id as row_id, {_LINE} as instruction, {_REST} as response, lang as intent, "
        "source as knowledge, case when n_chars > 2000 then 'hard' else 'easy' end as difficulty, "
        "case when n_chars > 500 then 'good' else 'poor' end as input_quality, "
        "concat(source, ': ', lang) as quality_explanation, 'Others' as task_category from {documents}"
    ),
    "subset": (
        f"select doc_id as row_id, source as subset, text as query, {_LINE} as response from {{documents}}"
    ),
    "rollouts": _rollouts(),
    "turns": "select conv_id, turn, text from {conversations}",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: table(spark, folder, t) for t in TABLES if f"{{{t}}}" in text}
    if "documents" in used:
        used["documents"] = spread(used["documents"])
    df = spark.sql(text, **used)
    if name == "steps":
        df = df.select("*", F.split("steps_text", "\n").alias("steps")).drop("steps_text")
    return df


def view_sql(name: str) -> str:
    return VIEWS[name].format(**{t: t for t in TABLES})
