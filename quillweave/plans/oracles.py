"""DuckDB SQL for the driver queries.

Written from the rules, not from the Spark code: ranks are plain ``row_number`` windows,
sampling joins on them, span positions come from a list fold.  Small helpers below only
spell out repeated SQL.
"""

from __future__ import annotations

from quillweave.functions import fixed
from quillweave.functions.hashing import poisson_cdf
from quillweave.functions.wording import DEFAULT as W
from quillweave.plans.fixtures import (
    FOUR_TIER_SOURCES,
    KIND_SOURCES,
    TIER_SOURCES,
    view_sql,
)

NL = "chr(10)"


# ---- SQL spelling -----------------------------------------------------------------------
def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def h(*parts) -> str:
    """60-bit hash; strings are literals, the rest SQL (wrap column names in ``c``)."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15))::BIGINT"


def u(*parts) -> str:
    return f"({h(*parts)}::DOUBLE / 1152921504606846976.0::DOUBLE)"


def strip(x: str) -> str:
    return f"trim({x}, {lit(fixed.PYTHON_SPACE)})"


def canon(x: str) -> str:
    return f"coalesce({strip(x)}, '')"


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")


def tag(number: str | None = None, desc: str | None = None, content: str | None = None) -> str:
    """SQL of one tag; ``number`` and ``content`` are SQL, ``desc`` is plain text."""
    head = "'<|MASKED'"
    if number is not None:
        head += f" || ' id=\"m_' || ({number})::VARCHAR || '\"'"
    if desc is not None:
        head += f" || {lit(' desc=\"' + escape(desc) + '\"')}"
    body = f" || ({content})" if content is not None else ""
    return f"({head} || '|>'{body} || '<|/MASKED|>')"


def wrap_query(x: str) -> str:
    return f"('<|M_INPUT|>' || ({x}) || '<|/M_INPUT|>')"


def wrap_response(x: str) -> str:
    return f"('<|M_OUTPUT|>' || ({x}) || '<|/M_OUTPUT|>')"


def pick(options: list[str], *parts) -> str:
    cases = " ".join(f"when {i} then {o}" for i, o in enumerate(options))
    return f"(case {h(*parts)} % {len(options)} {cases} end)"


def layout(template: str, *values: str) -> str:
    pieces = template.split("{}")
    out = [lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        out += [f"({value})", lit(piece)]
    return "(" + " || ".join(out) + ")"


def joined(a: str, b: str) -> str:
    return f"case when {a} <> '' and {b} <> '' then {a} || {lit(fixed.ANSWER_JOIN)} || {b} else {a} || {b} end"


def qa(view: str, q: str, a: str, where: str = "true") -> str:
    return (
        f"with v as ({view_sql(view)}) select * from (select row_id, {q} as q, {a} as a from v where {where}) "
        "where q <> '' and a <> ''"
    )


ORACLES: dict[str, str] = {}

# ---- canonical text and question/answer rows -------------------------------------------------
padded = f"{lit(chr(32) + chr(10))} || text || {lit(chr(9) + chr(0x3000) + chr(32))}"
ORACLES["text_canonical"] = f"select doc_id, {canon(padded)} as text from documents"
ORACLES["qa_article"] = qa("article", canon("article"), canon("highlights"))
ORACLES["qa_tagged"] = qa("tagged", canon("question"), canon("generation"))
ORACLES["qa_reason_answer"] = qa("reason", canon("prompt"), joined(canon("thinking"), canon("answer")))
ORACLES["qa_rationale"] = ORACLES["qa_reason_answer"]
ORACLES["qa_instruct"] = qa("fields", canon("instruction"), canon("response"))
ORACLES["qa_math"] = qa("problem", canon("problem"), canon("solution"))
ORACLES["qa_cut_chain"] = qa(
    "chain", canon("question"), joined(strip("split_part(" + canon("longCOT") + ", '####', 1)"), canon("answer"))
)
CORRECT = "label = -1 and coalesce(final_answer_correct, false)"
STEPS = f"string_split(steps_text, {NL})"
ORACLES["qa_steps_joined"] = qa(
    "steps",
    canon("problem"),
    f"coalesce(array_to_string(list_filter(list_transform({STEPS}, lambda s: {canon('s')}), lambda s: s <> ''), {NL}), '')",
    CORRECT,
)
ORACLES["qa_news"] = qa(
    "news",
    strip(f"{canon('headLine')} || {NL} || {canon('broadcastDate')} || {NL} || {canon('newsBeginning')}"),
    canon("newsRemainder"),
)
POS = (
    f"select conv_id, text, row_number() over (partition by conv_id order by turn) - 1 as pos "
    f"from ({view_sql('turns')})"
)
ORACLES["qa_pairs_from_turns"] = (
    f"with p as ({POS}) select * from (select x.conv_id, (x.pos // 2)::BIGINT as pair, {canon('x.text')} as q, "
    f"{canon('y.text')} as a from p x join p y on x.conv_id = y.conv_id and y.pos = x.pos + 1 where x.pos % 2 = 0) "
    "where q <> '' and a <> ''"
)

# ---- random spans ------------------------------------------------------------------------------
CDF = ", ".join(f"{lit(repr(c))}::DOUBLE" for c in poisson_cdf(4))


def spans(source: str) -> str:
    """CTEs ``s`` (row_id, text, n, m) and ``p`` (the same plus sorted positions ``pos``)."""
    draw = h("'0'", "'span'", "row_id", "j")
    return f"""
s as (
  select row_id, text, length(text) as n,
    least(len(list_filter([{CDF}], lambda c: c <= {u("'0'", "'count'", "row_id")})), length(text) // 2) as m
  from ({source})
),
p as (
  select *, case when m = 0 then []::BIGINT[] else list_sort(list_reduce(
    list_transform(range(n - 2 * m, n), lambda j: [j, {draw} % (j + 1)]),
    lambda acc, x: case when list_contains(acc, x[2]) then list_append(acc, x[1]) else list_append(acc, x[2]) end,
    []::BIGINT[])) end as pos
  from s
)"""


def span_pairs(source: str) -> str:
    shapes = [
        tag("i"),
        tag(),
        tag(desc=W.span_plain),
        tag("i", W.span_numbered),
    ]
    shape = pick(shapes, "'0'", "'shape'", "row_id", "i")
    start = "(case when i = 0 then 0 else pos[2 * i] end)"
    return f"""with {spans(source)}
select row_id,
  {wrap_query(f"array_to_string(list_transform(range(0, m), lambda i: substr(text, {start} + 1, pos[2 * i + 1] - {start}) || {shape}), '') || substr(text, (case when m = 0 then 0 else pos[2 * m] end) + 1)")} as query,
  {wrap_response(f"array_to_string(list_transform(range(0, m), lambda i: {tag('i', None, 'substr(text, pos[2 * i + 1] + 1, pos[2 * i + 2] - pos[2 * i + 1])')}), '')")} as response
from p"""


ARTICLE = "select doc_id as row_id, text from documents"
NEWS = (
    f"select row_id, headLine || {NL} || broadcastDate || {NL} || newsBeginning || {NL} || newsRemainder as text "
    f"from ({view_sql('news')})"
)
ORACLES["poisson_counts"] = f"with {spans(ARTICLE)} select row_id, n::INT as n, m::INT as masks from s"
ORACLES["mask_ranges"] = f"""with {spans(ARTICLE)}
select row_id, i::INT as place, pos[2 * i + 1]::INT as s, pos[2 * i + 2]::INT as e
from (select *, unnest(range(0, m)) as i from p)"""
ORACLES["mask_poisson"] = span_pairs(ARTICLE)
ORACLES["mask_poisson_fields"] = span_pairs(NEWS)
ORACLES["mask_summary"] = f"""with {spans(ARTICLE)}
select d.source, count(*) as pairs, count(*) as valid, sum(p.m)::BIGINT as masks,
  sum(coalesce(list_sum(list_transform(range(0, p.m), lambda i: p.pos[2 * i + 2] - p.pos[2 * i + 1])), 0))::BIGINT as hidden_chars
from p join documents d on d.doc_id = p.row_id group by d.source"""
ORACLES["infill_roundtrip"] = ARTICLE

# ---- tagged reasoning ------------------------------------------------------------------------------


def last_tag(x: str, name: str) -> str:
    pattern = rf"(?s)[<‹]{name}[>›](.*?)(?:</|‹/|</›){name}[>›]"
    found = f"regexp_extract_all(coalesce({x}, ''), {lit(pattern)}, 1)"
    return f"coalesce({strip(found + '[-1]')}, '')"


TAGS = ", ".join(f"{last_tag('generation', n)} as {n}" for n in fixed.REASONING_TAGS)
ORACLES["tag_extract"] = f"select row_id, {TAGS} from ({view_sql('tagged')})"
ORACLES["tag_extract_pages"] = (
    f"select page_id, {last_tag('html', 'head')} as head, {last_tag('html', 'body')} as body from pages"
)
ORACLES["mask_structured"] = f"""with t as (select row_id, question, {TAGS} from ({view_sql('tagged')}))
select row_id,
  {wrap_query(strip('question') + ' || ' + ' || '.join(f"{NL} || {NL} || {tag(desc=d)}" for d in W.tag_desc))} as query,
  {wrap_response(' || '.join(tag(str(i), None, n) for i, n in enumerate(fixed.REASONING_TAGS)))} as response
from t where {' and '.join(f"{n} <> ''" for n in fixed.REASONING_TAGS)}"""

# ---- one-row rules ----------------------------------------------------------------------------------
BETWEEN_MASK = pick([tag(desc=d) for d in W.between_desc], "'0'", "'desc'", "row_id")
ORACLES["mask_between"] = f"""select row_id,
  {wrap_query(pick([layout(t, strip('prompt'), BETWEEN_MASK, 'answer') for t in W.between_layout], "'0'", "'layout'", "row_id"))} as query,
  {wrap_response(tag('0', None, 'thinking'))} as response
from ({view_sql('reason')})"""


def leads(options) -> list[str]:
    return [f"({lit(text)} || {tag(desc=desc)})" for text, desc in options]


ORACLES["mask_two_part"] = f"""select row_id,
  {wrap_query(f"{strip('prompt')} || {pick(leads(W.rationale_lead), chr(39) + '0' + chr(39), chr(39) + 'rationale' + chr(39), 'row_id')} || {pick(leads(W.target_lead), chr(39) + '0' + chr(39), chr(39) + 'target' + chr(39), 'row_id')}")} as query,
  {wrap_response(tag('0', None, 'thinking') + ' || ' + tag('1', None, 'answer'))} as response
from ({view_sql('reason')})"""

TURN = "case when i = hidden then " + tag() + " else turns[i + 1] end"
PAIRED = pick(
    [
        f"array_to_string(list_transform(range(0, np), lambda k: {layout(t, TURN.replace('i + 1', '2 * k + 1').replace('i = hidden', '2 * k = hidden'), TURN.replace('i + 1', '2 * k + 2').replace('i = hidden', '2 * k + 1 = hidden'))}), '')"
        for t in W.dialogue_layout
    ],
    "'0'",
    "'layout'",
    "conv_id",
)
ORACLES["mask_one_turn"] = f"""with c as (
  select conv_id, list(text order by turn) as turns, count(*) // 2 as np from ({view_sql('turns')}) group by conv_id
), d as (select *, case when np > 0 then {h("'0'", "'turn'", "conv_id")} % (2 * np) end as hidden from c)
select conv_id, case when np > 0 then {wrap_query(PAIRED)} end as query,
  case when np > 0 then {wrap_response(tag('0', None, 'turns[hidden + 1]'))} end as response
from d"""

FIELDS = fixed.INSTRUCTION_FIELDS
FLAGS = ", ".join(
    f"{u(chr(39) + '0' + chr(39), chr(39) + 'field' + chr(39), lit(n), 'row_id')} < 0.5 as f{i}"
    for i, n in enumerate(FIELDS)
)


def field_number(i: int) -> str:
    return " + ".join(["0", *[f"f{j}::INT" for j in range(i)]])


ORACLES["mask_fields"] = f"""with f as (select *, {FLAGS} from ({view_sql('fields')}))
select row_id,
  {wrap_query(lit(W.fields_head) + ' || ' + ' || '.join(f"{lit(n + ': ')} || case when f{i} then {tag(field_number(i), W.field_desc[i])} else {n} end || {lit(chr(10) * 2)}" for i, n in enumerate(FIELDS)))} as query,
  {wrap_response(' || '.join(f"case when f{i} then {tag(field_number(i), None, n)} else '' end" for i, n in enumerate(FIELDS)))} as response
from f"""

SOLUTION_MASK = pick([tag(desc=d) for d in W.solution_desc], "'0'", "'desc'", "row_id")
ORACLES["mask_solution"] = f"""select row_id,
  {wrap_query(pick([layout(t, strip('problem'), SOLUTION_MASK) for t in W.solution_layout], "'0'", "'layout'", "row_id"))} as query,
  {wrap_response(tag('0', None, 'solution'))} as response
from ({view_sql('problem')})"""

ORACLES["mask_chain"] = f"""select row_id,
  {wrap_query(f"{strip('question')} || {NL} || {NL} || {pick([tag(desc=d) for d in W.chain_desc], chr(39) + '0' + chr(39), chr(39) + 'chain' + chr(39), 'row_id')} || {NL} || {NL} || {pick([tag(desc=d) for d in W.answer_desc], chr(39) + '0' + chr(39), chr(39) + 'answer' + chr(39), 'row_id')}")} as query,
  {wrap_response(tag('0', None, strip("split_part(longCOT, '####', 1)")) + ' || ' + tag('1', None, strip('answer')))} as response
from ({view_sql('chain')})"""


def step_masks() -> str:
    by_desc = []
    for d in W.step_desc:
        shapes = [tag("i", d), tag(desc=d), tag()]
        by_desc.append(
            f"array_to_string(list_transform(range(0, len(steps)), lambda i: {NL} || {NL} || "
            f"{pick(shapes, chr(39) + '0' + chr(39), chr(39) + 'shape' + chr(39), 'row_id', 'i')}), '')"
        )
    return pick(by_desc, "'0'", "'desc'", "row_id")


ORACLES["mask_steps"] = f"""with v as (select *, {STEPS} as steps from ({view_sql('steps')}) where {CORRECT})
select row_id,
  {wrap_query(f"{lit(fixed.STEPS_QUESTION_HEAD)} || {strip('problem')} || {lit(fixed.STEPS_CHAIN_HEAD)} || {step_masks()}")} as query,
  {wrap_response(f"array_to_string(list_transform(range(0, len(steps)), lambda i: {tag('i', None, 'steps[i + 1]')}), '')")} as response
from v"""

# ---- validation and infill -----------------------------------------------------------------------------
HEAD = r'<\|MASKED(?: id="m_(\d+)")?(?: desc="([^"]*)")?\|>'
PATTERN = lit(rf"(?s){HEAD}(.*?)<\|/MASKED\|>")
DIRTY = lit(r"<\|/?(?:MASKED|M_INPUT|M_OUTPUT)")


def tag_lists(x: str, name: str) -> str:
    return ", ".join(
        f"list_transform(regexp_extract_all({x}, {PATTERN}, {g}), lambda t: {'t' if g == 3 else 'nullif(t, ' + chr(39) * 2 + ')'}) as {name}_{part}"
        for g, part in ((1, "id"), (2, "desc"), (3, "content"))
    )


def wrapped(x: str, name: str) -> str:
    size = 2 * len(name) + 9
    return f"(starts_with({x}, '<|{name}|>') and ends_with({x}, '<|/{name}|>') and length({x}) >= {size})"


def body(x: str, name: str) -> str:
    return f"substr({x}, {len(name) + 5}, length({x}) - {2 * len(name) + 9})"


PARSED = f"""r as ({view_sql('rollouts')}),
t as (select *, {tag_lists('query', 'q')}, {tag_lists('completion', 'c')}, {tag_lists('golden', 'g')} from r),
v as (select *, coalesce(
  {wrapped('query', 'M_INPUT')} and {wrapped('completion', 'M_OUTPUT')}
  and len(q_id) = len(c_id)
  and regexp_replace({body('completion', 'M_OUTPUT')}, {PATTERN}, '', 'g') = ''
  and not regexp_matches(regexp_replace({body('query', 'M_INPUT')}, {PATTERN}, '', 'g'), {DIRTY})
  and c_id = list_transform(range(0, len(c_id)), lambda i: i::VARCHAR)
  and len(list_filter(range(0, len(q_id)), lambda i: q_id[i + 1] is not null and q_id[i + 1] <> i::VARCHAR)) = 0
  and len(list_filter(c_content, lambda x: regexp_matches(x, {DIRTY}))) = 0
  and len(list_filter(q_content, lambda x: regexp_matches(x, {DIRTY}))) = 0, false) as strict,
  coalesce({wrapped('query', 'M_INPUT')} and completion is not null, false) as lenient,
  coalesce({wrapped('query', 'M_INPUT')} and golden is not null, false) as golden_ok from t)"""


def filled(name: str) -> str:
    """Content for query tag ``i`` (0-based) from response lists ``name``."""
    first = f"list_position({name}_id, i::VARCHAR)"
    return (
        f"case when {first} is not null and {first} > 0 then {name}_content[{first}] "
        f"when {name}_id[i + 1] is null then {name}_content[i + 1] end"
    )


def unescaped(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


ORACLES["pair_validate"] = f"with {PARSED} select row_id, strict as is_valid from v"


def infilled(condition: str) -> str:
    return f"""with {PARSED},
e as (select *, unnest(case when {condition} and len(q_id) > 0 then range(0, len(q_id)) else [null] end) as i from v)
select row_id, i::INT as place, case when i is not null then {unescaped('q_desc[i + 1]')} end as tag_desc,
  case when i is not null then {filled('c')} end as content from e"""


ORACLES["infill_strict"] = infilled("strict")
ORACLES["infill_lenient"] = infilled("lenient")

# ---- sampling -------------------------------------------------------------------------------------------


def order_by(seed: int, salt: str, *keys: str) -> str:
    return f"order by {h(lit(str(seed)), lit(salt), *keys)}, {', '.join(keys)}"


def ranked(seed: int, salt: str, by: str = "") -> str:
    part = f"partition by {by} " if by else ""
    return f"row_number() over ({part}{order_by(seed, salt, 'doc_id')}) - 1"


N = "(select count(*) from documents)"
ORACLES["shuffle_rank"] = f"select doc_id, source, {ranked(42, 'order')} as rank from documents"
ORACLES["head_n"] = (
    f"select doc_id, text from (select *, {ranked(42, 'order')} as r from documents) where r < {N} // 3"
)
ORACLES["sample_wor"] = (
    f"select doc_id, source, text from (select *, {ranked(7, 'order', 'source')} as r, "
    "count(*) over (partition by source) as c from documents) where r < c // 3"
)


def drawn(k: str) -> str:
    pick_ = f"{h(chr(39) + '42' + chr(39), chr(39) + 'draw' + chr(39), chr(39) + 'all' + chr(39), 'draw')} % {N}"
    return (
        f"select r.doc_id, r.source, d.draw from (select draw, {pick_} as idx from (select unnest(range(0, {k})) as draw)) d "
        f"join (select doc_id, source, {ranked(42, 'pool')} as rank from documents) r on r.rank = d.idx"
    )


ORACLES["sample_wr"] = drawn(f"2 * {N}")
ORACLES["sample_adaptive"] = (
    f"select doc_id, source, r as draw, 'small' as part from (select *, {ranked(42, 'pool')} as r from documents) where r < {N} // 2 "
    f"union all select doc_id, source, draw, 'large' as part from ({drawn(f'{N} + {N} // 2')})"
)
ORACLES["repeat_subset"] = (
    "select doc_id, source, unnest(range(1, case when source = 'src1' then 4 else 2 end))::INT as copy from documents"
)
ORACLES["content_keys_events"] = """with d as (select count(*) as c from events group by event_id, ts, user_id, event_type, value, props),
n as (select unnest(range(0, 2 * c)) as occurrence from d)
select occurrence, count(*) as n, count(*) as digests from n group by occurrence"""
ORACLES["content_keys"] = (
    "select md5(text) as text_md5, lang, row_number() over (partition by text, lang) - 1 as occurrence from documents"
)


# ---- mixtures ---------------------------------------------------------------------------------------------
def pool_case(pools, subset: str = "subset") -> str:
    cases = " ".join(
        f"when {subset} in ({', '.join(lit(s) for s in sorted(set(subsets)))}) then {lit(name)}"
        for name, subsets in pools.items()
    )
    return f"case {cases} end"


def mixture(
    pool: str, quotas: str, replace: str, where: str = "true", copies: str | None = None,
    columns: str = "r.row_id, r.subset, p.pool, p.draw, p.pos, md5(r.query) as query_md5",
) -> str:
    """``quotas``: SQL giving (pool, k); ``replace``: SQL condition over k and size."""
    copy = f"unnest(range(1, {copies} + 1))" if copies else "1"
    keys = "row_id, copy" if copies else "row_id"
    rank = f"row_number() over (partition by pool {order_by(42, 'pool', *keys.split(', '))}) - 1"
    return f"""with src as ({view_sql('subset')}),
tiered as (select *, {copy} as copy from (select *, {pool} as pool from src where {where}) where pool is not null),
sizes as (select pool, count(*) as size from tiered group by pool),
total as (select count(*) as n from documents),
quota as ({quotas}),
rows_ as (select *, {rank} as rank from tiered),
numbers as (select q.pool, q.k, s.size, unnest(range(0, q.k)) as draw from quota q join sizes s on s.pool = q.pool where q.k > 0),
draws as (select pool, draw, case when {replace} then {h("'42'", "'draw'", "pool", "draw")} % size else draw end as rank from numbers),
placed as (select *, row_number() over ({order_by(42, 'mix', 'pool', 'draw')}) - 1 as pos from draws)
select {columns}
from placed p join rows_ r on r.pool = p.pool and r.rank = p.rank"""


TIER = pool_case(TIER_SOURCES)
ORACLES["mix_weights"] = mixture(
    TIER,
    "select 'high' as pool, n * 3 // 6 as k from total union all select 'mid', n * 1 // 6 from total "
    "union all select 'low', n - n * 3 // 6 - n * 1 // 6 from total",
    "true",
)
LEFT = "(n * 9 // 10 - size)"
ORACLES["mix_keep_high"] = mixture(
    TIER,
    "select 'high' as pool, size as k from sizes where pool = 'high' union all "
    f"select 'mid', floor({LEFT} * 0.6::DOUBLE)::BIGINT from total, sizes where pool = 'high' union all "
    f"select 'low', {LEFT} - floor({LEFT} * 0.6::DOUBLE)::BIGINT from total, sizes where pool = 'high'",
    "false",
)
ORACLES["mix_long_only"] = mixture(
    TIER,
    "select 'high' as pool, size as k from sizes where pool = 'high' union all "
    "select 'mid', (n - size) // 2 from total, sizes where pool = 'high' union all "
    "select 'low', n - size - (n - size) // 2 from total, sizes where pool = 'high'",
    "true",
    where="length(query) + length(response) > 2000",
)
CLASS = (
    f"case when ({TIER}) is not null then case when length(query) > 6000 then "
    f"case when ({TIER}) = 'high' then 'long_high' else 'long_rest' end else 'short_' || ({TIER}) end end"
)
SIZE = "coalesce((select size from sizes where pool = '{}'), 0)"
ORACLES["mix_long_short"] = mixture(
    CLASS,
    f"select 'long_high' as pool, least(n // 10, {SIZE.format('long_high')}) as k from total union all "
    f"select 'long_rest', least(n // 10 - least(n // 10, {SIZE.format('long_high')}), {SIZE.format('long_rest')}) from total union all "
    f"select 'short_high', least(n // 4, {SIZE.format('short_high')}) from total union all "
    f"select 'short_mid', least(n // 8, {SIZE.format('short_mid')}) from total union all "
    f"select 'short_low', least(n // 8, {SIZE.format('short_low')}) from total",
    "false",
)
ORACLES["mix_two_kinds"] = mixture(
    pool_case(KIND_SOURCES),
    "select 'poisson' as pool, n // 2 as k from total union all select 'semantic', n - n // 2 from total",
    "true",
)
ORACLES["mix_ablation"] = mixture(
    TIER,
    "select 'mid' as pool, n // 4 // 2 as k from total union all select 'low', n // 4 - n // 4 // 2 from total",
    "false",
)
ORACLES["mix_quotas"] = mixture(
    pool_case(FOUR_TIER_SOURCES),
    "select 'verifiable' as pool, n // 4 as k from total union all select 'high', n // 5 from total "
    "union all select 'mid', n // 3 from total union all select 'low', n // 10 from total",
    "k > size",
    copies="case when subset = 'src1' then 3 else 1 end",
)
ORACLES["pool_counts"] = (
    f"select pool, count(*) as n from (select {CLASS} as pool from ({view_sql('subset')})) group by pool"
)
SPLIT = (
    f"case when {ranked(42, 'split', 'source')} < (count(*) over (partition by source) + 9) // 10 "
    "then 'test' else 'train' end as split"
)
ORACLES["split_90_10"] = f"select doc_id, source, {SPLIT} from documents"
ORACLES["split_head"] = (
    f"select doc_id, source, pos, case when pos < {N} * 98 // 100 then 'train' else 'eval' end as split "
    f"from (select doc_id, source, {ranked(42, 'order')} as pos from documents)"
)

# ---- chat ---------------------------------------------------------------------------------------------------
USER, ASSISTANT, END = "'<|im_start|>user' || chr(10)", "'<|im_start|>assistant' || chr(10)", "'<|im_end|>' || chr(10)"
PAIR_TEXT = f"{USER} || query || {END} || {ASSISTANT} || response || {END}"
ORACLES["chat_render"] = f"select row_id, {PAIR_TEXT} as text from ({ORACLES['mask_poisson']})"
ORACLES["chat_render_turn"] = (
    "select row_id, '<|turn>user' || chr(10) || q || '<turn|>' || chr(10) || '<|turn>model' || chr(10) || a || "
    f"'<turn|>' || chr(10) as text from ({ORACLES['qa_math']})"
)
ORACLES["chat_request"] = (
    f"select row_id, {USER} || {wrap_query(f'problem || {tag()} || solution')} || {END} || {ASSISTANT} as text "
    f"from ({view_sql('problem')})"
)
ORACLES["prompt_rows"] = (
    "select row_id, 1 as messages, 'user' as role, query as content, response as solution "
    f"from ({ORACLES['mask_solution']})"
)
ORACLES["response_span"] = (
    f"select row_id, (length(query) + length({USER} || {END} || {ASSISTANT}))::INT as start, "
    f"length({PAIR_TEXT})::INT as end from ({ORACLES['mask_poisson']})"
).replace(" as end", ' as "end"')

ORACLES["chat_training_set"] = mixture(
    TIER,
    "select 'high' as pool, n * 3 // 6 as k from total union all select 'mid', n * 2 // 6 from total "
    "union all select 'low', n - n * 3 // 6 - n * 2 // 6 from total",
    "true",
    columns=f"p.pos, {PAIR_TEXT.replace('query', 'r.query').replace('response', 'r.response')} as text, "
    f"case when p.pos < {N} * 98 // 100 then 'train' else 'eval' end as split",
)



def pre_tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\p{{L}}+|\\p{{N}}+|[^\\x20\\x09-\\x0D\\p{{L}}\\p{{N}}]+'))::INT"


def within_budget(source: str) -> str:
    """Rows with prompt and chat lengths in the budget of 1024: two thirds, and all but 256."""
    prompt = f"{USER} || query || {END} || {ASSISTANT}"
    lengths = f"{pre_tokens(prompt)} as len_prompt, {pre_tokens(PAIR_TEXT)} as len_prompt_completion"
    return f"select * from (select *, {lengths} from ({source})) where len_prompt <= 682 and len_prompt_completion <= 768"


BUDGETED = within_budget(ORACLES["mask_solution"])
ORACLES["token_budget"] = f"select row_id, len_prompt, len_prompt_completion from ({BUDGETED})"
ORACLES["token_max"] = (
    "select max(len_prompt) as max_prompt, max(len_prompt_completion) as max_prompt_completion, max(len_prompt) + 1 as prompt_limit, "
    f"1024 - (max(len_prompt) + 2) as completion_limit from ({BUDGETED})"
)

PROMPTS = within_budget(
    mixture(
        pool_case(FOUR_TIER_SOURCES),
        "select 'verifiable' as pool, n // 5 as k from total union all select 'high', n // 5 from total "
        "union all select 'mid', n // 10 from total union all select 'low', n // 10 from total",
        "k > size",
        copies="case when subset = 'src1' then 3 else 1 end",
        columns="p.pos, r.row_id, r.query, r.response",
    )
)
ORACLES["prompt_training_set"] = (
    "select pos, row_id, len_prompt, len_prompt_completion, 1 as messages, 'user' as role, query as content, "
    f"response as solution from ({PROMPTS})"
)
ORACLES["first_rows_training_set"] = (
    f"select pos, {PAIR_TEXT} as text, case when pos < ({N} // 3) * 98 // 100 then 'train' else 'eval' end as split "
    f"from (select *, row_number() over ({order_by(42, 'order', 'row_id')}) - 1 as pos from ({view_sql('subset')})) where pos < {N} // 3"
)

# ---- rewards ---------------------------------------------------------------------------------------------------


def cleaned(x: str) -> str:
    """Trimmed, without dollar signs at the ends and one box, a fraction command as a/b."""
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    bare = f"trim(trim(trim({x}, {blanks}), '$'), {blanks})"
    box = chr(92) * 2 + "boxed" + chr(92) + "{"
    bare = f"case when regexp_matches({bare}, {lit('^' + box)}) and ends_with({bare}, '}}') then trim(trim(trim({bare}[8:-2], {blanks}), '$'), {blanks}) else {bare} end"
    part = chr(92) + "{" + chr(92) + "s*([^{}" + chr(92) + "s]*)" + chr(92) + "s*" + chr(92) + "}"
    return f"regexp_replace({bare}, {lit('^([+-]?)' + chr(92) * 2 + '[dt]?frac' + part + part + '$')}, '\\1\\2/\\3')"


def numeric_equal(a: str, b: str) -> str:
    """Decimals of any length by their canonical text; fractions as 128-bit whole numbers; commas only before groups of three."""
    form = r"[+-]?(?:\d{1,3}(?:,\d{3})*(?:\.\d*)?|\d{4,}(?:\.\d*)?|\.\d+)"
    number, ratio = lit(f"^{form}$"), lit(f"^{form}(?:/{form})?$")
    x, y = cleaned(a), cleaned(b)

    def whole(t):
        return f"ltrim(replace(replace(split_part(ltrim({t}, '+-'), '.', 1), ',', '') || {decimals(t)}, '.', ''), '0')"

    def decimals(t):
        return f"rtrim(case when contains({t}, '.') then split_part({t}, '.', 2) else '' end, '0')"

    def canonical(t):
        return f"case when {whole(t)} = '' then '0' else case when starts_with({t}, '-') then '-' else '' end || {whole(t)} || 'e' || length({decimals(t)}) end"

    def scaled(t, zeros):
        return f"(case when starts_with({t}, '-') then -1 else 1 end * try_cast('0' || {whole(t)} || repeat('0', {zeros}) as hugeint))"

    def top(t):
        return f"split_part({t}, '/', 1)"

    def bottom(t):
        return f"case when contains({t}, '/') then split_part({t}, '/', 2) else '1' end"

    def scale(t):
        return f"length({decimals(t)})"

    left = f"{scaled(top(x), f'{scale(top(y))} + {scale(bottom(x))}')} * {scaled(bottom(y), '0')}"
    right = f"{scaled(top(y), f'{scale(top(x))} + {scale(bottom(y))}')} * {scaled(bottom(x), '0')}"
    return f"""coalesce(case when regexp_matches({x}, {number}) and regexp_matches({y}, {number})
      then {canonical(x)} = {canonical(y)}
      else regexp_matches({x}, {ratio}) and regexp_matches({y}, {ratio}) and {whole(bottom(x))} <> '' and {whole(bottom(y))} <> ''
        and {left} = {right} end, false)"""


SCORED = f"""with {PARSED},
e as (select row_id, unnest(range(0, len(q_id))) as i, q_id, c_id, c_content, g_id, g_content from v where lenient and golden_ok),
m as (select row_id, i, {filled('c')} as p, {filled('g')} as g from e),
k as (select row_id, count(*) as total,
    count(*) filter (where p is not distinct from g) as exact,
    count(*) filter (where coalesce({strip('p')} = {strip('g')}, false) or {numeric_equal('p', 'g')}) as loose
  from m group by row_id),
b as (select v.row_id, v.step, v.query, v.completion, v.golden, v.strict, v.lenient, v.golden_ok, length(completion) as cl, length(golden) as gl,
    case when lenient and golden_ok then coalesce(total, 0) end as total,
    case when lenient and golden_ok then coalesce(exact, 0) end as exact,
    case when lenient and golden_ok then coalesce(loose, 0) end as loose,
    length(completion) / greatest(length(golden), 1) as ratio
  from v left join k on k.row_id = v.row_id),
s as (select *, case when ratio <= 1.2::DOUBLE then 1.0::DOUBLE
    when ratio <= 2 then 1.0::DOUBLE - 0.3::DOUBLE * (ratio - 1.2::DOUBLE) / 0.8::DOUBLE
    else 0.7::DOUBLE * exp(-(ratio - 2)) end as factor, exact / greatest(total, 1) as acc from b)"""

SCORES = {
    "format_v1": "case when strict then 2 when golden_ok then 1 else -1 end",
    "format": "case when strict then 2 when lenient then 1 else -1 end",
    "length_sign": "case when cl <= gl then 1 else -1 end",
    "length_clip": "greatest(-1, least(1, 1 - ratio))",
    "tags": "coalesce(exact, 0)",
    "accuracy_length": "coalesce((2 * acc - 1) * factor + case when acc = 1 then 0.5 else 0 end, -1)",
    "strict_length": "case when strict then exact * factor else -1 end",
    "loose_length": "case when strict then loose * factor else -1 end",
}


def scores(*names: str) -> str:
    columns = ", ".join(f"round(({SCORES[n]})::DOUBLE, 6) as {n}" for n in names)
    return f"{SCORED} select row_id, {columns} from s"


ORACLES["reward_format_v1"] = scores("format_v1")
ORACLES["reward_format"] = scores("format")
ORACLES["reward_length_sign"] = scores("length_sign")
ORACLES["reward_length_clip"] = scores("length_clip")
ORACLES["reward_tags"] = scores("tags")
ORACLES["reward_mix"] = scores("accuracy_length")
ORACLES["reward_strict"] = scores("strict_length")
ORACLES["reward_loose"] = scores("loose_length")
ORACLES["reward_several"] = scores(*SCORES)
ORACLES["reward_stats"] = f"""{SCORED}
select step, round(avg(loose) filter (where strict and golden_ok), 6) as correct_tags,
  round(avg(loose / greatest(total, 1)) filter (where strict and golden_ok), 6) as accuracy,
  round(avg((loose / greatest(total, 1) = 1)::INT) filter (where strict and golden_ok), 6) as perfect,
  round(avg(ratio) filter (where strict and golden_ok), 6) as ratio, round(avg(factor) filter (where strict and golden_ok), 6) as factor,
  round(avg(loose * factor) filter (where strict and golden_ok), 6) as reward,
  count(*) filter (where not (strict and golden_ok)) as failures, count(*) as rollouts
from s group by step"""
ORACLES["reward_samples"] = f"""{SCORED}
select step, row_id, query, completion, golden, case when strict and golden_ok then loose::INT end as correct_tags,
  case when strict and golden_ok then round(ratio, 6) end as ratio, case when strict and golden_ok then round(loose * factor, 6) end as reward
from s where (step + 1) % 10 = 0 qualify row_number() over (partition by step order by row_id desc) = 1"""
ORACLES["reward_samples_first"] = f"""{SCORED}
select step, row_id, left(query, 1000) as query, left(completion, 2000) as completion, left(golden, 2000) as golden,
  exact::INT as correct_tags, round(ratio, 6) as ratio,
  round((2 * acc - 1) * factor + case when acc = 1 then 0.5 else 0 end, 6) as reward
from s where (step + 1) % 20 = 0 and lenient and golden_ok qualify row_number() over (partition by step order by row_id) = 1"""

# ---- viewing -------------------------------------------------------------------------------------------------------
ORACLES["row_format"] = f"""select row_id, case
  when row_id % 3 > 0 and query <> '' and row_id % 5 <> 0 and response <> '' then 'pair'
  when row_id % 2 = 0 then 'messages' else 'unknown' end as format from ({view_sql('subset')})"""
ORACLES["page_n"] = (
    "select doc_id, source, text, rank from (select doc_id, source, text, row_number() over (order by doc_id) - 1 as rank "
    f"from documents) where rank >= {N} // 2 and rank < {N} // 2 + 25"
)
ORACLES["page_indexed"] = (
    "select doc_id, source, rank from (select doc_id, source, row_number() over (order by doc_id) - 1 as rank from documents) "
    f"where rank < 25 or (rank >= {N} // 2 and rank < {N} // 2 + 25) or rank >= {N} - 7"
)
SHOWN = "'\\(<b>\\) \\[x\\] ' || text"
ESCAPED = f"replace(replace(replace({SHOWN}, '<', '&lt;'), '>', '&gt;'), chr(10), '<br>')"
ORACLES["display_escape"] = (
    f"select doc_id, regexp_replace({ESCAPED}, '\\\\[()\\[\\]]', '$', 'g') as plain, {ESCAPED} as latex from documents"
)
ORACLES["messages_flat"] = f"""select row_id, 0 as pos, 'USER' as role, query as content from ({view_sql('subset')})
union all select row_id, 1, 'ASSISTANT', response from ({view_sql('subset')})"""

# ---- sources, sinks, whole builds -----------------------------------------------------------------------------------
ORACLES["jsonl_roundtrip"] = (
    "select doc_id, text, case when lang <> 'en' then lang end as lang, source as subset, 'train' as split from documents"
)
ORACLES["jsonl_quarantine"] = """select doc_id, case when doc_id % 10 <> 3 then text end as text,
  case when doc_id % 10 = 3 then 'quarantine' else 'row' end as status from documents where doc_id % 10 not in (5, 7)"""
_TOKEN = lit(r'<\|/?(?:MASKED|M_INPUT|M_OUTPUT)(?: id="m_\d+")?(?: desc="[^"]*")?(?:\|>)?')


def _side(name: str, wrap: str, numbered: bool) -> str:
    """The first fault among a text's delimiters, by row: its kind and place."""
    anonymous = "false" if numbered else "not starts_with(tok, '<|MASKED id=')"
    between = "i > 0 and (i % 2 = 1 or i = n - 1) and before <> '' and n > 2" if numbered else "false"
    return f"""
{name}_tokens as (
  select row_id, {name} as body, unnest(regexp_extract_all({name}, {_TOKEN})) as tok, unnest(string_split_regex({name}, {_TOKEN})[:-2]) as before,
    unnest(range(0, len(regexp_extract_all({name}, {_TOKEN})))) as i, len(regexp_extract_all({name}, {_TOKEN})) as n from damaged),
{name}_faults as (
  select row_id, i, sum(length(before)) over w + coalesce(sum(length(tok)) over (partition by row_id order by i rows between unbounded preceding and 1 preceding), 0) as place,
    case when i = 0 then (case when tok = '<|{wrap}|>' then 0 else 1 end)
      when i = n - 1 then (case when tok <> '<|/{wrap}|>' then 1 when {between} then 3 else 0 end)
      when i % 2 = 0 then (case when tok = '<|/MASKED|>' then 0 else 1 end)
      when not starts_with(tok, '<|MASKED') or not ends_with(tok, '|>') then 1
      when not (starts_with(tok, '<|MASKED id="m_' || (i // 2) || '"') or {anonymous}) then 2
      when {between} then 3 else 0 end as kind
  from {name}_tokens window w as (partition by row_id order by i)),
{name}_first as (select row_id, arg_min(kind, i) as kind, arg_min(place, i)::BIGINT as place from {name}_faults where kind > 0 group by row_id)"""


def _fault(name: str, wrap: str) -> tuple[str, str]:
    bare = f"not (starts_with({name}, '<|{wrap}|>') and ends_with({name}, '<|/{wrap}|>') and length({name}) >= {len(wrap) * 2 + 9})"
    count = f"len(regexp_extract_all({name}, {_TOKEN}))"
    reason = (
        f"when {name} is null then '{name}: missing' when {bare} then '{name}: not wrapped' when {name}_first.kind is not null then '{name}: ' || "
        f"['delimiter out of place', 'tag number out of order', 'text between tags'][{name}_first.kind] when {count} % 2 = 1 then '{name}: delimiter out of place'"
    )
    place = f"when {name} is null then null when {bare} then 0 when {name}_first.kind is not null then {name}_first.place when {count} % 2 = 1 then length({name})"
    return reason, place


_FAULTS = [_fault("query", "M_INPUT"), _fault("response", "M_OUTPUT")]
_OTHER = f"len(regexp_extract_all(query, {_TOKEN})) <> len(regexp_extract_all(response, {_TOKEN}))"
ORACLES["gate_reasons"] = f"""with rollouts as ({view_sql('rollouts')}),
damaged as (
  select row_id,
    case doc_kind when 1 then replace(query, ' desc="', ' id="m_3" desc="') when 2 then query || '<|/MASKED|>' else query end as query,
    case doc_kind when 3 then replace(completion, '<|/MASKED|>', '<|/MASKED|> ') when 4 then replace(completion, '<|/MASKED|>', '<|M_INPUT') else completion end as response
  from (select *, row_id // 12 % 5 as doc_kind from rollouts)),{_side('query', 'M_INPUT', False)},{_side('response', 'M_OUTPUT', True)}
select row_id, case {_FAULTS[0][0]} {_FAULTS[1][0]} when {_OTHER} then 'response: another number of tags' end as reason,
  (case {_FAULTS[0][1]} {_FAULTS[1][1]} end)::BIGINT as at
from damaged left join query_first using (row_id) left join response_first using (row_id)"""
ORACLES["jsonl_statuses"] = """select case doc_id % 10 when 3 then 'broken' when 8 then 'byte_order_mark' when 9 then 'not_utf8' else 'row' end as status,
  doc_id, case when doc_id % 10 not in (3, 8, 9) then length(text) end as chars from documents where doc_id % 10 not in (5, 7)"""
ORACLES["publish_replace"] = """select subset, split, count(*) as n, sum(length(text))::BIGINT as chars, count(*) as manifest_rows, false as wrong
from (select source as subset, 'train' as split, case when source = 'src1' then 'new ' || text else text end as text
  from documents where source <> 'src1' or doc_id % 3 = 0) group by subset, split"""
ORACLES["split_shards"] = """select doc_id, length(text) as chars from documents where doc_id % 10 = 0
union all select -1, count(*) from documents where doc_id % 10 = 0"""
ORACLES["shuffled_files"] = f"""select rank // 1000 as block, min(rank) as first, max(rank) as last, count(*) as n, arg_min(doc_id, rank) as first_doc, arg_max(doc_id, rank) as last_doc
from (select doc_id, {ranked(42, 'order')} as rank from documents) group by rank // 1000"""
ORACLES["publish_layout"] = f"""select source as subset, split, count(*) as n, sum(length(text))::BIGINT as chars
from (select *, {SPLIT} from documents) group by source, split"""

PAIRS = {
    "cnn_daily_mail": "mask_poisson",
    "gsm8k_reasoning": "mask_structured",
    "hk_o1aw": "mask_between",
    "kaist_cot": "mask_two_part",
    "lima": "mask_one_turn",
    "magpie_reasoning": "mask_fields",
    "numina_math": "mask_solution",
    "o1_journey": "mask_chain",
    "process_bench": "mask_steps",
    "uhgeval": "mask_poisson_fields",
}
ORACLES["build_all_pairs"] = " union all ".join(
    f"""select '{name}' as subset, count(*) filter (where query is not null and response is not null)::BIGINT as pairs,
  count(*) filter (where query is null or response is null) as quarantined,
  sum(length(response)) filter (where query is not null and response is not null)::BIGINT as response_chars
from ({ORACLES[source]})"""
    for name, source in PAIRS.items()
)
QA = {
    "cnn_daily_mail": "qa_article",
    "gsm8k_reasoning": "qa_tagged",
    "hk_o1aw": "qa_reason_answer",
    "kaist_cot": "qa_rationale",
    "lima": "qa_pairs_from_turns",
    "magpie_reasoning": "qa_instruct",
    "numina_math": "qa_math",
    "o1_journey": "qa_cut_chain",
    "process_bench": "qa_steps_joined",
    "uhgeval": "qa_news",
}
ALL_QA = " union all ".join(
    f"select '{name}' as subset, {'conv_id' if name == 'lima' else 'row_id'} as row_id, "
    f"{'pair' if name == 'lima' else '0'} as pair, q, a from ({ORACLES[source]})"
    for name, source in QA.items()
)
ORACLES["build_all_qa"] = f"""with rows_ as ({ALL_QA}),
labelled as (select *, case when row_number() over (partition by subset {order_by(42, 'split', 'row_id', 'pair')})
  <= (count(*) over (partition by subset) + 9) // 10 then 'test' else 'train' end as split from rows_)
select subset, split, count(*) as n, sum(length(q))::BIGINT as q_chars, sum(length(a))::BIGINT as a_chars
from labelled group by subset, split"""

_PUBLISHED = f"select doc_id, text, source as subset, {SPLIT} from documents"
ORACLES["read_one_split"] = f"select * from ({_PUBLISHED}) where subset = 'src1' and split = 'test'"
ORACLES["read_all_splits"] = f"select * from ({_PUBLISHED}) where subset = 'src1'"
ORACLES["jsonl_plain_tree"] = (
    "select text as query, source as response, case when lang is not distinct from 'en' then 'english' else 'other' end as subset, "
    "'train' as split from documents"
)
ORACLES["gate_split"] = f"with {PARSED} select row_id, query, completion as response, strict as kept from v"
ORACLES["build_chosen_pairs"] = (
    f"select subset, pairs, quarantined from ({ORACLES['build_all_pairs']}) where subset in ('numina_math', 'hk_o1aw')"
)
ORACLES["qa_absent_column"] = qa("reason", canon("prompt"), canon("answer"))
