"""Masked query/response pairs, one rule per kind of corpus.

Every rule is a pair of column expressions over one row, so a whole masking build is a
single map-only stage: no shuffle, no Python, any number of partitions.
A null input makes the pair null; ``gate`` (see ``operators.gate``) sets such rows aside.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillweave.functions import fixed
from quillweave.functions.binding import let
from quillweave.functions.grammar import DEFAULT as DEFAULT_GRAMMAR
from quillweave.functions.grammar import TagGrammar
from quillweave.functions.hashing import below, choose, choose_lazily, flag, poisson
from quillweave.functions.text import before, fill, fill_choice, strip
from quillweave.functions.wording import DEFAULT as DEFAULT_WORDING
from quillweave.functions.wording import Wording
from quillweave.operators.gate import pinned

RANGE_TYPE = "array<struct<s:int,e:int>>"


# ---- random spans -------------------------------------------------------------------
def mask_count(length: Column, lam: float, seed: int, *key: Column) -> Column:
    """Poisson number of masks, never more than the text can hold (two positions each)."""
    return F.least(poisson(lam, seed, "count", *key), F.floor(length / 2).cast("int"))


def mask_ranges(length: Column, count: Column, seed: int, *key: Column) -> Column:
    """``count`` disjoint ``[s, e)`` ranges: ``2*count`` distinct positions drawn from
    ``0..length-1`` with one hash per position (Floyd's sampling), sorted and paired up."""
    drawn = F.transform(
        F.sequence(length - 2 * count, length - 1),
        lambda j: F.struct(
            j.cast("int").alias("last"),
            below(j + 1, seed, "span", *key, j).cast("int").alias("pick"),
        ),
    )
    positions = F.aggregate(
        drawn,
        F.array().cast("array<int>"),
        lambda seen, d: F.when(
            F.array_contains(seen, d["pick"]), F.array_append(seen, d["last"])
        ).otherwise(F.array_append(seen, d["pick"])),
    )
    paired = let(
        F.array_sort(positions),
        lambda p: F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.struct(F.get(p, 2 * i).alias("s"), F.get(p, 2 * i + 1).alias("e")),
        ),
    )
    # sequence() counts down when its end is smaller than its start, hence the guard
    return F.when(count > 0, paired.cast(RANGE_TYPE)).when(
        count.isNotNull(), F.array().cast(RANGE_TYPE)
    )


def _cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def span_query(
    text: Column, ranges: Column, seed: int, *key: Column, grammar: TagGrammar, wording: Wording
) -> Column:
    """Text with each range replaced by one of four tag shapes."""

    def build(r: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            kept_from = F.coalesce(F.get(r, i - 1)["e"], F.lit(0))
            shapes = [
                grammar.render(id=i),
                grammar.render(),
                grammar.render(desc=wording.span_plain),
                grammar.render(id=i, desc=wording.span_numbered),
            ]
            tag = choose_lazily(shapes, seed, "shape", *key, i)
            return F.concat(_cut(text, kept_from, x["s"]), tag)

        tail_from = F.coalesce(F.get(r, F.size(r) - 1)["e"], F.lit(0))
        tail = _cut(text, tail_from, F.char_length(text))
        return F.concat(F.array_join(F.transform(r, piece), ""), tail)

    return let(ranges, build)


def span_response(text: Column, ranges: Column, *, grammar: TagGrammar) -> Column:
    return F.array_join(
        F.transform(ranges, lambda x, i: grammar.render(id=i, content=_cut(text, x["s"], x["e"]))),
        "",
    )


def mask_spans(
    df: DataFrame,
    text: Column,
    key: Sequence[str],
    *,
    keep: Sequence[str] = (),
    lam: float = 4,
    seed: int = 0,
    grammar: TagGrammar = DEFAULT_GRAMMAR,
    wording: Wording = DEFAULT_WORDING,
) -> DataFrame:
    """Random-span pairs of ``text``: columns ``key``, ``keep``, ``query``, ``response``."""
    keys = [F.col(k) for k in key]
    staged = (
        df.select(*keys, *keep, text.alias("_text"))
        .withColumn("_m", mask_count(F.char_length("_text"), lam, seed, *keys))
        .withColumn("_r", mask_ranges(F.char_length("_text"), F.col("_m"), seed, *keys))
    )
    body = span_query(
        F.col("_text"), F.col("_r"), seed, *keys, grammar=grammar, wording=wording
    )
    return staged.select(
        *keys,
        *keep,
        grammar.wrap_query(body).alias("query"),
        grammar.wrap_response(
            span_response(F.col("_text"), F.col("_r"), grammar=grammar)
        ).alias("response"),
    )


# ---- tagged reasoning ---------------------------------------------------------------
def extract_tags(c: Column, names: Sequence[str] = fixed.REASONING_TAGS) -> Column:
    """Struct of the trimmed texts of ``names``: last occurrence wins, missing is empty.

    Any tag name matches (the closing name must repeat the opening one), so an outer
    unknown tag swallows what is inside it.

    One scan lists opening and closing tags; a tag opens only if its name is closed later on.
    Then one pass over the list keeps where each wanted name's last contents lie, so unclosed
    tags cost nothing extra.
    """
    source = F.coalesce(c, F.lit(""))
    nowhere = F.lit(None).cast("int")

    def listed(t: Column) -> Column:
        tokens = F.regexp_extract_all(t, F.lit(fixed.TAG_TOKEN), F.lit(0))
        gaps = F.split(t, fixed.TAG_TOKEN, -1)

        def paired(v: Column) -> Column:
            return F.zip_with(
                v["tokens"],
                F.slice(v["gaps"], 1, F.size(v["tokens"])),
                lambda x, gap: F.struct(
                    F.regexp_extract(x, r"(?U)(\w+)", 1).alias("name"), x.rlike(f"^{fixed.TAG_CLOSE}").alias("closes"),
                    F.char_length(gap).alias("gap"), F.char_length(x).alias("long"),
                ),
            )

        return let(F.struct(tokens.alias("tokens"), gaps.alias("gaps")), paired)

    def marked(tokens: Column) -> Column:
        """Tokens with whether an opening one is closed later."""
        placed = F.transform(tokens, lambda x, i: F.struct(x["name"].alias("name"), i.alias("at"), x["closes"].alias("closes")))
        closing = F.array_sort(F.transform(F.filter(placed, lambda x: x["closes"]), lambda x: F.struct(x["name"], x["at"])))

        def lasts(sorted_: Column) -> Column:
            kept = F.filter(sorted_, lambda x, j: ~F.coalesce(F.get(sorted_, j + 1)["name"] == x["name"], F.lit(False)))
            return F.map_from_entries(kept)

        def mark(v: Column) -> Column:
            return F.transform(
                v["tokens"],
                lambda x, i: F.struct(
                    x["name"].alias("name"), x["closes"].alias("closes"), x["gap"].alias("gap"), x["long"].alias("long"),
                    (~x["closes"] & F.coalesce(F.try_element_at(v["last"], x["name"]) > i, F.lit(False))).alias("opens"),
                ),
            )

        return let(F.struct(tokens.alias("tokens"), let(closing, lasts).alias("last")), mark)

    def walk(tokens: Column) -> Column:
        spots = [nowhere.alias(f"{side}{i}") for i in range(len(names)) for side in "se"]
        start = F.struct(F.lit(0).alias("pos"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("from"), *spots)

        def step(acc: Column, x: Column) -> Column:
            here = acc["pos"] + x["gap"]
            ends = x["closes"] & F.coalesce(x["name"] == acc["open"], F.lit(False))
            begins = acc["open"].isNull() & x["opens"]
            found = []
            for i, name in enumerate(names):
                mine = ends & (x["name"] == name)
                found.append(F.when(mine, acc["from"]).otherwise(acc[f"s{i}"]).alias(f"s{i}"))
                found.append(F.when(mine, here).otherwise(acc[f"e{i}"]).alias(f"e{i}"))
            return F.struct(
                (here + x["long"]).alias("pos"),
                F.when(begins, x["name"]).when(~ends, acc["open"]).alias("open"),
                F.when(begins, here + x["long"]).otherwise(acc["from"]).alias("from"),
                *found,
            )

        return F.aggregate(tokens, start, step)

    def texts(v: Column) -> Column:
        def last(i: int, name: str) -> Column:
            s, e = v["at"][f"s{i}"], v["at"][f"e{i}"]
            return F.coalesce(strip(F.substring(v["text"], s + 1, e - s)), F.lit("")).alias(name)

        return F.struct(*[last(i, n) for i, n in enumerate(names)])

    def found(t: Column) -> Column:
        at = let(let(let(t, listed), marked), walk)
        return let(F.struct(t.alias("text"), at.alias("at")), texts)

    return let(source, found)


# ---- rules: row -> (query body, response body) ----------------------------------------
Rule = Callable[..., tuple[Column, Column]]


def _between(seed, keys, g: TagGrammar, w: Wording):
    desc = choose([g.render(desc=d) for d in w.between_desc], seed, "desc", *keys)
    prompt, answer = strip(F.col("prompt")), F.col("answer")
    query = fill_choice(w.between_layout, [prompt, desc, answer], seed, "layout", *keys)
    return query, g.render(id=0, content=F.col("thinking"))


def _two_part(seed, keys, g: TagGrammar, w: Wording):
    def lead(options):
        return [F.concat(F.lit(text), g.render(desc=desc)) for text, desc in options]

    query = F.concat(
        strip(F.col("source")),
        choose(lead(w.rationale_lead), seed, "rationale", *keys),
        choose(lead(w.target_lead), seed, "target", *keys),
    )
    response = F.concat(
        g.render(id=0, content=F.col("rationale")), g.render(id=1, content=F.col("target"))
    )
    return query, response


def _one_turn(seed, keys, g: TagGrammar, w: Wording):
    turns = F.col("conversations")
    paired = F.floor(F.size(turns) / 2).cast("int")
    usable = turns.isNotNull() & (paired > 0)
    hidden = below(F.greatest(2 * paired, F.lit(1)), seed, "turn", *keys).cast("int")
    parts = F.array(
        *[
            F.struct(*[F.lit(p).alias(n) for n, p in zip("abc", layout.split("{}"))])
            for layout in w.dialogue_layout
        ]
    )
    which = (below(len(w.dialogue_layout), seed, "layout", *keys) + 1).cast("int")

    def build(v: Column) -> Column:
        def shown(i: Column) -> Column:
            return F.when(i == v["hidden"], g.render()).otherwise(F.get(turns, i))

        layout = v["layout"]
        return F.array_join(
            F.transform(
                F.sequence(F.lit(0), paired - 1),
                lambda i: F.concat(
                    layout["a"], shown(2 * i), layout["b"], shown(2 * i + 1), layout["c"]
                ),
            ),
            "",
        )

    choice = F.struct(hidden.alias("hidden"), F.element_at(parts, which).alias("layout"))
    whole = ~F.exists(F.slice(turns, 1, 2 * paired), lambda t: t.isNull())
    query = F.when(usable, F.when(whole, let(choice, build)))
    return query, F.when(usable, g.render(id=0, content=F.get(turns, hidden)))


def _fields(seed, keys, g: TagGrammar, w: Wording):
    hidden = [flag(0.5, seed, "field", name, *keys) for name in fixed.INSTRUCTION_FIELDS]

    def build(flags: Column) -> tuple[list[Column], list[Column]]:
        shown, answers = [F.lit(w.fields_head)], []
        number = F.lit(0)
        for place, (name, desc) in enumerate(zip(fixed.INSTRUCTION_FIELDS, w.field_desc)):
            here = F.get(flags, F.lit(place))
            value = F.col(name)
            shown += [
                F.lit(f"{name}: "),
                F.when(here, g.render(id=number, desc=desc)).otherwise(value),
                F.lit("\n\n"),
            ]
            answers.append(
                F.when(here, g.render(id=number, content=value)).otherwise(
                    F.when(value.isNotNull(), F.lit(""))
                )
            )
            number = number + here.cast("int")
        return shown, answers

    flags = F.array(*hidden)
    query = let(flags, lambda f: F.concat(*build(f)[0]))
    response = let(flags, lambda f: F.concat(*build(f)[1]))
    return query, response


def _solution(seed, keys, g: TagGrammar, w: Wording):
    mask = choose([g.render(desc=d) for d in w.solution_desc], seed, "desc", *keys)
    query = fill_choice(w.solution_layout, [strip(F.col("problem")), mask], seed, "layout", *keys)
    return query, g.render(id=0, content=F.col("solution"))


def _chain(seed, keys, g: TagGrammar, w: Wording):
    query = F.concat(
        strip(F.col("question")),
        F.lit("\n\n"),
        choose([g.render(desc=d) for d in w.chain_desc], seed, "chain", *keys),
        F.lit("\n\n"),
        choose([g.render(desc=d) for d in w.answer_desc], seed, "answer", *keys),
    )
    chain = strip(before(F.col("longCOT"), fixed.CHAIN_MARKER))
    response = F.concat(
        g.render(id=0, content=chain), g.render(id=1, content=strip(F.col("answer")))
    )
    return query, response


def _steps(seed, keys, g: TagGrammar, w: Wording):
    desc = choose(list(w.step_desc), seed, "desc", *keys)

    def masks(d: Column) -> Column:
        def one(_: Column, i: Column) -> Column:
            shapes = [g.render(id=i, desc=d), g.render(desc=d), g.render()]
            return F.concat(F.lit("\n\n"), choose(shapes, seed, "shape", *keys, i))

        return F.array_join(F.transform(F.col("steps"), one), "")

    query = F.concat(
        F.lit(fixed.STEPS_QUESTION_HEAD),
        strip(F.col("problem")),
        F.lit(fixed.STEPS_CHAIN_HEAD),
        let(desc, masks),
    )
    rendered = F.transform(F.col("steps"), lambda s, i: g.render(id=i, content=s))
    response = F.when(~F.exists(F.col("steps"), lambda s: s.isNull()), F.array_join(rendered, ""))
    return query, response


def _structured(seed, keys, g: TagGrammar, w: Wording):
    names = fixed.REASONING_TAGS
    query = F.concat(
        strip(F.col("question")),
        *[F.concat(F.lit("\n\n"), g.render(desc=d)) for d in w.tag_desc],
    )
    response = F.concat(
        *[g.render(id=i, content=F.col(f"_tags.{n}")) for i, n in enumerate(names)]
    )
    return query, response


def _pairs(df: DataFrame, rule: Rule, key, seed, grammar, wording) -> DataFrame:
    keys = [F.col(k) for k in key]
    query, response = rule(seed, keys, grammar, wording)
    return df.select(
        *keys,
        grammar.wrap_query(query).alias("query"),
        grammar.wrap_response(response).alias("response"),
    )


def is_correct_process() -> Column:
    """Steps without a mistake (``label`` -1) and a right final answer."""
    return (F.col("label") == -1) & F.coalesce(F.col("final_answer_correct"), F.lit(False))


def all_tags_present(tags: str = "_tags", names: Sequence[str] = fixed.REASONING_TAGS) -> Column:
    return F.forall(F.array(*[F.col(f"{tags}.{n}") for n in names]), lambda v: v != "")


def mask_cnn_daily_mail(df, key=("row_id",), *, seed=0, grammar=DEFAULT_GRAMMAR, wording=DEFAULT_WORDING):
    return mask_spans(df, F.col("article"), key, seed=seed, grammar=grammar, wording=wording)


def mask_uhgeval(df, key=("row_id",), *, seed=0, grammar=DEFAULT_GRAMMAR, wording=DEFAULT_WORDING):
    text = fill(
        "{}\n{}\n{}\n{}",
        *[F.col(c) for c in ("headLine", "broadcastDate", "newsBeginning", "newsRemainder")],
    )
    return mask_spans(df, text, key, seed=seed, grammar=grammar, wording=wording)


def mask_gsm8k_reasoning(df, key=("row_id",), *, seed=0, grammar=DEFAULT_GRAMMAR, wording=DEFAULT_WORDING):
    """Only rows with all five tags."""
    tagged = pinned(df.withColumn("_tags", extract_tags(F.col("generation"))))
    return _pairs(tagged.filter(all_tags_present()), _structured, key, seed, grammar, wording)


def mask_process_bench(df, key=("row_id",), *, seed=0, grammar=DEFAULT_GRAMMAR, wording=DEFAULT_WORDING):
    """Only correct processes."""
    return _pairs(df.filter(is_correct_process()), _steps, key, seed, grammar, wording)


def _plain(rule: Rule):
    def build(df, key=("row_id",), *, seed=0, grammar=DEFAULT_GRAMMAR, wording=DEFAULT_WORDING):
        return _pairs(df, rule, key, seed, grammar, wording)

    return build


mask_hk_o1aw = _plain(_between)
mask_kaist_cot = _plain(_two_part)
mask_lima = _plain(_one_turn)
mask_magpie_reasoning = _plain(_fields)
mask_numina_math = _plain(_solution)
mask_o1_journey = _plain(_chain)

#: subset name -> builder
MASKERS: dict[str, Callable[..., DataFrame]] = {
    "cnn_daily_mail": mask_cnn_daily_mail,
    "gsm8k_reasoning": mask_gsm8k_reasoning,
    "hk_o1aw": mask_hk_o1aw,
    "kaist_cot": mask_kaist_cot,
    "lima": mask_lima,
    "magpie_reasoning": mask_magpie_reasoning,
    "numina_math": mask_numina_math,
    "o1_journey": mask_o1_journey,
    "process_bench": mask_process_bench,
    "uhgeval": mask_uhgeval,
}
