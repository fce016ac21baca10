"""Question/answer rows, one rule per corpus: columns ``key``, ``q``, ``a``.

Both texts are canonical (trimmed, null is empty) and rows with an empty side are dropped.
Required columns that are missing fail at analysis; optional ones count as null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillweave.functions.fixed import CHAIN_MARKER
from quillweave.functions.text import before, canonical, joined_answer, optional, strip
from quillweave.operators.gate import pinned
from quillweave.operators.masking import is_correct_process


def _rows(df: DataFrame, key: Sequence[str], q: Column, a: Column) -> DataFrame:
    return pinned(df.select(*key, q.alias("q"), a.alias("a"))).filter("q <> '' and a <> ''")


def _need(df: DataFrame, name: str) -> Column:
    return canonical(F.col(name))


def _may(df: DataFrame, name: str) -> Column:
    return canonical(optional(df, name))


def qa_cnn_daily_mail(df, key=("row_id",)):
    return _rows(df, key, _need(df, "article"), _need(df, "highlights"))


def qa_gsm8k_reasoning(df, key=("row_id",)):
    """The tagged text is kept whole."""
    return _rows(df, key, _need(df, "question"), _need(df, "generation"))


def qa_hk_o1aw(df, key=("row_id",)):
    answer = joined_answer(_may(df, "thinking"), _may(df, "answer"))
    return _rows(df, key, _may(df, "prompt"), answer)


def qa_kaist_cot(df, key=("row_id",)):
    answer = joined_answer(_may(df, "rationale"), _may(df, "target"))
    return _rows(df, key, _may(df, "source"), answer)


def qa_lima(df, key=("row_id",)):
    """Turns (0,1), (2,3), ... of a list column; an odd last turn is left out."""
    turns = optional(df, "conversations")
    n_pairs = F.floor(F.size(turns) / 2).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), n_pairs - 1),
        lambda i: F.struct(
            i.alias("pair"),
            canonical(F.get(turns, 2 * i)).alias("q"),
            canonical(F.get(turns, 2 * i + 1)).alias("a"),
        ),
    )
    exploded = df.filter(F.coalesce(n_pairs, F.lit(0)) > 0).select(
        *key, F.explode(pairs).alias("_p")
    )
    return _rows(
        exploded.select(*key, "_p.pair", "_p.q", "_p.a"), (*key, "pair"), F.col("q"), F.col("a")
    )


def qa_from_turns(turns: DataFrame, conv: str = "conv_id", pos: str = "pos", text: str = "text"):
    """The same rows from one-turn-per-row tables.

    Grouping is by (conversation, pair), so a conversation of any length spreads over all
    tasks and no list of its turns is ever built.  A position that a conversation has twice
    fails the job, since one of its turns would be left out.
    """
    pair = F.floor(F.col(pos) / 2).cast("bigint")
    half = F.col(pos) % 2

    def only(side: int):
        repeated = F.count(F.when(half == side, F.lit(1))) > 1
        error = F.raise_error(F.lit(f"{pos} repeats within a conversation"))
        return F.when(repeated, error).otherwise(F.max(F.when(half == side, F.col(text))))

    grouped = turns.groupBy(conv, pair.alias("pair")).agg(only(0).alias("_q"), only(1).alias("_a"))
    return _rows(grouped, (conv, "pair"), canonical(F.col("_q")), canonical(F.col("_a")))


def qa_magpie_reasoning(df, key=("row_id",)):
    return _rows(df, key, _may(df, "instruction"), _may(df, "response"))


def qa_numina_math(df, key=("row_id",)):
    return _rows(df, key, _may(df, "problem"), _may(df, "solution"))


def qa_o1_journey(df, key=("row_id",)):
    chain = strip(before(_may(df, "longCOT"), CHAIN_MARKER))
    return _rows(df, key, _may(df, "question"), joined_answer(chain, _may(df, "answer")))


def qa_process_bench(df, key=("row_id",)):
    good = df.filter(is_correct_process())
    steps = F.filter(F.transform(F.col("steps"), canonical), lambda s: s != "")
    return _rows(
        good, key, _may(df, "problem"), F.coalesce(F.array_join(steps, "\n"), F.lit(""))
    )


def qa_uhgeval(df, key=("row_id",)):
    head = F.concat_ws("\n", *[_may(df, c) for c in ("headLine", "broadcastDate", "newsBeginning")])
    return _rows(df, key, strip(head), _may(df, "newsRemainder"))


#: subset name -> builder
QA_BUILDERS: dict[str, Callable[..., DataFrame]] = {
    "cnn_daily_mail": qa_cnn_daily_mail,
    "gsm8k_reasoning": qa_gsm8k_reasoning,
    "hk_o1aw": qa_hk_o1aw,
    "kaist_cot": qa_kaist_cot,
    "lima": qa_lima,
    "magpie_reasoning": qa_magpie_reasoning,
    "numina_math": qa_numina_math,
    "o1_journey": qa_o1_journey,
    "process_bench": qa_process_bench,
    "uhgeval": qa_uhgeval,
}
