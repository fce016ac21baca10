"""Output gate: fixed columns, every pair checked, bad rows set aside or refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillweave.functions.grammar import DEFAULT as DEFAULT_GRAMMAR
from quillweave.functions.grammar import TagGrammar

PAIR_COLUMNS = ("query", "response")


def pinned(df: DataFrame) -> DataFrame:
    """Same table, but later filters run on its computed columns, not below them.

    The optimizer pushes a filter through a projection by copying the expressions it uses,
    so ``filter(is_valid)`` would mask and parse every row once more per reference.  A
    filter is not pushed through a generator of its columns, and a one-row generator costs
    next to nothing.  Put cheap filters on source columns before it.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def check_columns(df: DataFrame, expected) -> None:
    """The table must have exactly the ``expected`` columns, in any order."""
    if set(df.columns) != set(expected) or len(df.columns) != len(set(expected)):
        raise ValueError(f"columns should be {sorted(expected)}, got {sorted(df.columns)}")


def with_validity(
    df: DataFrame,
    grammar: TagGrammar = DEFAULT_GRAMMAR,
    query: str = "query",
    response: str = "response",
    out: str = "is_valid",
) -> DataFrame:
    return df.withColumn(out, grammar.is_valid_pair(F.col(query), F.col(response)))


def split_valid(df: DataFrame, grammar: TagGrammar = DEFAULT_GRAMMAR, **names):
    """``(good, quarantine)``.  Both are filters on one map-only plan."""
    checked = pinned(with_validity(df, grammar, **names))
    flag_name = names.get("out", "is_valid")
    return (
        checked.filter(F.col(flag_name)).drop(flag_name),
        checked.filter(~F.col(flag_name)).drop(flag_name),
    )


def require_valid(df: DataFrame, grammar: TagGrammar = DEFAULT_GRAMMAR, query="query", response="response"):
    """Same rows, but the job fails on the first bad pair; costs no extra pass."""
    checked = pinned(with_validity(df, grammar, query, response))
    refuse = F.raise_error(F.lit("bad masked pair")).cast("boolean")
    return checked.filter(F.when(F.col("is_valid"), True).otherwise(refuse)).drop("is_valid")
