"""Text rules shared by every corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillweave.functions.fixed import ANSWER_JOIN, PYTHON_SPACE
from quillweave.functions.hashing import choose


def strip(c: Column) -> Column:
    """Trim all Unicode white space at both ends (Spark's ``trim`` only drops blanks)."""
    return F.btrim(c, F.lit(PYTHON_SPACE))


def canonical(c: Column) -> Column:
    """Text form of a value: null becomes empty, the rest is trimmed."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def optional(df: DataFrame, name: str) -> Column:
    """Column ``name``, or null where the table does not have it."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def before(c: Column, marker: str) -> Column:
    """Part of ``c`` before the first ``marker`` (all of it when there is none)."""
    return F.substring_index(c, marker, 1)


def joined_answer(first: Column, last: Column) -> Column:
    """``first`` and ``last`` around the answer heading; one alone if the other is empty."""
    both = (first != "") & (last != "")
    return F.when(both, F.concat(first, F.lit(ANSWER_JOIN), last)).otherwise(F.concat(first, last))


def fill(template: str, *values: Column) -> Column:
    """Put values into the ``{}`` places of a template."""
    pieces = template.split("{}")
    if len(pieces) != len(values) + 1:
        raise ValueError(f"template has {len(pieces) - 1} places, got {len(values)} values")
    out = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        out += [value, F.lit(piece)]
    return F.concat(*out)


def fill_choice(templates: tuple[str, ...], values: list[Column], *parts) -> Column:
    """One of the templates, uniformly, filled in.

    The choice is among the short literal pieces, so only the chosen text is ever built.
    """
    pieces = [t.split("{}") for t in templates]
    if any(len(p) != len(values) + 1 for p in pieces):
        raise ValueError(f"every template needs {len(values)} places")
    chosen = choose([F.array(*[F.lit(x) for x in p]) for p in pieces], *parts)
    out = [F.get(chosen, F.lit(0))]
    for place, value in enumerate(values, start=1):
        out += [value, F.get(chosen, F.lit(place))]
    return F.concat(*out)
