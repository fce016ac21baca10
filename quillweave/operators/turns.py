"""Conversations as one row each, from tables with one turn per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conversation_rows(turns: DataFrame, conv: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """``conv`` and ``conversations``, all texts in order; equal or null numbers are ordered by text.

    A conversation is one output row, so it has to fit a row (2 GB); one that does not fails
    the job.  No turn is left out.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return turns.groupBy(conv).agg(F.transform(ordered, lambda x: x["t"]).alias("conversations"))
