"""Binding a value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use in ``body``; a lambda would else evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_sql(value: Column, body: str) -> Column:
    """As ``let`` with a lambda in SQL text, which is parsed at once; large bodies are built far faster so."""
    return F.get(F.call_function("transform", F.array(value), F.expr(body)), F.lit(0))
