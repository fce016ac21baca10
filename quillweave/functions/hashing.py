"""Seeded choices as pure functions of (seed, salt, row key).

A random number that depends only on the row key gives the same result for any number
of partitions, any file order and any re-run of a lost task, which a stateful generator
cannot.  All helpers are built-in expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillweave.functions.binding import let

HASH_BITS = 60
HASH_SPAN = float(1 << HASH_BITS)


def _as_text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def hash60(*parts) -> Column:
    """60-bit non-negative integer from the md5 of the parts joined by ``:``."""
    digest = F.md5(F.concat_ws(":", *[_as_text(p) for p in parts]))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def unit(*parts) -> Column:
    """Number in [0, 1)."""
    return hash60(*parts).cast("double") / F.lit(HASH_SPAN)


def below(n, *parts) -> Column:
    """Integer in ``0 .. n-1``; ``n`` is a number or a column."""
    return hash60(*parts) % (n if isinstance(n, Column) else F.lit(n))


def flag(p: float, *parts) -> Column:
    """True with probability ``p``."""
    return unit(*parts) < F.lit(float(p))


def choose(options: Sequence, *parts) -> Column:
    """One of ``options`` (texts or columns), uniformly."""
    values = F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options])
    return F.element_at(values, (below(len(options), *parts) + 1).cast("int"))


def choose_lazily(options: Sequence[Column], *parts) -> Column:
    """As ``choose``, for options that cost something: only the chosen one is computed."""

    def pick(i: Column) -> Column:
        out = F.when(i == 0, options[0])
        for place, option in enumerate(options[1:], start=1):
            out = out.when(i == place, option)
        return out

    return let(below(len(options), *parts), pick)


def poisson_cdf(lam: float) -> list[float]:
    """CDF values up to the point where a double cannot tell them from one."""
    if lam <= 0:
        return []
    out: list[float] = []
    k, total = 0, 0.0
    while k < lam or 1.0 - total > 1e-15:
        total += math.exp(k * math.log(lam) - lam - math.lgamma(k + 1))
        if out and total <= out[-1]:
            break
        out.append(total)
        k += 1
    return out


def poisson(lam: float, *parts) -> Column:
    """Poisson count by inverting the CDF at ``unit(parts)``."""
    steps = poisson_cdf(lam)
    if not steps:
        return F.lit(0)
    u = unit(*parts)  # one common subexpression of the generated code
    out = F.when(u < steps[0], 0)
    for k, c in enumerate(steps[1:], start=1):
        out = out.when(u < c, k)
    return out.otherwise(len(steps))
