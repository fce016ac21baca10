"""Mixtures: rows of several pools in stated amounts, in one seeded order.

A ``Recipe`` says which pool a row belongs to and how many rows each pool gives; the
amounts may depend on the pool sizes (a few dozen counts).  ``mix`` does the rest:

    key columns -> pool -> draws -> order -> fetch the drawn rows

Only keys are ranked and joined; text is read once, for the rows that were drawn.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillweave.functions import fixed
from quillweave.operators.sampling import (
    Histogram,
    SampleTooLarge,
    attach,
    draw_keys,
    draw_table,
    hash_rank,
    histogram,
    small_enough,
)

Sizes = Mapping[str, int]
Quotas = dict[str, int]

WITH, WITHOUT, ADAPTIVE = "with", "without", "adaptive"


# ---- pools ---------------------------------------------------------------------------
def pool_of(subset: Column, pools: Mapping[str, Sequence[str]]) -> Column:
    """Name of the pool that lists the subset, null for none."""
    out = None
    for name, subsets in pools.items():
        here = subset.isin(sorted(set(subsets)))
        out = F.when(here, name) if out is None else out.when(here, name)
    return F.lit(None).cast("string") if out is None else out


def copies_of(subset: Column, pools: Mapping[str, Sequence[str]]) -> Column | None:
    """How often a subset is listed, or null where no subset is listed twice."""
    times = {s: list(subsets).count(s) for subsets in pools.values() for s in subsets}
    repeated = {s: n for s, n in times.items() if n > 1}
    if not repeated:
        return None
    out = None
    for name, n in repeated.items():
        out = F.when(subset == name, n) if out is None else out.when(subset == name, n)
    return out.otherwise(1)


def is_long_pair(query="query", response="response", limit: int = 2000) -> Column:
    return F.char_length(query) + F.char_length(response) > limit


def is_long_query(query="query", limit: int = 6000) -> Column:
    return F.char_length(query) > limit


# ---- amounts -------------------------------------------------------------------------
def proportional(weights: Mapping[str, int], total: int) -> Quotas:
    """``total * w // sum(w)`` each; the last pool takes the rest."""
    whole = sum(weights.values())
    *firsts, last = weights
    out = {n: total * weights[n] // whole for n in firsts}
    out[last] = total - sum(out.values())
    return out


def keep_first(total: int, share: float = 0.6, first="high", second="mid", rest="low"):
    """All of ``first``; ``share`` of what is missing from ``second``, the rest from ``rest``.
    A ``first`` pool of ``total`` or more rows is cut to ``total``."""

    def amounts(sizes: Sizes) -> Quotas:
        missing = total - sizes.get(first, 0)
        if missing <= 0:
            return {first: total}
        of_second = int(missing * share)
        return {first: sizes.get(first, 0), second: of_second, rest: missing - of_second}

    return amounts


def as_many_as(total: int, first="high", second="mid", rest="low"):
    """``first`` gives as many rows as it has; the two others share the rest in halves."""

    def amounts(sizes: Sizes) -> Quotas:
        n = sizes.get(first, 0)
        half = (total - n) // 2
        return {first: n, second: half, rest: total - n - half}

    return amounts


def long_and_short(long_rows: int, short_high: int, short_mid: int, short_low: int):
    """Long rows from the high tier first, then from the others; short rows per tier;
    never more than a pool holds."""

    def amounts(sizes: Sizes) -> Quotas:
        of_high = min(long_rows, sizes.get("long_high", 0))
        return {
            "long_high": of_high,
            "long_rest": min(long_rows - of_high, sizes.get("long_rest", 0)),
            "short_high": min(short_high, sizes.get("short_high", 0)),
            "short_mid": min(short_mid, sizes.get("short_mid", 0)),
            "short_low": min(short_low, sizes.get("short_low", 0)),
        }

    return amounts


def length_class_pool(tier: Column, is_long: Column) -> Column:
    """Pool names for ``long_and_short`` from the tier and the length class, in one pass."""
    long_pool = F.when(tier == "high", "long_high").otherwise("long_rest")
    return F.when(tier.isNotNull(), F.when(is_long, long_pool).otherwise(F.concat(F.lit("short_"), tier)))


# ---- recipes -------------------------------------------------------------------------
@dataclass(frozen=True)
class Recipe:
    """What goes into a mixture.

    pools      pool name -> subsets; a subset listed n times counts n times
    amounts    rows per pool, fixed or from the pool sizes
    replace    "with", "without" or "adaptive" (without while the pool is large enough)
    total      size the mixture must have, if it is known beforehand
    keep       extra condition on a row
    pool       pool column built from the tier column, where it is not the tier itself
    """

    amounts: Quotas | Callable[[Sizes], Quotas]
    pools: Mapping[str, Sequence[str]] = field(default_factory=lambda: fixed.TIERS)
    replace: str = WITH
    total: int | None = None
    keep: Callable[[], Column] | None = None
    pool: Callable[[Column], Column] | None = None
    salt_seed: int = 42


def keyed_pools(df: DataFrame, recipe: Recipe, key: Sequence[str], subset: str):
    """Key columns (and ``copy`` where subsets repeat) with their pool."""
    rows = df.filter(recipe.keep()) if recipe.keep else df
    tier = pool_of(F.col(subset), recipe.pools)
    pool = recipe.pool(tier) if recipe.pool else tier
    copies = copies_of(F.col(subset), recipe.pools)
    columns = [pool.alias("pool"), *key]
    if copies is not None:
        columns.append(F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    return rows.select(*columns).filter(F.col("pool").isNotNull())


@dataclass(frozen=True)
class Planned:
    """A recipe applied to a table: what will be drawn, before anything is drawn."""

    df: DataFrame
    key: tuple[str, ...]
    keys: DataFrame
    counts: Histogram
    quotas: Quotas
    replace: Mapping[str, bool]

    @property
    def rows(self) -> int:
        return sum(self.quotas.values())

    def draw(self) -> DataFrame:
        """Columns of the table plus ``pool``, ``draw`` and ``pos`` (0-based, in the mixture)."""
        spark, seed = self.df.sparkSession, self.counts.seed
        drawn = draw_keys(self.keys, self.counts, self.quotas, self.replace)
        # the order depends on the draw numbers only, so it is ranked before any row is fetched
        numbers = draw_table(spark, self.quotas, self.counts.sizes, self.replace, seed=seed)
        order = hash_rank(
            numbers.select("pool", "draw"), ["pool", "draw"], seed=seed, salt="mix", out="pos"
        )
        placed = drawn.join(small_enough(order, self.rows), ["pool", "draw"])
        return attach(self.df, placed, self.key, self.rows)


def plan(
    df: DataFrame,
    recipe: Recipe,
    key: Sequence[str] = ("row_id",),
    *,
    subset: str = "subset",
    seed: int | None = None,
) -> Planned:
    """Count the pools, work out the amounts and check them; one scan of the key columns."""
    seed = recipe.salt_seed if seed is None else seed
    keys = keyed_pools(df, recipe, key, subset)
    unique = [c for c in keys.columns if c != "pool"]
    counts = histogram(keys, unique, F.col("pool"), seed=seed, salt="pool")
    sizes = counts.sizes
    quotas = recipe.amounts(sizes) if callable(recipe.amounts) else dict(recipe.amounts)
    negative = [n for n, k in quotas.items() if k < 0]
    if negative:
        raise ValueError(f"negative amounts for {negative}: {quotas}")
    rows = sum(quotas.values())
    if recipe.total is not None and rows != recipe.total:
        raise ValueError(f"the mixture has {rows} rows, {recipe.total} expected")
    replace = {
        n: recipe.replace == WITH or (recipe.replace == ADAPTIVE and k > sizes.get(n, 0))
        for n, k in quotas.items()
    }
    for name, k in quotas.items():
        if not replace[name] and k > sizes.get(name, 0):
            raise SampleTooLarge(f"{name}: {k} rows wanted, {sizes.get(name, 0)} there")
    return Planned(df, tuple(key), keys, counts, quotas, replace)


def mix(
    df: DataFrame,
    recipe: Recipe,
    key: Sequence[str] = ("row_id",),
    *,
    subset: str = "subset",
    seed: int | None = None,
) -> DataFrame:
    """Columns of ``df`` plus ``pool``, ``draw`` and ``pos`` (0-based place in the mixture)."""
    return plan(df, recipe, key, subset=subset, seed=seed).draw()
