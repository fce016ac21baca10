"""Every data recipe in use, as parameters of ``operators.mixing.mix``."""

from __future__ import annotations

from quillweave.functions.fixed import MASK_KINDS, TIERS
from quillweave.operators.mixing import (
    ADAPTIVE,
    WITH,
    WITHOUT,
    Recipe,
    as_many_as,
    is_long_pair,
    is_long_query,
    keep_first,
    length_class_pool,
    long_and_short,
    proportional,
)


def weighted(high: int, mid: int, low: int, total: int = 50_000, pools=TIERS) -> Recipe:
    """Tiers in proportion to weights, drawn with replacement."""
    return Recipe(
        proportional({"high": high, "mid": mid, "low": low}, total), pools, WITH, total
    )


def keep_high(total: int = 50_000, pools=TIERS) -> Recipe:
    return Recipe(keep_first(total), pools, WITHOUT, total)


def long_only(total: int = 50_000, pools=TIERS, limit: int = 2000) -> Recipe:
    return Recipe(as_many_as(total), pools, WITH, total, keep=lambda: is_long_pair(limit=limit))


def long_short(
    long_rows: int = 2000, high: int = 1000, mid: int = 500, low: int = 500, pools=TIERS, limit: int = 6000
) -> Recipe:
    return Recipe(
        long_and_short(long_rows, high, mid, low),
        pools,
        WITHOUT,
        pool=lambda tier: length_class_pool(tier, is_long_query(limit=limit)),
    )


def two_kinds(poisson: int, semantic: int, pools=MASK_KINDS) -> Recipe:
    return Recipe({"poisson": poisson, "semantic": semantic}, pools, WITH, poisson + semantic)


def without_high(total: int = 50_000, pools=TIERS) -> Recipe:
    half = total // 2
    return Recipe({"mid": half, "low": total - half}, pools, WITHOUT, total)


def quotas(pools, **amounts: int) -> Recipe:
    """Stated amounts per pool, without replacement while the pool is large enough."""
    return Recipe(dict(amounts), pools, ADAPTIVE, sum(amounts.values()))


# fixed values: which subsets the reinforcement sets take
FOUR_TIERS = {
    "verifiable": ("gsm8k_reasoning", "o1_journey", "o1_journey", "o1_journey"),
    "high": ("hk_o1aw", "lima", "process_bench", "uhgeval"),
    "mid": ("cnn_daily_mail", "magpie_reasoning"),
    "low": ("kaist_cot", "numina_math"),
}
THREE_TIERS = {
    "high": ("gsm8k_reasoning", "o1_journey"),
    "mid": ("magpie_reasoning",),
    "low": ("kaist_cot",),
}

#: recipe name -> recipe
RECIPES: dict[str, Recipe] = {
    "keep_high": keep_high(),
    "high_only": weighted(1, 0, 0),
    "mid_only": weighted(0, 1, 0),
    "low_only": weighted(0, 0, 1),
    "weights_3_1_2": weighted(3, 1, 2),
    "weights_3_2_1": weighted(3, 2, 1),
    "weights_4_1_3": weighted(4, 1, 3),
    "weights_1_1_1": weighted(1, 1, 1),
    "natural_high_50k": weighted(23_294, 13_353, 13_353),
    "natural_high_100k": weighted(23_294, 38_353, 38_353, total=100_000),
    "kinds_1_1": two_kinds(25_000, 25_000),
    "kinds_1_0": two_kinds(50_000, 0),
    "kinds_0_1": two_kinds(0, 50_000),
    "long_only": long_only(),
    "long_short": long_short(),
    "without_high": without_high(),
    "rl_weights": weighted(3_000, 1_000, 1_000, total=5_000),
    "rl_verifiable_1": quotas(FOUR_TIERS, verifiable=1_000, high=2_000, mid=1_000, low=1_000),
    "rl_verifiable_2": quotas(FOUR_TIERS, verifiable=2_000, high=2_000, mid=500, low=500),
    "rl_2000": quotas(THREE_TIERS, high=1_000, mid=500, low=500),
    "rl_1000": quotas(THREE_TIERS, high=600, mid=200, low=200),
}
