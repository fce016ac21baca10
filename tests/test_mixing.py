from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillweave.functions.fixed import TIERS
from quillweave.operators import mixing
from quillweave.operators.sampling import SampleTooLarge
from quillweave.plans import jobs, recipes


@pytest.fixture(scope="module")
def corpus(spark):
    """Ten subsets; row k of the corpus has a query of 10 + (k % 40) * 200 characters."""
    names = [s for subsets in TIERS.values() for s in subsets]
    sizes = dict(zip(names, [40, 30, 20, 10, 10, 10, 300, 60, 400, 120]))
    data, k = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            data.append((k, name, "q" * (10 + (k % 40) * 200), f"r{k}"))
            k += 1
    return spark.createDataFrame(data, "row_id bigint, subset string, query string, response string").cache()


def by_pool(df):
    return Counter(r["pool"] for r in df.select("pool").collect())


# ---- amounts ------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "weights,wanted",
    [
        ((3, 1, 2), (25_000, 8_333, 16_667)),
        ((1, 1, 1), (16_666, 16_666, 16_668)),
        ((1, 0, 0), (50_000, 0, 0)),
        ((0, 0, 1), (0, 0, 50_000)),
        ((23_294, 13_353, 13_353), (23_294, 13_353, 13_353)),
    ],
)
def test_proportional(weights, wanted):
    got = mixing.proportional(dict(zip(("high", "mid", "low"), weights)), 50_000)
    assert tuple(got.values()) == wanted


def test_keep_first_amounts():
    amounts = mixing.keep_first(100)
    assert amounts({"high": 30, "mid": 90, "low": 90}) == {"high": 30, "mid": 42, "low": 28}
    assert amounts({"high": 100}) == {"high": 100}
    assert amounts({"high": 130}) == {"high": 100}


def test_long_and_short_amounts():
    amounts = mixing.long_and_short(20, 10, 5, 5)
    sizes = {"long_high": 7, "long_rest": 9, "short_high": 50, "short_mid": 3}
    assert amounts(sizes) == {"long_high": 7, "long_rest": 9, "short_high": 10, "short_mid": 3, "short_low": 0}
    assert amounts({"long_high": 99})["long_rest"] == 0


def test_every_recipe_states_its_size():
    for name, recipe in recipes.RECIPES.items():
        if not callable(recipe.amounts):
            assert sum(recipe.amounts.values()) == recipe.total, name


# ---- mixtures ---------------------------------------------------------------------------------
def test_weighted_mixture(corpus):
    mixed = mixing.mix(corpus, recipes.weighted(3, 1, 2, 600)).cache()
    assert by_pool(mixed) == {"high": 300, "mid": 100, "low": 200}
    rows = mixed.collect()
    assert sorted(r["pos"] for r in rows) == list(range(600))
    assert all(r["subset"] in TIERS[r["pool"]] for r in rows)
    assert all(r["response"] == f"r{r['row_id']}" for r in rows)
    assert sorted(r["draw"] for r in rows if r["pool"] == "mid") == list(range(100))


def test_zero_weight_needs_no_rows(corpus):
    only_high = corpus.filter(F.col("subset").isin(*TIERS["high"]))
    assert by_pool(mixing.mix(only_high, recipes.weighted(1, 0, 0, 50))) == {"high": 50}
    with pytest.raises(SampleTooLarge):
        mixing.mix(only_high, recipes.weighted(1, 1, 0, 50))


def test_keep_high(corpus):
    mixed = mixing.mix(corpus, recipes.keep_high(200))
    assert by_pool(mixed) == {"high": 120, "mid": 48, "low": 32}
    assert len({r["row_id"] for r in mixed.collect()}) == 200
    assert by_pool(mixing.mix(corpus, recipes.keep_high(100))) == {"high": 100}
    with pytest.raises(SampleTooLarge):
        mixing.mix(corpus, recipes.keep_high(2000))


def test_long_only(corpus):
    rows = mixing.mix(corpus, recipes.long_only(500)).collect()
    assert len(rows) == 500
    assert all(len(r["query"]) + len(r["response"]) > 2000 for r in rows)
    long_high = corpus.filter(mixing.is_long_pair() & F.col("subset").isin(*TIERS["high"])).count()
    counts = Counter(r["pool"] for r in rows)
    assert counts == {"high": long_high, "mid": (500 - long_high) // 2, "low": 500 - long_high - (500 - long_high) // 2}
    with pytest.raises(ValueError):
        mixing.mix(corpus, recipes.long_only(10))


def test_long_short(corpus):
    rows = mixing.mix(corpus, recipes.long_short(60, 20, 10, 10)).collect()
    assert len({r["row_id"] for r in rows}) == len(rows)
    assert all((len(r["query"]) > 6000) == r["pool"].startswith("long") for r in rows)
    counts = Counter(r["pool"] for r in rows)
    assert counts["long_high"] + counts["long_rest"] == 60
    assert (counts["short_high"], counts["short_mid"], counts["short_low"]) == (20, 10, 10)


def test_two_kinds_and_without_high(corpus):
    assert by_pool(mixing.mix(corpus, recipes.two_kinds(0, 90))) == {"semantic": 90}
    assert by_pool(mixing.mix(corpus, recipes.two_kinds(45, 45))) == {"poisson": 45, "semantic": 45}
    assert by_pool(mixing.mix(corpus, recipes.without_high(101))) == {"mid": 50, "low": 51}


def test_adaptive_quotas_with_a_repeated_subset(corpus):
    recipe = recipes.quotas(recipes.FOUR_TIERS, verifiable=70, high=100, mid=10, low=10)
    rows = mixing.mix(corpus, recipe).collect()
    # 40 + 3 * 10 listed rows fit exactly, so every copy comes once
    verifiable = Counter(r["row_id"] for r in rows if r["pool"] == "verifiable")
    assert sorted(Counter(verifiable.values()).items()) == [(1, 40), (3, 10)]
    assert len([r for r in rows if r["pool"] == "high"]) == 100  # only 80 there: drawn with replacement


def test_mixture_does_not_depend_on_partitions(corpus):
    recipe = recipes.weighted(1, 1, 1, 99)

    def rows(df):
        return sorted((r["pos"], r["row_id"], r["pool"]) for r in mixing.mix(df, recipe).collect())

    assert rows(corpus.repartition(11)) == rows(corpus.coalesce(1))


def test_size_check(corpus):
    with pytest.raises(ValueError, match="expected"):
        mixing.mix(corpus, mixing.Recipe({"high": 5}, total=6))


def test_only_keys_are_ranked(spark, corpus, plan_of, tmp_path):
    corpus.write.parquet(str(tmp_path / "c"))
    plan = plan_of(mixing.mix(spark.read.parquet(str(tmp_path / "c")), recipes.weighted(1, 1, 1, 30)))
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2
    assert sum("query:string" in s for s in scans) == 1  # the payload scan, joined by broadcast
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


# ---- jobs --------------------------------------------------------------------------------------------
def test_chat_set(corpus):
    rows = jobs.chat_set(corpus, recipes.weighted(1, 1, 1, 100)).collect()
    assert Counter(r["split"] for r in rows) == {"train": 98, "eval": 2}
    assert all(r["text"].startswith("<|im_start|>user\nq") for r in rows)


def test_first_rows_set(corpus):
    rows = jobs.first_rows_set(corpus, 50).collect()
    assert Counter(r["split"] for r in rows) == {"train": 49, "eval": 1}
    assert sorted(r["pos"] for r in rows) == list(range(50))
