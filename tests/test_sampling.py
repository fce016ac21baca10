import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillweave.operators import sampling
from tests.test_hashing import python_hash


def keys(spark, n=500, parts=4):
    return spark.range(0, n, 1, parts).select(F.col("id").alias("k"), F.concat(F.lit("p"), F.col("id") % 3).alias("pool"))


def order(ids, seed, salt):
    return sorted(ids, key=lambda i: (python_hash(seed, salt, i), i))


def test_rank_is_the_hash_order(spark):
    got = {r["k"]: r["rank"] for r in sampling.hash_rank(keys(spark), ["k"], seed=5).collect()}
    assert got == {k: i for i, k in enumerate(order(range(500), 5, "order"))}


def test_rank_per_group_with_a_hot_and_a_null_group(spark):
    group = F.when(F.col("k") % 50 == 0, None).when(F.col("k") % 10 == 1, "small").otherwise("hot")
    df = keys(spark).select("k", group.alias("g"))
    rows = sampling.hash_rank(df, ["k"], by=["g"], seed=1, bits=4).collect()
    by_group = {}
    for r in rows:
        by_group.setdefault(r["g"], {})[r["rank"]] = r["k"]
    assert len(rows) == 500 and set(by_group) == {None, "small", "hot"}
    for ranks in by_group.values():
        assert [ranks[i] for i in range(len(ranks))] == order(ranks.values(), 1, "order")


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_first_k_descends_digit_by_digit(spark, monkeypatch, bits):
    monkeypatch.setattr(sampling, "SMALL_BUCKET", 4)
    df = keys(spark)
    want = {"p0": 1, "p1": 83, "p2": 0}
    counts = sampling.histogram(df, ["k"], F.col("pool"), seed=9, bits=bits)
    assert counts.sizes == {"p0": 167, "p1": 167, "p2": 166}
    got = df.filter(sampling.first_k(df, F.col("pool"), counts, want)).collect()
    for pool, k in want.items():
        members = [i for i in range(500) if f"p{i % 3}" == pool]
        assert {r["k"] for r in got if r["pool"] == pool} == set(order(members, 9, "order")[:k])


def test_first_k_of_everything_and_of_too_much(spark):
    df = keys(spark, 30)
    assert sampling.head_n(df, ["k"], 30).count() == 30
    assert sampling.head_n(df, ["k"], 0).count() == 0
    with pytest.raises(sampling.SampleTooLarge):
        sampling.head_n(df, ["k"], 31)


def test_composite_and_text_keys(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("a"), F.concat(F.lit("t"), F.col("id")).alias("b"))
    taken = sampling.head_n(df, ["a", "b"], 70, seed=2).collect()
    wanted = sorted(((i % 2, f"t{i}") for i in range(200)), key=lambda t: (python_hash(2, "order", *t), t))[:70]
    assert {tuple(r) for r in taken} == set(wanted)


def test_equal_hashes_are_split_by_key(spark, monkeypatch):
    monkeypatch.setattr(sampling, "hash60", lambda *parts: F.lit(7).cast("bigint"))
    monkeypatch.setattr(sampling, "SMALL_BUCKET", 4)
    df = keys(spark, 60)
    assert sorted(r["k"] for r in sampling.head_n(df, ["k"], 25).collect()) == list(range(25))


@pytest.mark.parametrize("parts,shuffles", [(1, 2), (9, 13)])
def test_samples_do_not_depend_on_partitions(spark, parts, shuffles):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffles))
    try:
        df = keys(spark, 400, parts).orderBy(F.rand(parts))
        head = {r["k"] for r in sampling.head_n(df, ["k"], 100, seed=3).collect()}
        drawn = sorted((r["draw"], r["k"]) for r in sampling.sample_with_replacement(df, ["k"], 900, seed=3).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ranked = order(range(400), 3, "pool")
    assert head == set(order(range(400), 3, "order")[:100])
    assert drawn == [(i, ranked[python_hash(3, "draw", "all", i) % 400]) for i in range(900)]


def test_draws_from_one_row_and_from_none(spark):
    one = keys(spark, 1)
    assert sampling.sample_with_replacement(one, ["k"], 5000).count() == 5000
    with pytest.raises(sampling.SampleTooLarge):
        sampling.sample_with_replacement(keys(spark, 0), ["k"], 1)


def test_draws_without_broadcast_are_the_same(spark, monkeypatch):
    df = keys(spark, 300)
    small = sorted(map(tuple, sampling.sample_with_replacement(df, ["k"], 700, seed=1).collect()))
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", 10)
    large = sorted(map(tuple, sampling.sample_with_replacement(df, ["k"], 700, seed=1).collect()))
    assert small == large


def test_draws_by_text_key(spark, plan_of, tmp_path):
    df = keys(spark, 300).select(F.concat(F.lit("key-"), F.col("k")).alias("k"), F.repeat(F.lit("x"), 50).alias("t"))
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    drawn = sampling.sample_with_replacement(stored, ["k"], 700, seed=1)
    rows = drawn.collect()
    ranked = sorted((f"key-{i}" for i in range(300)), key=lambda k: (python_hash(1, "pool", k), k))
    assert sorted((r["draw"], r["k"]) for r in rows) == [(i, ranked[python_hash(1, "draw", "all", i) % 300]) for i in range(700)]
    assert "LeftSemi, BuildRight" in plan_of(drawn)


def test_rank_within_groups_of_any_type(spark):
    day = F.to_date(F.when(F.col("k") % 3 > 0, F.concat(F.lit("2024-01-0"), F.col("k") % 3)))
    df = keys(spark, 90).select("k", day.alias("d"), (F.col("k") % 2 == 0).alias("b"))
    rows = sampling.hash_rank(df, ["k"], by=["d", "b"]).collect()
    groups = Counter((r["d"], r["b"]) for r in rows)
    assert len(rows) == 90 and len(groups) == 6
    assert all(sorted(r["rank"] for r in rows if (r["d"], r["b"]) == g) == list(range(n)) for g, n in groups.items())


def test_draws_are_uniform(spark):
    drawn = sampling.sample_with_replacement(keys(spark, 20), ["k"], 8000, seed=6).collect()
    counts = Counter(r["k"] for r in drawn)
    assert sum((counts[i] - 400) ** 2 / 400 for i in range(20)) < 43.8  # 0.1% point, 19 degrees


def test_adaptive(spark):
    df = keys(spark, 50)
    small = [r["k"] for r in sampling.sample_adaptive(df, ["k"], 50).collect()]
    large = [r["k"] for r in sampling.sample_adaptive(df, ["k"], 51).collect()]
    assert sorted(small) == list(range(50))
    assert len(large) == 51 and max(Counter(large).values()) > 1


def test_split_is_a_partition_with_ceiled_share(spark):
    df = keys(spark, 304)
    rows = sampling.split_by_share(df, ["k"], pool=F.col("pool")).collect()
    assert sorted(r["k"] for r in rows) == list(range(304))
    tests = Counter(r["pool"] for r in rows if r["split"] == "test")
    assert tests == {"p0": 11, "p1": 11, "p2": 11}  # pools of 102, 101 and 101 rows


def test_split_and_sample_move_no_rows(spark, plan_of):
    df = keys(spark)
    # the cuts, one row per pool, come to the rows; only counts and cut cells are exchanged
    plan = plan_of(sampling.split_by_share(df, ["k"], pool=F.col("pool")))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("BroadcastExchange")[0]
    assert "Exchange" not in plan_of(sampling.head_n(df, ["k"], 20))


def test_dense_position_orders_equal_numbers_by_text(spark):
    texts = [f"t{i:03}" for i in range(60)]
    rows = [(1, None if i < 20 else 7, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows[::-1], "g bigint, t bigint, text string")
    for parts in (1, 5):
        got = {r["text"]: r["pos"] for r in sampling.dense_position(df.repartition(parts), ["g"], "t", ties=["text"]).collect()}
        assert [got[t] for t in texts] == list(range(60))


def test_dense_position_of_a_long_group(spark):
    rng = random.Random(0)
    data = [("hot", t) for t in rng.sample(range(0, 20000), 3000)] + [("b", 3), ("b", 1), ("c", -5000)]
    df = spark.createDataFrame(data, "g string, t bigint")
    got = {(r["g"], r["t"]): r["pos"] for r in sampling.dense_position(df, ["g"], "t", span=64).collect()}
    wanted = {("hot", t): i for i, t in enumerate(sorted(t for g, t in data if g == "hot"))}
    wanted |= {("b", 1): 0, ("b", 3): 1, ("c", -5000): 0}
    assert got == wanted


def test_content_keys_number_copies(spark):
    data = [("x", "a")] * 25 + [("y", "b")] * 3 + [("x", "b")]
    df = spark.createDataFrame(data, "t string, u string")
    for chunk in (4, 100):
        rows = sampling.with_content_key(df, chunk=chunk).collect()
        assert len({(r["digest"], r["occurrence"]) for r in rows}) == 29
        got = {}
        for r in rows:
            got.setdefault((r["t"], r["u"]), []).append(r["occurrence"])
        assert {k: sorted(v) for k, v in got.items()} == {
            ("x", "a"): list(range(25)), ("y", "b"): [0, 1, 2], ("x", "b"): [0]
        }


def test_many_pools_and_a_null_one(spark):
    df = spark.range(12_000).select(F.col("id").alias("k"), F.when(F.col("id") % 4 > 0, F.col("id") % 3001).alias("pool"))
    rows = sampling.split_by_share(df, ["k"], pool=F.col("pool")).collect()
    sizes, tests = Counter(r["pool"] for r in rows), Counter(r["pool"] for r in rows if r["split"] == "test")
    assert len(rows) == 12_000 and len(sizes) > 3000
    assert all(tests[p] == -(-n // 10) for p, n in sizes.items()) and tests[None] == 300


def test_null_keys_are_drawn(spark):
    df = spark.createDataFrame([(k, f"t{k}") for k in [None, *range(50)]], "k bigint, t string")
    assert sampling.sample_adaptive(df, ["k"], 51).count() == 51
    assert sampling.sample_with_replacement(df, ["k"], 5100).count() == 5100
    assert sampling.sample_per_pool(df, ["k"], F.lit(None).cast("string"), lambda n: n).count() == 51


def test_content_keys_see_microseconds_and_nested_nulls(spark):
    df = spark.sql(
        "select timestamp'2024-01-01 00:00:00.000001' as t, named_struct('a', 1, 'b', cast(null as int)) as s union all "
        "select timestamp'2024-01-01 00:00:00.000002', named_struct('a', 1, 'b', cast(null as int)) union all "
        "select timestamp'2024-01-01 00:00:00.000001', named_struct('a', cast(null as int), 'b', 1)"
    )
    rows = sampling.with_content_key(df).collect()
    assert len({r["digest"] for r in rows}) == 3 and len({(r["t"], r["s"]) for r in rows}) == 3


def test_repeat(spark):
    rows = sampling.repeat(keys(spark, 4), F.when(F.col("k") == 2, 3).otherwise(1)).collect()
    assert sorted((r["k"], r["copy"]) for r in rows) == [(0, 1), (1, 1), (2, 1), (2, 2), (2, 3), (3, 1)]


def test_bloom_filter_passes_every_key_and_few_others(spark):
    keys = spark.range(20_000).select((F.col("id") * 7).alias("a"), F.when(F.col("id") % 50 > 0, F.concat(F.lit("k"), "id")).alias("b"))
    others = spark.range(200_000).select((-F.col("id") - 1).alias("a"), F.lit("x").alias("b"))
    table, near = sampling.bloom_filter(keys, ["a", "b"], 20_000)
    assert table.count() <= 5000
    assert near(keys).count() == 20_000
    assert near(others).count() < 0.05 * 200_000


def test_many_draws_thin_the_corpus_before_any_exchange(spark, monkeypatch, plan_of):
    """Beyond the broadcast bound the filter comes first; the plan exchanges what it lets pass."""
    df = spark.range(5000).withColumn("text", F.concat(F.lit("t"), "id")).repartition(3)
    want = sorted(map(tuple, sampling.sample_with_replacement(df, ["id"], 900, seed=4).collect()))
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", 0)
    got = sampling.sample_with_replacement(df, ["id"], 900, seed=4)
    assert sorted(map(tuple, got.collect())) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(sampling.sample_with_replacement(df, ["id"], 900, seed=4))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftSemi, BuildRight" in plan and plan.index("LeftSemi") > plan.index("SortMergeJoin")  # below the join, above the table
    monkeypatch.setattr(sampling, "BLOOM_LEAST_BITS", 1 << 40)  # more draws than a filter can hold
    assert sorted(map(tuple, sampling.sample_with_replacement(df, ["id"], 900, seed=4).collect())) == want


def test_a_row_drawn_very_often_is_no_hot_key(spark, monkeypatch):
    """Three rows, 5,000 draws: the draws of a row are dealt to shares; the rows are the same."""
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, text string")
    want = sorted(map(tuple, sampling.sample_with_replacement(df, ["id"], 5000, seed=2).collect()), key=repr)
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(sampling, "HOT_DRAWS", 100)
    got = sampling.sample_with_replacement(df, ["id"], 5000, seed=2)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert len(want) == 5000
