import hashlib
from collections import Counter

from pyspark.sql import functions as F

from quillweave.functions.hashing import below, choose, flag, hash60, poisson, poisson_cdf, unit


def python_hash(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def test_hash_is_the_md5_prefix(spark):
    rows = spark.range(50).select("id", hash60(7, "s", F.col("id")).alias("h")).collect()
    assert all(r["h"] == python_hash(7, "s", r["id"]) for r in rows)


def test_unit_and_below_stay_in_range(spark):
    row = (
        spark.range(5000)
        .select(unit(1, "u", F.col("id")).alias("u"), below(7, 1, "b", F.col("id")).alias("b"))
        .agg(F.min("u"), F.max("u"), F.avg("u"), F.min("b"), F.max("b"))
        .first()
    )
    assert 0 <= row[0] and row[1] < 1 and abs(row[2] - 0.5) < 0.02
    assert (row[3], row[4]) == (0, 6)


def test_choice_is_uniform(spark):
    options = ["a", "b", "c", "d"]
    drawn = spark.range(8000).select(choose(options, 3, "c", F.col("id")).alias("x")).groupBy("x").count().collect()
    counts = {r["x"]: r["count"] for r in drawn}
    chi = sum((counts[o] - 2000) ** 2 / 2000 for o in options)
    assert set(counts) == set(options) and chi < 16.3  # 0.1% point, 3 degrees


def test_flag_probability(spark):
    n = spark.range(8000).filter(flag(0.5, 0, "f", F.col("id"))).count()
    assert abs(n - 4000) < 200


def test_poisson_matches_its_law(spark):
    rows = spark.range(20000).select(poisson(4, 0, "p", F.col("id")).alias("k")).collect()
    ks = [r["k"] for r in rows]
    mean = sum(ks) / len(ks)
    variance = sum((k - mean) ** 2 for k in ks) / len(ks)
    assert abs(mean - 4) < 0.06 and abs(variance - 4) < 0.2
    cdf = poisson_cdf(4)
    share = Counter(ks)
    assert abs(share[0] / len(ks) - cdf[0]) < 0.004
    assert abs(share[4] / len(ks) - (cdf[4] - cdf[3])) < 0.012


def test_poisson_of_zero_and_large_means(spark):
    row = spark.range(2000).select(
        poisson(0, 0, "z", F.col("id")).alias("z"), poisson(60, 0, "l", F.col("id")).alias("l")
    ).agg(F.max("z"), F.avg("l")).first()
    assert row[0] == 0 and abs(row[1] - 60) < 1
