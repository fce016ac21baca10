"""Mixing and sharding: brute force, laws, plans without Python."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillweave.llm import hilbert, mixing_fill
from tests.llm.conftest import TEXTS


def filled(sizes, weights, epochs):
    """The loop itself: clamp, share the excess, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped = {}
    while True:
        rest = [s for s in order if s not in stopped]
        left = sum(sizes.values()) - sum(stopped.values())
        shares = sum(weight[s] for s in rest)
        above = [s for s in rest if epochs * sizes[s] * shares <= left * weight[s]]
        if not above:
            return {s: stopped.get(s, left * weight[s] / shares if shares else 0) for s in order}
        stopped.update({s: epochs * sizes[s] for s in above})


@pytest.mark.parametrize(
    "sizes", [{"a": 10, "b": 1000, "c": 1}, {"a": 5, "b": 5, "c": 5, None: 5}, {"x": 1}, {"a": 0, "b": 7}, {"a": 1, "b": 3, "c": 9, "d": 27, "e": 81, "f": 1000}]
)
def test_water_level(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing_fill.water_fill(df, (1, 2, 3), 3).collect()}
    assert got == pytest.approx(filled(sizes, (1, 2, 3), 3))


def test_mix_of_odd_rows(odd_documents, no_documents):
    rows = mixing_fill.mix(odd_documents).collect()
    assert len(rows) == len(TEXTS)
    by_source = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_source.setdefault(r["source"], []).append(r)
    want = filled({s: rs[0]["source_size"] for s, rs in by_source.items()}, (1, 2, 3), 3)
    for s, rs in by_source.items():
        assert rs[0]["target"] == pytest.approx(want[s]) and sum(r["size"] for r in rs) == rs[0]["source_size"]
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) < 1
    again = mixing_fill.mix(odd_documents.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    assert mixing_fill.mix(no_documents).collect() == []


def test_mixture_as_rows(odd_documents, no_documents):
    out = mixing_fill.repeated(odd_documents)
    assert out.columns == odd_documents.columns
    taken = {(r["doc_id"], r["digest"]): (r["taken"], r["size"]) for r in mixing_fill.mix(odd_documents).filter("doc_id <> 2").collect()}
    times = {}
    for r in out.filter("doc_id <> 2").withColumn("d", mixing_fill.draw_digest("doc_id", "text", mixing_fill.SEED)).collect():
        times[r["doc_id"], r["d"]] = times.get((r["doc_id"], r["d"]), 0) + 1
    for k, (words, size) in taken.items():
        assert abs(times.get(k, 0) - (words / size if size else 1)) <= 0.5
    assert mixing_fill.repeated(no_documents).collect() == []


def test_curve_visits_neighbours(spark):
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        df = spark.range(side**n).select(*[(F.floor(F.col("id") / side**i) % side).cast("int").alias(f"c{i}") for i in range(n)])
        df = df.withColumn("h", hilbert.curve_index([F.col(f"c{i}") for i in range(n)], bits))
        rows = sorted((r["h"], tuple(r)[:n]) for r in df.collect())
        assert [h for h, _ in rows] == list(range(side**n))
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(rows, rows[1:]))


def placed_by_hand(spark, rows, shards, law, bits=hilbert.BITS):
    """(key, shard, slot) by sorting in Python: cells from minimum to maximum, then curve, run, hash, key."""
    made = [(key, lang, source, len((text or "").encode()) + 1, zlib.crc32((text or "").encode())) for key, text, lang, source in rows]
    top = (1 << bits) - 1

    def cells(values):
        known = [v for v in values if v is not None]
        low, high = min(known, default=None), max(known, default=None)
        out = []
        for v in values:
            if v is None:
                out.append(0)
            elif low == high:
                out.append(1)
            elif isinstance(v, str):
                a, b, x = low.encode(), high.encode(), v.encode()
                skip = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
                a, b, x = (int.from_bytes(t[skip : skip + 6].ljust(6, b"\0"), "big") for t in (a, b, x))
                out.append(max(1, min(top, math.floor((x - a) / max(b - a, 1e-9) * top) + 1)))
            else:
                out.append(max(1, min(top, math.floor(math.log1p(v - low) / math.log1p(high - low) * top) + 1)))
        return out

    by_dim = [cells([r[i] for r in made]) for i in (1, 2, 3)]
    table = [(i, *c, r[0], r[4], r[3]) for i, (c, r) in enumerate(zip(zip(*by_dim), made))]
    df = spark.createDataFrame(table, "i int, a int, b int, c int, key long, text_crc32 long, size long")
    run_bits = max(0, math.ceil(math.log2(max(len(rows), 1) / hilbert.RUN_ROWS + 1)))
    spread = F.xxhash64("key", "text_crc32", "size")
    got = df.select("i", hilbert.curve_index([F.col(x) for x in "abc"], bits), F.pmod(spread, F.lit(1 << run_bits)), spread).collect()
    order = sorted((tuple(g)[1:], (made[g[0]][0] is not None, made[g[0]][0] or 0, made[g[0]][3], made[g[0]][4])) for g in got)
    n, total, before, out, slots = len(rows), sum(r[3] for r in made), 0, [], {}
    for place, (_, (some, key, size, crc)) in enumerate(order):
        at = place * shards // n if law == "rows" else min(shards - 1, (before + size // 2) * shards // total)
        before += size
        slots[at] = slots.get(at, -1) + 1
        out.append((key if some else None, size, crc, at, slots[at]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_placement_by_hand(spark, law):
    r = random.Random(6)
    rows = [(i, "y" * r.choice([0, 3, 80, 900]) + "é" * r.randint(0, 9), r.choice(["en", "de", "fr", None]), f"src{r.randint(0, 19)}") for i in range(900)]
    rows += [(None, None, None, None), (900, None, "en", "src3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = [(x["doc_id"], x["size"], x["text_crc32"], x["shard"], x["slot"]) for x in hilbert.shard(df, 8, law=law).collect()]
    assert sorted(got, key=repr) == placed_by_hand(spark, rows, 8, law)


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_of_odd_rows(odd_documents, no_documents, law):
    rows = hilbert.shard(odd_documents, 4, law=law).collect()
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in TEXTS)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    shards = [[r for r in rows if r["shard"] == s] for s in range(4)]
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards)
    curve = [[r["curve"] for r in s] for s in shards if s]
    assert all(max(a) <= min(b) for a, b in zip(curve, curve[1:]))
    if law == "rows":
        assert max(map(len, shards)) - min(map(len, shards)) <= 1
    assert hilbert.shard(no_documents, 4, law=law).collect() == []


def test_bytes_are_near_equal(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    sizes = [r["b"] for r in hilbert.shard(df, 8, law="bytes").groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 200


def test_runs_prune_on_every_dimension(spark):
    df = spark.range(8000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("y"), (F.hash("id") % 100 + 100).cast("int")).alias("text"),
        F.concat(F.lit("l"), F.pmod(F.hash("id", F.lit(1)), F.lit(8))).alias("lang"), F.concat(F.lit("s"), F.pmod(F.hash("id", F.lit(2)), F.lit(8))).alias("source"),
    )
    placed = hilbert.shard(df, 8).join(df, "doc_id").groupBy("shard").agg(F.countDistinct("lang").alias("l"), F.countDistinct("source").alias("s"), (F.max("size") - F.min("size")).alias("z"))
    rows = placed.collect()
    assert sum(r["l"] for r in rows) < 56 and sum(r["s"] for r in rows) < 56


def test_plans_are_native(odd_documents, plan_of):
    for df in (mixing_fill.mix(odd_documents), hilbert.shard(odd_documents), mixing_fill.repeated(odd_documents)):
        assert not any(w in plan_of(df) for w in ("Python", "Arrow", "Pandas"))
