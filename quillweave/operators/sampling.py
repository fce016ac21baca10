"""Exact, reproducible sampling without a global sort.

Order inside a pool is the order of ``(hash60(seed, salt, key), key)``, so it depends on
nothing but the row keys.  Three building blocks:

* ``histogram``      rows per pool and leading hash digit of the declared pools of a recipe,
                     the only numbers the driver sees
* ``first_k``        a predicate for the first k rows of each declared pool; rows are selected
                     map-side with no shuffle at all
* ``first_rows``     the same for any number of pools, null among them, with counts and cuts
                     as tables; nothing reaches the driver
* ``hash_rank``      dense 0-based rank, windowed over hash buckets (never over a pool)
* ``draw_table``     k draws as (pool, draw, rank of the row drawn)

Keys must be unique within a pool; a null key is a key like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillweave.functions.hashing import HASH_BITS, hash60
from quillweave.sources.writers import staged

BUCKET_BITS = 12
SMALL_BUCKET = 20_000
BROADCAST_ROWS = 1_000_000
#: 64-bit words of a Bloom filter of drawn keys, at most (they are broadcast), and bits a key it is made for
BLOOM_WORDS, BLOOM_BITS = 1 << 21, 16
#: bits a key below which a filter would let nearly every row pass
BLOOM_LEAST_BITS = 3
#: draws of one row that one task of a join takes at most
HOT_DRAWS = 100_000
#: cuts, one row per pool, that are broadcast at most
BROADCAST_POOLS = 100_000
WHOLE_NUMBERS = {"tinyint", "smallint", "int", "bigint"}
FIXED_WIDTH = WHOLE_NUMBERS | {"boolean", "float", "double", "date", "timestamp"}


class SampleTooLarge(ValueError):
    """More rows wanted without replacement than the pool holds."""


# ---- pools -----------------------------------------------------------------------------
@dataclass(frozen=True)
class Histogram:
    """Rows per pool and leading hash digit: at most ``2**bits`` numbers per pool.

    One scan of the key columns gives it, and everything else about an exact sample (pool
    sizes, where the k-th row lies, rank offsets) follows from it on the driver.
    """

    key: tuple[str, ...]
    seed: int
    salt: str
    bits: int
    cells: Mapping[str, Mapping[int, int]]

    @property
    def sizes(self) -> dict[str, int]:
        return {pool: sum(cells.values()) for pool, cells in self.cells.items()}

    def offsets(self, spark: SparkSession) -> DataFrame:
        """Rows before each cell: columns ``pool``, ``_b``, ``_off``."""
        rows = []
        for pool, cells in self.cells.items():
            seen = 0
            for digit in sorted(cells):
                rows.append((pool, digit, seen))
                seen += cells[digit]
        return spark.createDataFrame(
            pd.DataFrame(rows, columns=["pool", "_b", "_off"]), "pool string, _b bigint, _off bigint"
        )


def histogram(
    df: DataFrame,
    key: Sequence[str],
    pool: Column,
    *,
    seed: int = 0,
    salt: str = "order",
    bits: int = BUCKET_BITS,
) -> Histogram:
    """Count rows by pool and leading hash digit, for a recipe's declared pools (null is outside)."""
    digit = F.shiftright(hash60(seed, salt, *[F.col(k) for k in key]), HASH_BITS - bits)
    counted = (
        df.select(pool.alias("_p"), digit.alias("_b"))
        .filter("_p is not null")
        .groupBy("_p", "_b")
        .count()
        .toPandas()
    )
    cells: dict[str, dict[int, int]] = {}
    for name, b, n in counted.itertuples(index=False):
        cells.setdefault(name, {})[int(b)] = int(n)
    return Histogram(tuple(key), seed, salt, bits, cells)


def per_pool(pool: Column, values: Mapping[str, object]) -> Column:
    """Literal chosen by pool name; null for other pools."""
    if not values:
        return F.lit(None)
    out = None
    for name, value in values.items():
        out = (F.when if out is None else out.when)(pool == F.lit(name), F.lit(value))
    return out


# ---- ranks ---------------------------------------------------------------------------
def bucketed_rank(
    df: DataFrame,
    by: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    out: str,
    offsets: DataFrame | None = None,
) -> DataFrame:
    """Dense 0-based rank within ``by``, for a ``bucket`` that is monotone in ``order``.

    One exchange of ``df`` on (by, bucket).  Without given ``offsets`` the bucket counts
    are aggregated map-side from pruned columns and joined back on the same keys, so they
    need no exchange of ``df`` either.
    """
    # null groups get a value and a flag, so that all keys join by plain equality and the
    # join can use the partitioning of the window
    group = {}
    for place, name in enumerate(by):
        whole = dict(df.dtypes)[name] in WHOLE_NUMBERS
        value = F.col(name) if whole else F.col(name).cast("string")
        group[f"_g{place}"] = F.coalesce(value, F.lit(0 if whole else ""))
        group[f"_n{place}"] = F.col(name).isNull()
    cell = [*group, "_b"]
    staged = df.withColumns({**group, "_b": F.coalesce(bucket, F.lit(-(1 << 62)))})
    if offsets is None:
        counted = staged.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
        # few cells per group, hence a small window
        earlier = (
            Window.partitionBy(*(list(group) or [F.lit(0)]))
            .orderBy("_b")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        offsets = counted.select(
            *cell, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off")
        )
    else:
        offsets = offsets.withColumns(group).select(*cell, "_off")
    inner = Window.partitionBy(*cell).orderBy(*order)
    ranked = staged.withColumn("_rn", F.row_number().over(inner))
    return ranked.join(offsets, cell).select(
        *df.columns, (F.col("_off") + F.col("_rn") - 1).cast("bigint").alias(out)
    )


def hash_rank(
    df: DataFrame,
    key: Sequence[str],
    *,
    by: Sequence[str] = (),
    seed: int = 0,
    salt: str = "order",
    out: str = "rank",
    bits: int = BUCKET_BITS,
    offsets: DataFrame | None = None,
) -> DataFrame:
    """Seeded shuffle order as a ``rank`` column (0-based, dense, per ``by`` group)."""
    staged = df.withColumn("_h", hash60(seed, salt, *[F.col(k) for k in key]))
    bucket = F.shiftright("_h", HASH_BITS - bits)
    order = [F.col("_h"), *[F.col(k) for k in key]]
    return bucketed_rank(staged, by, bucket, order, out, offsets).drop("_h")


def dense_position(
    df: DataFrame, by: Sequence[str], order: str, *, ties: Sequence[str] = (), out: str = "pos", span: int = 4096
) -> DataFrame:
    """0-based position by a whole-number ``order`` column within each group.

    Equal or null numbers are ordered by the columns ``ties``.  Groups are cut into chunks of ``span`` order values, so one huge group spreads out.
    """
    return bucketed_rank(df, by, F.floor(F.col(order) / span), [F.col(order), *[F.col(c) for c in ties]], out)


# ---- first k of each pool --------------------------------------------------------------
def first_k(df: DataFrame, pool: Column, counts: Histogram, want: Mapping[str, int]) -> Column:
    """Predicate: the row is among the first ``want[pool]`` rows of its pool in hash order.

    The k-th smallest hash is found digit by digit: the histogram tells which leading digit
    holds the k-th row; while more than a few rows share it, they are counted by their next
    digit (a scan with a map-side aggregate of at most ``2**bits`` cells per pool).
    Applying the result needs neither shuffle nor join.
    """
    key, sizes = counts.key, counts.sizes
    for name, k in want.items():
        if k > sizes.get(name, 0):
            raise SampleTooLarge(f"{name}: {k} rows wanted, {sizes.get(name, 0)} there")
    row_key = [F.col(c) for c in key]
    h = hash60(counts.seed, counts.salt, *row_key)
    staged = df.select(pool.alias("_p"), h.alias("_h"), *row_key)
    # pool -> (bits already fixed, their value, rows wanted inside, rows inside)
    found = {
        name: _descend(counts.cells[name], k, counts.bits)
        for name, k in want.items()
        if 0 < k < sizes[name]
    }

    def inside(name: str) -> Column:
        depth, value = found[name][:2]
        return (F.col("_p") == F.lit(name)) & (F.shiftright("_h", HASH_BITS - depth) == value)

    while deep := [n for n, s in found.items() if s[3] > SMALL_BUCKET and s[0] < HASH_BITS]:
        depth = found[deep[0]][0]
        level = [n for n in deep if found[n][0] == depth]
        step = min(counts.bits, HASH_BITS - depth)
        digit = F.shiftright("_h", HASH_BITS - depth - step)
        rows = (
            staged.filter(reduce(lambda a, b: a | b, [inside(n) for n in level]))
            .groupBy("_p", digit.alias("_d"))
            .count()
            .collect()
        )
        for name in level:
            cells = {r["_d"]: r["count"] for r in rows if r["_p"] == name}
            found[name] = _descend(cells, found[name][2], depth + step)

    cuts = {}
    if found:
        nth = Window.partitionBy("_p").orderBy("_h", *key)
        wanted = per_pool(F.col("_p"), {n: s[2] for n, s in found.items()})
        last_rows = (
            staged.filter(reduce(lambda a, b: a | b, [inside(n) for n in found]))
            .withColumn("_rn", F.row_number().over(nth))
            .filter(F.col("_rn") == wanted)
            .collect()
        )
        cuts = {r["_p"]: r for r in last_rows}

    out = None
    for name, k in want.items():
        if k <= 0:
            continue
        if k == sizes[name]:
            inside_cut = F.lit(True)
        else:
            inside_cut = _up_to([h, *row_key], [cuts[name][c] for c in ("_h", *key)])
        out = (F.when if out is None else out.when)(pool == F.lit(name), inside_cut)
    return F.lit(False) if out is None else F.coalesce(out.otherwise(F.lit(False)), F.lit(False))


def _descend(cells: Mapping[int, int], k: int, depth: int) -> tuple[int, int, int, int]:
    """Cell that holds the ``k``-th row, and which row of the cell it is."""
    for digit in sorted(cells):
        if k <= cells[digit]:
            return depth, digit, k, cells[digit]
        k -= cells[digit]
    raise AssertionError("fewer rows than counted; the table changed between scans")


def _up_to(columns: list[Column], values: list) -> Column:
    """Lexicographic ``columns <= values``, nulls first as in a sort; never null."""
    here = columns[0]
    value = values[0] if isinstance(values[0], Column) else F.lit(values[0])
    below = F.coalesce(here < value, here.isNull() & value.isNotNull())
    same = here.eqNullSafe(value)
    return below | (same & (_up_to(columns[1:], values[1:]) if columns[1:] else F.lit(True)))


def first_rows(
    df: DataFrame, key: Sequence[str], pool: Column, amount: Callable[[Column], Column], *, seed: int = 0, salt: str = "order"
) -> tuple[DataFrame, Column]:
    """``df`` with helper columns, and whether a row is among the first ``amount(size)`` of its pool.

    Rows per (pool, leading digit) are counted map-side and kept; running sums per pool, at most
    ``2**BUCKET_BITS`` rows each, give the cell of the last row wanted, and a row number
    inside that cell the row itself.  The cuts, one row per pool, are joined by pool:
    broadcast if there are few, else shuffled.  Any number of pools; null is one of them.
    Raises ``SampleTooLarge`` where more is wanted than there is.  The key columns of ``df`` are
    read twice and its rows once: stage what is costly to compute (``staged``).
    """
    row_key = [F.col(c) for c in key]
    h = hash60(seed, salt, *row_key)
    thin = df.select(pool.alias("_p"), h.alias("_h"), *row_key).withColumn("_b", F.shiftright("_h", HASH_BITS - BUCKET_BITS))
    cells = staged(thin.groupBy("_p", "_b").agg(F.count(F.lit(1)).alias("_n")))
    own = Window.partitionBy("_p")
    summed = cells.select(
        "_p", "_b", "_n", F.sum("_n").over(own).alias("_size"),
        F.sum("_n").over(own.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_upto"),
    ).withColumn("_k", amount(F.col("_size")).cast("bigint"))
    by_pool = summed.filter("_upto = _size").agg(F.coalesce(F.max(F.col("_k") > F.col("_size")), F.lit(False)), F.count_if(F.col("_k") > 0))
    too_much, pools = by_pool.first()  # two numbers
    if too_much:
        raise SampleTooLarge("more rows wanted than a pool holds")
    last = summed.filter((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k")))
    last = last.select(F.col("_p").alias("_lp"), F.col("_b").alias("_lb"), (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_nth"))
    if pools <= BROADCAST_POOLS:
        last = F.broadcast(last)
    inside = thin.join(last, F.col("_p").eqNullSafe(F.col("_lp")) & (F.col("_b") == F.col("_lb")))
    nth = Window.partitionBy("_p", "_b").orderBy("_h", *key)
    cuts = inside.withColumn("_rn", F.row_number().over(nth)).filter("_rn = _nth")
    cuts = cuts.select(F.col("_p").alias("_cp"), F.col("_h").alias("_ch"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(key)])
    if pools <= BROADCAST_POOLS:
        cuts = F.broadcast(cuts)
    joined = df.withColumn("_pool", pool).join(cuts, F.col("_pool").eqNullSafe(F.col("_cp")), "left")
    within = F.col("_ch").isNotNull() & _up_to([h, *row_key], [F.col("_ch"), *[F.col(f"_c{i}") for i in range(len(key))]])
    return joined, within


def sample_per_pool(
    df: DataFrame,
    key: Sequence[str],
    pool: Column,
    amount: Callable[[Column], Column],
    *,
    seed: int = 0,
    salt: str = "order",
) -> DataFrame:
    """Exactly ``amount(size)`` rows of each pool, without replacement."""
    joined, within = first_rows(df, key, pool, amount, seed=seed, salt=salt)
    return joined.filter(within).select(*df.columns)


def head_n(df: DataFrame, key: Sequence[str], n: int, *, seed: int = 0, salt: str = "order"):
    """First ``n`` rows of the seeded shuffle; also an exact sample without replacement."""
    if n <= 0:
        return df.filter(F.lit(False))
    counts = histogram(df, key, F.lit("all"), seed=seed, salt=salt)
    return df.filter(first_k(df, F.lit("all"), counts, {"all": n}))


sample_without_replacement = head_n


def split_by_share(
    df: DataFrame,
    key: Sequence[str],
    *,
    pool: Column,
    percent: int = 10,
    seed: int = 42,
    salt: str = "split",
    out: str = "split",
) -> DataFrame:
    """Label ``test`` for ``ceil(percent% of n)`` random rows of every pool, else ``train``."""
    joined, in_test = first_rows(df, key, pool, lambda size: F.floor((size * percent + 99) / 100), seed=seed, salt=salt)
    return joined.select(*[c for c in df.columns if c != out], F.when(in_test, "test").otherwise("train").alias(out))


def split_head(df: DataFrame, train_rows: int, *, rank: str = "pos", out: str = "split"):
    """The first ``train_rows`` positions are ``train``, the rest ``eval``."""
    return df.withColumn(out, F.when(F.col(rank) < train_rows, "train").otherwise("eval"))


# ---- draws -----------------------------------------------------------------------------
def draw_table(
    spark: SparkSession,
    draws: Mapping[str, int],
    sizes: Mapping[str, int],
    replace: Mapping[str, bool],
    *,
    seed: int = 0,
) -> DataFrame:
    """Columns ``pool``, ``draw`` (0-based in the pool) and ``rank`` of the row drawn.

    Made from one range of draw numbers; nothing is listed on the driver.
    """
    named = {n: k for n, k in draws.items() if k > 0}
    for name in named:
        if sizes.get(name, 0) == 0:
            raise SampleTooLarge(f"{name}: the pool is empty")
    starts, at = {}, 0
    for name, k in named.items():
        starts[name] = at
        at += k
    pool = None
    for name in reversed(list(named)):
        here = F.lit(name)
        pool = here if pool is None else F.when(F.col("id") < starts[name] + named[name], here).otherwise(pool)
    if pool is None:
        pool = F.lit("")
    numbered = spark.range(at).select(F.col("id"), pool.alias("pool"))
    draw = F.col("id") - per_pool(F.col("pool"), starts)
    size = per_pool(F.col("pool"), {n: sizes[n] for n in named})
    with_replacement = per_pool(F.col("pool"), {n: replace[n] for n in named})
    with_draw = numbered.select("pool", draw.cast("bigint").alias("draw"), size.alias("_size"), with_replacement.alias("_wr"))
    random_rank = hash60(seed, "draw", F.col("pool"), F.col("draw")) % F.col("_size")
    return with_draw.select(
        "pool", "draw", F.when(F.col("_wr"), random_rank).otherwise(F.col("draw")).cast("bigint").alias("rank")
    )


def fixed_width(df: DataFrame, columns: Sequence[str]) -> bool:
    return all(t in FIXED_WIDTH for name, t in df.dtypes if name in columns)


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of known row count and fixed-width columns, if it is small."""
    # pool names are the short literals of a recipe
    others = [c for c in df.columns if c != "pool"]
    return F.broadcast(df) if rows <= BROADCAST_ROWS and fixed_width(df, others) else df


def draw_keys(
    keys: DataFrame,
    counts: Histogram,
    draws: Mapping[str, int],
    replace: Mapping[str, bool],
) -> DataFrame:
    """Keys of the drawn rows: ``pool``, ``draw`` and the key columns.

    ``keys`` has ``pool`` and the key columns only, so ranking a corpus moves no text.  For
    pools sampled without replacement the keys beyond the cut are dropped before ranking.
    """
    spark = keys.sparkSession
    table = draw_table(spark, draws, counts.sizes, replace, seed=counts.seed)
    without = {n: k for n, k in draws.items() if k > 0 and not replace[n]}
    wanted = F.col("pool").isin([n for n, k in draws.items() if k > 0 and replace[n]])
    if without:
        wanted = wanted | first_k(keys, F.col("pool"), counts, without)
    ranked = hash_rank(
        keys.filter(wanted),
        counts.key,
        by=["pool"],
        seed=counts.seed,
        salt=counts.salt,
        bits=counts.bits,
        offsets=counts.offsets(spark),
    )
    rows = sum(draws.values())
    pooled = sum(n if replace.get(name) else draws.get(name, 0) for name, n in counts.sizes.items() if draws.get(name, 0) > 0)
    if pooled < rows and pooled <= BROADCAST_ROWS and fixed_width(ranked, counts.key):
        ranked = F.broadcast(ranked)  # more draws than rows: the rows go to the draws, and none is a hot key
    else:
        table = small_enough(table, rows)
    drawn = ranked.join(table, ["pool", "rank"])
    return drawn.select("pool", "draw", *counts.key)


def sample_with_replacement(df: DataFrame, key: Sequence[str], k: int, *, seed: int = 0) -> DataFrame:
    """Exactly ``k`` draws: the columns of ``df`` plus ``draw``."""
    return _sample(df, key, k, lambda size: True, seed)


def sample_adaptive(df: DataFrame, key: Sequence[str], k: int, *, seed: int = 0) -> DataFrame:
    """Without replacement while the table is large enough, else with."""
    return _sample(df, key, k, lambda size: k > size, seed)


def _sample(df, key, k, with_replacement, seed) -> DataFrame:
    keys = df.select(F.lit("all").alias("pool"), *key)
    counts = histogram(keys, key, F.col("pool"), seed=seed, salt="pool")
    replace = {"all": with_replacement(counts.sizes.get("all", 0))}
    return attach(df, draw_keys(keys, counts, {"all": k}, replace).drop("pool"), key, k)


def bloom_filter(keys: DataFrame, key: Sequence[str], rows: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``(words, near)``: a Bloom filter of ``rows`` keys, and the rows of a table that it lets pass.

    The filter is a table of 64-bit words.  A key's hash names its word and the bits it sets there;
    bits of a word are or-ed, map-side first.  ``near`` looks a row's word up in the broadcast
    table, so a corpus is thinned where it lies, before any exchange.  Every key of ``keys`` passes.
    """
    words = max(1, min(BLOOM_WORDS, rows * BLOOM_BITS // 64))
    bits = max(1, min(6, round(0.69 * 64 * words / max(rows, 1))))

    def word(columns: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(F.lit(1), *columns), F.lit(words))

    def mask(columns: Sequence[str]) -> Column:
        own = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(F.lit(2 + i), *columns), F.lit(64)).cast("int")) for i in range(bits)]
        return reduce(lambda a, b: a.bitwiseOR(b), own)

    table = keys.select(word(key).alias("_word"), mask(key).alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))

    def near(df: DataFrame) -> DataFrame:
        own = df.withColumns({"_at": word(key), "_mask": mask(key)})
        inside = (F.col("_at") == F.col("_word")) & (F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
        return own.join(F.broadcast(table), inside, "left_semi").drop("_at", "_mask")

    return table, near


def attach(df: DataFrame, drawn: DataFrame, key: Sequence[str], rows: int) -> DataFrame:
    """Fetch the rows of the ``rows`` drawn keys; texts move only where they were drawn.

    Few fixed-width keys are broadcast themselves.  Of others, and of many, a Bloom filter is
    broadcast: it thins ``df`` to about the drawn rows, and only those are joined on the key.  A
    row that is drawn more than ``HOT_DRAWS`` times is dealt to several tasks.  So many draws
    that a filter of bounded size has fewer than ``BLOOM_LEAST_BITS`` bits for each need a
    shuffled join of ``df``; that many rows move anyhow.
    """
    if rows <= BROADCAST_ROWS and fixed_width(drawn, key):
        return _on_key(df, F.broadcast(drawn), key)
    drawn = staged(drawn)
    if 64 * BLOOM_WORDS >= BLOOM_LEAST_BITS * rows:
        df = bloom_filter(drawn, key, rows)[1](df)
    if rows <= HOT_DRAWS:
        return _on_key(df, drawn, key)
    # rows drawn very often, at most rows / HOT_DRAWS of them, are copied for each share of their draws
    often = drawn.groupBy(*key).agg(F.floor((F.count(F.lit(1)) - 1) / HOT_DRAWS).cast("int").alias("_shares")).filter("_shares > 0")
    often = staged(often)
    if often.isEmpty():
        return _on_key(df, drawn, key)
    number = [c for c in drawn.columns if c not in key]
    shares = F.coalesce("_shares", F.lit(0))
    spread = _on_key(drawn, F.broadcast(often), key, "left").withColumn("_share", F.pmod(F.xxhash64(*number), shares + 1).cast("int")).drop("_shares")
    copied = _on_key(df, F.broadcast(often), key, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares))).drop("_shares")
    return _on_key(copied, spread, [*key, "_share"]).drop("_share")


def _on_key(df: DataFrame, drawn: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the key, a null equal to a null."""
    named = drawn.withColumnsRenamed({k: f"_k_{k}" for k in key})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key])
    others = [c for c in df.columns if c not in key]
    return df.join(named, same, how).select(*key, *others, *[c for c in drawn.columns if c not in key])


def repeat(df: DataFrame, copies: Column, out: str = "copy") -> DataFrame:
    """Each row ``copies`` times (1 or more), numbered from 1 in ``out``."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(1), copies)))


# ---- keys for tables without one ---------------------------------------------------------
def with_content_key(df: DataFrame, *, chunk: int = 100_000) -> DataFrame:
    """Key by content for tables without one: ``digest`` of the whole row and
    ``occurrence`` (0-based among equal rows), in front of the columns.

    Equal rows are interchangeable, so they are counted (map-side, so copies never meet in
    one task as rows) and the count is expanded again.  Rows are grouped by all their
    columns, so the digest need not tell them apart; it is made of two 64-bit hashes, which
    see every bit of a timestamp and which fields of a nested value are null.  Counts over
    ``chunk`` are expanded in blocks spread over the cluster.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    marked = [F.struct(F.col(c).isNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}), F.col(c)) for c in df.columns]
    digest = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *marked)), 16, "0") for seed in (1, 2)])
    counted = counted.select(digest.alias("digest"), "_n", F.struct(*df.columns).alias("_row"))
    few = counted.filter(F.col("_n") <= chunk).withColumn("_block", F.lit(0).cast("bigint"))
    many = (
        counted.filter(F.col("_n") > chunk)
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / chunk))))
        .repartition("digest", "_block")
    )
    last = F.least(F.col("_n"), (F.col("_block") + 1) * chunk) - 1
    return few.unionByName(many).select(
        "digest", F.explode(F.sequence(F.col("_block") * chunk, last)).alias("occurrence"), "_row.*"
    )
