"""Sharding along a Hilbert curve over metadata.

Several metadata dimensions are quantised to cells, the cells' index on a Hilbert curve
orders the rows, and the order is cut into runs: each shard covers a compact region in all
dimensions at once, so per-file minima and maxima prune on any of them.  Everything is
built-in expressions.

The order is (curve index, hashed run, hash, key, ...).  Its ranks come from counts per
(index, run) and a row number inside one, so neither a hot cell nor the whole table passes
through one task; the only single-task step has one row per curve index that occurs, at
most ``2 ** (dimensions * bits)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillweave.llm.common import keep, whole_text

BITS = 5
#: rows that share a run, about, if all rows are in one cell; at most 2 ** 16 runs in a cell
RUN_ROWS = 256
MAX_RUN_BITS = 16


def curve_steps(n: int) -> list[int]:
    """Transition table of the ``n``-dimensional curve, from its rule.

    A state is the corner at which the curve enters a cube and the axis along which it
    leaves.  Entry ``state * 2**n + corner`` holds ``next_state * 2**n + digit``.
    """
    size, mask = 1 << n, (1 << n) - 1

    def turn_right(x: int, k: int) -> int:
        k %= n
        return ((x >> k) | (x << (n - k))) & mask

    def turn_left(x: int, k: int) -> int:
        return turn_right(x, n - k % n)

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    place = {gray(i): i for i in range(size)}

    def ones(i: int) -> int:
        return ((i + 1) & ~i).bit_length() - 1

    enters = [0] + [gray(2 * ((i - 1) // 2)) for i in range(1, size)]
    leaves = [0] + [(ones(i) if i % 2 else ones(i - 1)) % n for i in range(1, size)]
    out = []
    for entry in range(size):
        for axis in range(n):
            for corner in range(size):
                digit = place[turn_right(corner ^ entry, axis + 1)]
                e = entry ^ turn_left(enters[digit], axis + 1)
                a = (axis + leaves[digit] + 1) % n
                out.append((e * n + a) * size + digit)
    return out


def curve_index(cells: list[Column], bits: int) -> Column:
    """Hilbert index of a point with ``bits``-bit coordinates."""
    n = len(cells)
    steps = F.array(*[F.lit(s) for s in curve_steps(n)])

    def corner(level: Column) -> Column:
        parts = [F.call_function("shiftright", c.cast("int"), level.cast("int")).bitwiseAND(F.lit(1)) * (1 << i) for i, c in enumerate(cells)]
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    def step(state: Column, level: Column) -> Column:
        nxt = F.get(steps, state["at"] * (1 << n) + corner(level)).cast("bigint")
        return F.struct(
            F.floor(nxt / (1 << n)).cast("int").alias("at"),
            (state["index"] * (1 << n) + nxt % (1 << n)).alias("index"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("index"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(bits - 1, -1, -1)]), start, step, lambda s: s["index"])


def _common_prefix(low: bytes, high: bytes) -> int:
    n = 0
    while n < min(len(low), len(high)) and low[n] == high[n]:
        n += 1
    return n


def _text_number(value: Column, skip: int) -> Column:
    """Order-preserving number of six bytes of a text after ``skip``."""
    data = F.substring(value.cast("binary"), skip + 1, 6)
    return F.conv(F.rpad(F.hex(data), 12, "0"), 16, 10).cast("double")


def cells_of(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """Quantised dimensions: equal-width cells between minimum and maximum; null is cell 0.

    Texts by their first bytes after the common prefix, numbers on a logarithmic scale.
    Only each dimension's minimum and maximum reach the driver.
    """
    ends = df.agg(*[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]).first()
    kinds = dict(df.dtypes)
    out = []
    for d in dims:
        low, high = ends[f"min_{d}"], ends[f"max_{d}"]
        if low is None or low == high:
            out.append(F.when(F.col(d).isNull(), 0).otherwise(1))
            continue
        if kinds[d] == "string":
            skip = _common_prefix(low.encode(), high.encode())
            number = _text_number(F.col(d), skip)
            ends_as = [int.from_bytes(x.encode()[skip : skip + 6].ljust(6, b"\0"), "big") for x in (low, high)]
        else:
            number = F.log1p(F.col(d).cast("double") - F.lit(float(low)))
            ends_as = [0.0, math.log1p(float(high) - float(low))]
        span = max(ends_as[1] - ends_as[0], 1e-9)
        cell = F.floor((number - F.lit(float(ends_as[0]))) / F.lit(float(span)) * ((1 << bits) - 1))
        out.append(F.when(F.col(d).isNull(), 0).otherwise(F.greatest(F.lit(1), F.least(F.lit((1 << bits) - 1), cell + 1))).cast("int"))
    return out


def shard(
    df: DataFrame,
    shards: int = 8,
    *,
    dims: tuple[str, ...] = ("lang", "source", "size"),
    law: str = "rows",
    bits: int = BITS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Shard and slot of every row: key, size, text_crc32, curve, shard, slot.

    ``law`` ``"rows"`` cuts runs whose counts are at most one apart, ``"bytes"`` runs of near
    equal ``size`` (UTF-8 bytes plus one).  Slots number a shard's rows from 0 along the
    curve.  ``dims`` are columns of ``df`` or ``size``; an absent one is left out.  Null
    texts have size 1, null dimensions a cell of their own, null keys take part; equal rows
    are neighbours on the curve; an empty table gives no rows.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    data = whole_text(text).cast("binary")
    present = [d for d in dims if d != "size" and d in df.columns]
    thin = keep(
        df.select(
            F.col(key).alias("key"),
            (F.octet_length(whole_text(text)).cast("bigint") + 1).alias("size"),
            F.crc32(data).alias("text_crc32"),
            *[F.col(d).alias(f"dim_{d}") for d in present],
        ),
        "shard-keys",
    )
    total = thin.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    used = [f"dim_{d}" for d in present] + (["size"] if "size" in dims else [])
    run_bits = min(MAX_RUN_BITS, max(0, math.ceil(math.log2(max(total["n"], 1) / RUN_ROWS + 1))))
    spread = F.xxhash64("key", "text_crc32", "size")
    rows = thin.select(
        "key", "size", "text_crc32",
        curve_index(cells_of(thin, used, bits), bits).alias("curve"),
        spread.alias("spread"),
        F.pmod(spread, F.lit(1 << run_bits)).alias("run"),
    )

    runs = keep(rows.groupBy("curve", "run").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "shard-runs")
    over_cells = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    over_runs = Window.partitionBy("curve").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    cells = runs.groupBy("curve").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    cells = cells.select("curve", so_far("n", over_cells).alias("cell_n"), so_far("bytes", over_cells).alias("cell_bytes"))
    starts = runs.select("curve", "run", so_far("n", over_runs).alias("run_n"), so_far("bytes", over_runs).alias("run_bytes"))
    starts = starts.join(cells, "curve").select(
        "curve", "run", (F.col("cell_n") + F.col("run_n")).alias("start_n"), (F.col("cell_bytes") + F.col("run_bytes")).alias("start_bytes")
    )

    order = Window.partitionBy("curve", "run").orderBy("spread", "key", "size", "text_crc32")
    inside = rows.withColumn("nth", F.row_number().over(order) - 1)
    inside = inside.withColumn("inside", so_far("size", order.rowsBetween(Window.unboundedPreceding, -1)))
    placed = inside.join(starts, ["curve", "run"]).select(
        F.col("key").alias(key), "size", "text_crc32", "curve",
        (F.col("start_n") + F.col("nth")).cast("bigint").alias("place"),
        (F.col("start_bytes") + F.col("inside")).alias("bytes_before"),
    )
    n = max(total["n"], 1)
    if law == "rows":
        at = F.expr(f"place * {shards} div {n}").cast("int")
        first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
        return placed.withColumn("shard", at).withColumn("slot", (F.col("place") - first).cast("bigint")).drop("place", "bytes_before")
    middle = F.col("bytes_before") + F.expr("size div 2")
    at = F.least(F.lit(shards - 1), F.floor(middle * shards / max(total["bytes"] or 1, 1))).cast("int")
    cut = keep(placed.withColumn("shard", at), "shard-cut")
    firsts = cut.groupBy("shard").agg(F.min("place").alias("first"))  # one row per shard
    return cut.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("place") - F.col("first")).drop("place", "bytes_before", "first")
