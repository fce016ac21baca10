"""Looking at rows: format, pages, display text, message blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillweave.functions.text import optional
from quillweave.operators.sampling import bucketed_rank, dense_position

PAGE_CELLS = 4096
#: rows that a range may have without being counted in finer cells
FEW_ROWS = 20_000


def row_format(df: DataFrame, query: str = "query", response: str = "response", messages: str = "messages") -> Column:
    """``pair`` if both texts are non-empty, else ``messages`` if there is a list, else ``unknown``."""
    pair = (optional(df, query) != "") & (optional(df, response) != "")
    listed = optional(df, messages).isNotNull()
    return (
        F.when(F.coalesce(pair, F.lit(False)), "pair").when(listed, "messages").otherwise("unknown")
    )


def _offset(key: str, low: int, width: int) -> Column:
    """Cell of a key from ``low`` on; decimals, so keys over the whole range of a long do not overflow."""
    return F.expr(f"(cast(`{key}` as decimal(20, 0)) - cast('{low}' as decimal(20, 0))) div cast('{width}' as decimal(20, 0))")


def _around(df: DataFrame, key: str, low: int, high: int, seen: int, rank: int) -> tuple[int, int, int]:
    """Key range that holds the row of a rank, and the rows before it.

    A range is counted in ``PAGE_CELLS`` equal cells, then the cell that holds the row in as
    many again, until it has few rows: outliers cost another count, not a large task.
    """
    while True:
        width = (high - low) // PAGE_CELLS + 1
        inside = df.filter(F.col(key).between(low, high))
        cells = inside.groupBy(_offset(key, low, width).alias("_c")).count().collect()
        for cell in sorted(cells, key=lambda r: r["_c"]):
            if seen + cell["count"] > rank:
                break
            seen += cell["count"]
        low = low + cell["_c"] * width
        high = min(high, low + width - 1)
        if cell["count"] <= FEW_ROWS or width == 1:
            return low, high, seen


def page(df: DataFrame, key: str, start: int, size: int) -> DataFrame:
    """Rows ``start .. start+size-1`` (0-based) by a whole-number key, with their ``rank``.

    The key ranges of the first and the last row are found by counting; only what lies
    between is read again, with the bounds pushed into the scan.  Rows without a key are
    not numbered.
    """
    if start < 0 or size < 0:
        raise ValueError("start and size must not be negative")
    low, high, rows = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if size == 0 or start >= rows:
        return df.limit(0).withColumn("rank", F.lit(0).cast("bigint"))
    first, _, before = _around(df, key, low, high, 0, start)
    _, last, _ = _around(df, key, low, high, 0, min(start + size, rows) - 1)
    width = (last - first) // PAGE_CELLS + 1
    inside = df.filter(F.col(key).between(first, last))
    ranked = bucketed_rank(inside, [], _offset(key, first, width), [F.col(key)], "rank")
    return ranked.withColumn("rank", F.col("rank") + before).filter(F.col("rank").between(start, start + size - 1))


#: rows of the table for one row of a page index
INDEX_STEP = 4096


def write_page_index(df: DataFrame, key: str, path: str, *, step: int = INDEX_STEP) -> str:
    """Every ``step``-th key with its rank, by a whole-number key; rows without a key are not numbered.

    One pass over the key column.  Pages are then found by ``indexed_page`` without counting.
    """
    ranked = dense_position(df.select(key).filter(F.col(key).isNotNull()), [], key, out="rank", span=step)
    marks = ranked.filter(F.col("rank") % step == 0).select(F.col(key).cast("bigint").alias("key"), "rank")
    marks.repartitionByRange("rank").sortWithinPartitions("rank").write.parquet(path)
    return path


def indexed_page(df: DataFrame, key: str, index: str, start: int, size: int) -> DataFrame:
    """As ``page``, from a stored index: the marks around the page bound the keys that are read.

    The index is searched by rank (pushed into its scan); of the table only the rows between two
    marks are read and numbered, at most ``size`` and two steps of them.
    """
    if start < 0 or size < 0:
        raise ValueError("start and size must not be negative")
    marks = df.sparkSession.read.schema("key bigint, rank bigint").parquet(index)
    low, before = marks.filter(F.col("rank") <= start).agg(F.max("key"), F.max("rank")).first()
    if size == 0 or low is None:
        return df.limit(0).withColumn("rank", F.lit(0).cast("bigint"))
    (high,) = marks.filter(F.col("rank") >= start + size).agg(F.min("key")).first()
    inside = df.filter((F.col(key) >= low) & (F.col(key) < high if high is not None else F.lit(True)))
    ranked = dense_position(inside, [], key, out="rank", span=INDEX_STEP)
    return ranked.withColumn("rank", F.col("rank") + before).filter(F.col("rank").between(start, start + size - 1))


def display_text(c: Column, latex: bool = False) -> Column:
    """Angle brackets and line ends as HTML; outside LaTeX mode the four LaTeX delimiters
    become a dollar sign."""
    for old, new in (("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        c = F.replace(c, F.lit(old), F.lit(new))
    if not latex:
        for old in ("\\(", "\\)", "\\[", "\\]"):
            c = F.replace(c, F.lit(old), F.lit("$"))
    return c


def message_blocks(df: DataFrame, key: Sequence[str], messages: str = "messages") -> DataFrame:
    """One row per message: ``pos``, upper-case ``role``, ``content``."""
    return df.select(*key, F.posexplode(messages).alias("pos", "_m")).select(
        *key, "pos", F.upper("_m.role").alias("role"), F.col("_m.content").alias("content")
    )
