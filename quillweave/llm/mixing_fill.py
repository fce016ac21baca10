"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight.  A source's target stops at ``epochs`` times its
size and the excess is shared by the others in proportion to their weights, until none is
above.  In order of ``cap / weight`` the stopped sources come first, so the fixed point of
that loop is a water level found with running sums over one row per source.

A target of ``1.4`` times a source takes every document once and two fifths of the source
again: documents in a seeded order up to the wanted words, the last one in part.  The order
is a digest of (seed, key, text), so reruns agree.  Running sums go by (source, digest
prefix), never over a whole source.  Everything is built-in expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillweave.llm.common import keep, whole_text

#: words: runs without space and the control characters from tab to carriage return
WORD = r"[^\x20\x09-\x0D]+"
SEED = 20_240
#: documents that share a running sum, about, if one source has all; a prefix has at most 4 hex digits
RUN_ROWS = 256
#: rows of one per source that are broadcast at most; beyond that they are joined by a shuffle
BROADCAST_SOURCES = 100_000


def words(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint")


def draw_digest(key: str, text: str, seed: int) -> Column:
    parts = [F.lit(str(seed)), F.col(key).cast("string"), F.md5(whole_text(text).cast("binary"))]
    return F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 16)


def water_fill(sources: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """``target`` for each row of ``sources`` (source, source_size), one row per source.

    Weights repeat over the sources in order of code points, null last; the budget is all
    words.  Sums are integers, so the result does not depend on their order.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    following = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    options = F.array(*[F.lit(w).cast("bigint") for w in weights])
    wide = "decimal(38,0)"
    ranked = sources.withColumn("place", F.row_number().over(order))
    weighed = ranked.select(
        "source", "source_size", "place",
        F.element_at(options, (F.col("place") - 1) % len(weights) + 1).alias("weight"),
        (F.col("source_size") * epochs).alias("cap"),
    )
    level = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(rest).alias("shares"),
    )
    # stopped: at the level of the sources from here on, this one would be at its cap
    stopped = level.withColumn(
        "stopped", F.col("cap").cast(wide) * F.col("shares") <= F.col("left").cast(wide) * F.col("weight")
    ).withColumn("stopped", F.min("stopped").over(following))
    water = F.first(F.when(~F.col("stopped"), F.struct("left", "shares")), ignorenulls=True).over(everything)
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(
        (F.col("weight") * F.col("water.left")).cast("double") / F.col("water.shares").cast("double")
    )
    return stopped.withColumn("water", water).select("source", "source_size", target.alias("target"))


def mix(
    df: DataFrame,
    *,
    weights: Sequence[int] = (1, 2, 3),
    epochs: int = 3,
    seed: int = SEED,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per document: key, source, digest, size, source_size, target, taken.

    ``taken``: words the mix takes of the document, whole repetitions and the part of one.
    A source's ``taken`` adds up to its target but for a fraction of a word.  Null texts and
    texts without words have size 0 and take 0; a null source is a source of its own, last;
    null keys take part; equal rows follow each other in the order, so it does not matter
    which is which; an empty table gives no rows.

    One pass over the texts writes (key, source, digest, size); all later steps read that.
    """
    thin = keep(
        df.select(
            F.col(key).alias("key"), F.col(source).alias("source"), words(text).alias("size"),
            draw_digest(key, text, seed).alias("digest"),
        ),
        "mix-sizes",
    )
    digits = min(4, max(1, math.ceil(math.log(max(thin.count(), 1) / RUN_ROWS + 1, 16))))
    thin = thin.withColumn("run", F.substring("digest", 1, digits))
    runs = keep(thin.groupBy("source", "run").agg(F.sum("size").alias("run_size")), "mix-runs")
    targets = water_fill(runs.groupBy("source").agg(F.sum("run_size").alias("source_size")), weights, epochs)
    earlier = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("source", "run", F.coalesce(F.sum("run_size").over(earlier), F.lit(0)).alias("start"))
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(starts["*"], "source_size", "target")

    within = Window.partitionBy("source", "run").orderBy("digest", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = thin.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = placed["source"].eqNullSafe(starts["source"]) & (placed["run"] == starts["run"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    more = F.col("target") - F.col("whole") * F.col("source_size") - F.col("before") - F.col("start")
    again = F.when(more >= F.col("size"), F.col("size")).when(more > 0, F.floor(more)).otherwise(F.lit(0))
    return (
        placed.join(starts, same)
        .select(placed["*"], "start", "source_size", "target", whole.alias("whole"))
        .select(
            F.col("key").alias(key), F.col("source"), "digest", "size", "source_size", "target",
            (F.col("whole") * F.col("size") + again).cast("bigint").alias("taken"),
        )
    )


def repeated(df: DataFrame, **options) -> DataFrame:
    """The mixture as rows: each document as often as the mix takes it, to the nearest whole time.

    Rows come in the columns of ``df``; documents taken less than half a time go.  What is
    taken once more than the others of its source is a prefix of the digest order, so a row
    per source (whole times, last digest) decides and the texts are not shuffled.  Equal rows
    share a digest and go together.  Documents without words have no share in a mixture by
    words and stay once.
    """
    key, text, source = options.get("key", "doc_id"), options.get("text", "text"), options.get("source", "source")
    sized = F.col("size") > 0
    whole = F.floor(F.col("target") / F.col("source_size"))
    again = 2 * (F.col("taken") - whole * F.col("size")) >= F.col("size")
    cuts = (
        mix(df, **options)
        .filter(sized)
        .groupBy(F.col(source).alias("_source"))
        .agg(F.max(whole).cast("int").alias("_whole"), F.max(F.when(again, F.col("digest"))).alias("_cut"))
    )
    cuts = keep(cuts, "mix-cuts")
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    joined = df.join(cuts, df[source].eqNullSafe(F.col("_source")), "left")
    once_more = F.coalesce(draw_digest(key, text, options.get("seed", SEED)) <= F.col("_cut"), F.lit(False)).cast("int")
    times = F.when(words(text) > 0, F.col("_whole") + once_more).otherwise(1)
    return (
        joined.withColumn("_times", times)
        .filter(F.col("_times") > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .select(*df.columns)
    )


def mixed_sizes_sql(weights: Sequence[int] = (1, 2, 3), epochs: int = 3, seed: int = SEED, table: str = "documents") -> str:
    """DuckDB SQL for ``mix``: doc_id, size, source_size, target, taken; the loop as a recursion."""
    picks = ", ".join(map(str, weights))
    return f"""
with recursive sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
         md5(concat_ws(':', '{seed}', cast(doc_id as varchar), md5(coalesce(text, '')))) as digest
  from {table}),
sources as (
  select source, sum(size)::hugeint as source_size,
         [{picks}][(row_number() over (order by source is null, source) - 1) % {len(weights)} + 1]::hugeint as weight
  from sized group by source),
filling as (
  select 0 as step, source, source_size, weight, false as stopped,
         (select sum(source_size) from sources)::hugeint as level_left,
         (select sum(weight) from sources)::hugeint as level_shares
  from sources
  union all
  select step + 1, source, source_size, weight, now_stopped,
         (sum(source_size) over () - sum(case when now_stopped then {epochs} * source_size else 0 end) over ())::hugeint,
         sum(case when now_stopped then 0 else weight end) over ()::hugeint
  from (select *, stopped or {epochs} * source_size * level_shares <= level_left * weight as now_stopped from filling)
  where step <= (select count(*) from sources)),
targets as (
  select source, source_size,
         case when stopped then ({epochs} * source_size)::double
              else (weight * level_left)::double / level_shares::double end as target
  from filling where step = (select max(step) from filling)),
placed as (
  select s.*, t.source_size, t.target,
         case when t.source_size > 0 then floor(t.target / t.source_size::double) else 0 end as whole,
         coalesce(sum(s.size) over (partition by s.source order by substr(s.digest, 1, 16), s.doc_id, s.size
           rows between unbounded preceding and 1 preceding), 0)::double as before
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size::bigint as source_size, target,
       (whole * size + case when target - whole * source_size::double - before >= size then size
                            when target - whole * source_size::double - before > 0
                            then floor(target - whole * source_size::double - before)
                            else 0 end)::bigint as taken
from placed"""
