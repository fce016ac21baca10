"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into segments; with ``m`` components, mean ``a`` and deviation ``s`` of each,
an inner product is at most the sum of ``m * (a_q a_c + s_q s_c)``: the lower bound of the
distance that descends with it.  Coarse segments exclude most candidates, finer ones more,
and only the survivors' products are computed.  A candidate is excluded only when its bound
is below the k-th product found so far, so the result is exact.

Queries and candidates meet block by block: every query block with every candidate block,
each pair of blocks one group of bounded size.  Blocks are dealt by hash, so equal vectors
spread over all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillweave.llm.vectors import FOUND, best, matrix, ranked, vectors

SEGMENTS = (4, 16)
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192
LEAST_BLOCKS = 32
#: candidates looked at before the thresholds are brought up to date
CHUNK = 1024


def statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length."""
    out = []
    for part in np.array_split(rows, min(segments, max(rows.shape[1], 1)), axis=1):
        m = part.shape[1]
        if m:
            mean = part.mean(axis=1)
            out += [mean * math.sqrt(m), np.sqrt(np.maximum((part**2).sum(axis=1) - m * mean**2, 0.0))]
    return np.stack(out, axis=1) if out else np.zeros((len(rows), 1))


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, segments: tuple[int, ...] = SEGMENTS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of each query's ``k`` best among ``rows``, its own id left out.

    Whole numbers up to 2**53 in every sum are exact in double precision; larger ones are
    multiplied as Python integers.
    """
    peak = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(rows.shape[1], 1)
    exact = peak < 2**53
    big = None if exact else [[int(x) for x in r] for r in rows]
    big_queries = None if exact else [[int(x) for x in r] for r in queries]
    order = np.argsort(-(rows**2).sum(axis=1), kind="stable")  # long vectors first: high thresholds early
    ids, rows = ids[order], rows[order]
    levels = [(statistics(queries, s), statistics(rows, s)) for s in segments]
    kind = np.int64
    top: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, kind)) for _ in query_ids]
    floor = np.full(len(query_ids), -np.inf)
    for start in range(0, len(ids), CHUNK):
        at = slice(start, start + CHUNK)
        alive = ids[at][None, :] != query_ids[:, None]
        least = floor[:, None]
        for of_queries, of_rows in levels:
            bound = of_queries @ of_rows[at].T
            alive &= bound + 1e-9 * np.abs(bound) + 1e-6 >= least
        which = np.nonzero(alive.any(axis=1))[0]
        if not len(which):
            continue
        cols = np.nonzero(alive[which].any(axis=0))[0]
        if exact:
            products = queries[which] @ rows[at][cols].T
        else:
            products = np.array(
                [[sum(map(int.__mul__, big_queries[q], big[order[start + c]])) for c in cols] for q in which], dtype=object
            )
        for n, q in enumerate(which):
            mine = alive[q, cols] & (products[n] >= floor[q])
            if not mine.any():
                continue
            new_scores = products[n][mine].astype(kind)
            top[q] = best(np.concatenate([top[q][0], ids[at][cols][mine]]), np.concatenate([top[q][1], new_scores]), k)
            if len(top[q][0]) == k:
                floor[q] = float(top[q][1][-1])
    counts = [len(t[0]) for t in top]
    return (
        np.repeat(query_ids, counts),
        np.concatenate([t[0] for t in top]) if top else np.empty(0, np.int64),
        np.concatenate([t[1] for t in top]) if top else np.empty(0, kind),
    )


def top_products(df: DataFrame, is_query: Column, k: int = 5, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (bigint): each query's ``k`` highest integer inner products.

    ``vector`` holds whole numbers.  ``is_query`` is a condition on ``vec_id``.  Candidates
    are all rows with other ids; all of them if there are fewer than ``k``; ties go to the
    smaller id.  Rows with a null id, a null vector or null or non-finite components take no
    part; rows that repeat an id count once, with their best score; vectors only meet those
    of their length; empty tables give no rows; a product beyond a long is an error.
    """
    rows = vectors(df, key, vector)
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    across = max(LEAST_BLOCKS, math.ceil(sizes["n"] / CANDIDATE_BLOCK))
    down = max(1, math.ceil(sizes["q"] / QUERY_BLOCK))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = rows.filter(is_query).withColumn("i", F.pmod(F.xxhash64("vec_id"), F.lit(down)).cast("int")).withColumn("j", every(across))
    held = rows.withColumn("j", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(across)).cast("int")).withColumn("i", every(down))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        q_ids, first = np.unique(left.column("vec_id").to_numpy(), return_index=True)
        if len(q_ids) == left.num_rows:
            groups = [(q_ids, matrix(left)[first])]
        else:  # rows that repeat a query's id are queries of their own
            groups = [(left.column("vec_id").to_numpy()[n : n + 1], matrix(left)[n : n + 1]) for n in range(left.num_rows)]
        ids, held_rows = right.column("vec_id").to_numpy(), matrix(right)
        found = [search_block(a, b, ids, held_rows, k) for a, b in groups]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))

    block = ["i", "j", "dim"]
    found = asked.groupBy(*block).cogroup(held.groupBy(*block)).applyInArrow(meet, FOUND.format(kind="bigint"))
    return ranked(found, k)


def top_products_sql(every: int = 50, k: int = 5, scale: int = 256) -> str:
    """DuckDB SQL for the products of vectors scaled and floored; every pair is computed."""
    return f"""
with usable as (
  select vec_id, [cast(floor({scale} * cast(x as double)) as bigint) for x in embedding] as v
  from embeddings
  where embedding is not null
    and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
parts as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) as p from usable),
scored as (
  select q.vec_id as query_id, c.vec_id, sum(q.x * c.x) as score
  from parts q join parts c on q.p = c.p and q.vec_id <> c.vec_id
  where q.vec_id % {every} = 0
  group by q.vec_id, c.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= {k}"""
