"""Approximate nearest neighbours by balanced posting lists.

* **Centroids** are fitted on a bounded sample (``SAMPLE`` vectors, fewer for long ones) by
  spherical k-means with a penalty on crowded clusters, one for ``LIST_ROWS`` vectors up to
  ``MOST_LISTS``.
* Every vector is posted to its nearest list and, near a boundary, to further ones whose
  distance is within ``spread`` times the nearest (at most ``copies``).
* **Centroids are searched by an in-memory graph**: near neighbours with long links pruned,
  walked best-first with a beam.
* **Distance-ratio pruning**: a query visits the lists whose centroid is within ``reach``
  times its nearest centroid's distance.
* Lists are **balanced** by parts: one with more than ``PART_ROWS`` postings is dealt over
  parts by hash, so a vector that a third of the rows share is no hot group.

Candidates are scored by exact cosine in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillweave.llm.vectors import FOUND, best, matrix, ranked, vectors

#: vectors that the centroids are fitted on, and components of all of them together
SAMPLE, SAMPLE_COMPONENTS = 16_384, 4_194_304
LIST_ROWS = 256
LEAST_LISTS, MOST_LISTS = 8, 2048
PART_ROWS = 1024
#: links of a centroid in the graph
LINKS = 16


def unit_rows(rows: np.ndarray) -> np.ndarray:
    peak = np.abs(rows).max(axis=1, keepdims=True, initial=0.0)
    peak[peak == 0] = 1.0
    rows = rows / peak  # squares of very large or small components stay in range
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    norm[norm == 0] = 1.0
    return rows / norm


def fit_centroids(rows: np.ndarray, lists: int, rounds: int = 8, penalty: float = 0.1) -> np.ndarray:
    """Balanced spherical k-means of unit vectors in a given (seeded) order; equal rows count once."""
    _, first = np.unique(rows.round(6), axis=0, return_index=True)
    rows = rows[np.sort(first)]
    lists = min(lists, len(rows))
    centroids = rows[:lists].copy()
    crowd = np.ones(lists)
    for _ in range(rounds):
        near = np.argmax(rows @ centroids.T - penalty * (crowd - 1)[None, :], axis=1)
        counts = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, rows)
        alone = counts == 0
        centroids = unit_rows(np.where(alone[:, None], centroids, sums))
        crowd = 0.5 * crowd + 0.5 * np.minimum(counts / max(len(rows) / lists, 1), 4)
    return centroids


class CentroidGraph:
    """Centroids with links to near ones; a link is left out where a kept neighbour is nearer to its end."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        n = len(centroids)
        links = [set() for _ in range(n)]
        like = centroids @ centroids.T
        for i in range(n):
            kept: list[int] = []
            for j in np.argsort(-like[i], kind="stable")[: 6 * LINKS]:
                if j != i and all(like[i, j] >= like[j, h] for h in kept):
                    kept.append(int(j))
                    if len(kept) == LINKS:
                        break
            for j in kept:
                links[i].add(j)
                links[j].add(i)
            links[i].add((i + 1) % n)  # a ring keeps the graph connected
        width = max(map(len, links), default=1)
        self.links = np.full((n, width), -1)
        for i, s in enumerate(links):
            self.links[i, : len(s)] = sorted(s)
        self.entry = int(np.argmax(like.sum(axis=1))) if n else 0

    def nearest(self, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of about the ``width`` nearest centroids of unit rows, nearest first.

        Best-first walks of all rows side by side: each step opens every row's best centroid
        that is not open yet, until each row's beam is open throughout.
        """
        n, b = len(self.centroids), len(rows)
        width = min(width, n)
        seen = np.zeros((b, n), bool)
        ids = np.full((b, width), -1)
        cos = np.full((b, width), -np.inf)
        opened = np.ones((b, width), bool)
        seen[:, self.entry] = True
        ids[:, 0], cos[:, 0], opened[:, 0] = self.entry, rows @ self.centroids[self.entry], False
        active = np.arange(b)
        while len(active):
            waiting = np.where(opened[active], -np.inf, cos[active])
            at = waiting.argmax(axis=1)
            go = waiting[np.arange(len(active)), at] > -np.inf
            active, at = active[go], at[go]
            if not len(active):
                break
            opened[active, at] = True
            new = self.links[ids[active, at]]
            fresh = (new >= 0) & ~seen[active[:, None], new]
            seen[active[:, None], np.where(new >= 0, new, self.entry)] = True
            near = np.einsum("bd,bld->bl", rows[active], self.centroids[np.maximum(new, 0)])
            near = np.where(fresh, near, -np.inf)
            all_ids = np.concatenate([ids[active], np.where(fresh, new, -1)], axis=1)
            all_cos = np.concatenate([cos[active], near], axis=1)
            all_open = np.concatenate([opened[active], ~fresh], axis=1)
            best_first = np.argsort(-all_cos, axis=1, kind="stable")[:, :width]
            ids[active] = np.take_along_axis(all_ids, best_first, axis=1)
            cos[active] = np.take_along_axis(all_cos, best_first, axis=1)
            opened[active] = np.take_along_axis(all_open, best_first, axis=1)
        return ids, cos


def _distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cos, 0))


def posted(graph: CentroidGraph, rows: np.ndarray, copies: int, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) postings: the nearest list, and those near enough to be across a boundary."""
    ids, cos = graph.nearest(rows, max(4 * copies, 16))
    far = _distance(cos)
    near = (far <= spread * far[:, :1] + 1e-12) & (ids >= 0)
    near[:, copies:] = False
    near[:, 0] = True
    row, at = np.nonzero(near)
    return row, ids[row, at]


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each row's the same wherever it stands."""
    scale_q = np.abs(query).max()
    scale = np.abs(rows).max(axis=1, keepdims=True)
    query, rows = (query / scale_q, rows / scale) if not (1e-100 < scale_q < 1e100 and ((scale > 1e-100) & (scale < 1e100)).all()) else (query, rows)
    product = (rows * query[None, :]).sum(axis=1)
    return product / np.sqrt((rows * rows).sum(axis=1) * (query * query).sum())


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    copies: int = 4,
    spread: float = 1.15,
    reach: float = 1.3,
    share: float = 0.5,
) -> DataFrame:
    """query_id, rank, vec_id, score (cosine): each query's ``k`` nearest found, nearest first.

    ``is_query`` is a condition on ``vec_id``.  Every row is indexed and a candidate of all
    queries but its own; ties go to the smaller id.  A query visits lists up to ``reach``
    times its nearest centroid's distance, at most ``share`` of them, and in any case as many
    as hold ``k`` candidates.  Rows with a null id, a null or zero vector or null or
    non-finite components take no part; rows that repeat an id count once, with their best
    score; vectors only meet those of their length; empty tables give no rows.
    """
    rows = vectors(df, key, vector).filter(F.exists("v", lambda x: x != 0))
    found = None
    for dim, n in [(r["dim"], r["n"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()]:
        part = _nearest_of_length(rows.filter(F.col("dim") == dim), n, dim, is_query, k, copies, spread, reach, share)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], FOUND.format(kind="double"))
    return ranked(found, k)


def _nearest_of_length(rows, n, dim, is_query, k, copies, spread, reach, share) -> DataFrame:
    spark = rows.sparkSession
    most = min(SAMPLE, max(1024, SAMPLE_COMPONENTS // max(dim, 1)))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("v").toArrow()
    sample = unit_rows(matrix(drawn)).astype(np.float32)
    lists = max(LEAST_LISTS, min(MOST_LISTS, math.ceil(n / LIST_ROWS)))
    graph = CentroidGraph(fit_centroids(sample, lists))
    shared = spark.sparkContext.broadcast(graph)  # at most MOST_LISTS centroids and their links

    def post(batches):
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                for start in range(0, table.num_rows, 1024):
                    some = table.slice(start, 1024)
                    row, at = posted(shared.value, unit_rows(matrix(some)).astype(np.float32), copies, spread)
                    out = some.take(pa.array(row))
                    first = np.r_[True, row[1:] != row[:-1]]
                    yield from pa.table({"vec_id": out.column("vec_id"), "v": out.column("v"), "list": pa.array(at, pa.int32()), "home": pa.array(first)}).to_batches()

    postings = rows.select("vec_id", "v").mapInArrow(post, "vec_id bigint, v array<double>, list int, home boolean")
    # one row per list, at most MOST_LISTS
    sizes = {r["list"]: (r["n"], r["home"]) for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.count_if("home").alias("home")).collect()}
    parts = {c: max(1, math.ceil(s[0] / PART_ROWS)) for c, s in sizes.items()}
    home = np.array([sizes.get(c, (0, 0))[1] for c in range(len(graph.centroids))])
    part_of = F.array(*[F.lit(parts.get(c, 1)) for c in range(len(graph.centroids))])
    beam = max(16, math.ceil(share * len(graph.centroids)))

    def route(batches):
        graph = shared.value
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                for start in range(0, table.num_rows, 1024):
                    some = table.slice(start, 1024)
                    unit = unit_rows(matrix(some)).astype(np.float32)
                    ids, cos = graph.nearest(unit, beam)
                    far = _distance(cos)
                    go = (ids >= 0) & (far <= reach * far[:, :1] + 1e-12)
                    held = np.cumsum(np.where(ids >= 0, home[np.maximum(ids, 0)], 0), axis=1)
                    go |= (ids >= 0) & (np.c_[np.zeros(len(ids)), held[:, :-1]] < k + 1)
                    short = np.nonzero(held[:, -1] < k + 1)[0]  # the beam's lists are too small: all lists
                    row, at = np.nonzero(go)
                    lists_of = ids[row, at]
                    if len(short):
                        keep = ~np.isin(row, short)
                        row = np.r_[row[keep], np.repeat(short, len(graph.centroids))]
                        lists_of = np.r_[lists_of[keep], np.tile(np.arange(len(graph.centroids)), len(short))]
                    out = some.take(pa.array(row))
                    yield from pa.table({"vec_id": out.column("vec_id"), "v": out.column("v"), "list": pa.array(lists_of, pa.int32())}).to_batches()

    asked = rows.filter(is_query).select("vec_id", "v").mapInArrow(route, "vec_id bigint, v array<double>, list int")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.get(part_of, F.col("list")) - 1)))
    held = postings.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.get(part_of, F.col("list"))).cast("int"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [], [], []
        if left.num_rows and right.num_rows:
            ids, all_rows = right.column("vec_id").to_numpy(), matrix(right)
            unit = unit_rows(all_rows)
            q_ids, queries = left.column("vec_id").to_numpy(), matrix(left)
            rough = unit_rows(queries) @ unit.T
            for n, q in enumerate(q_ids):
                others = np.nonzero(ids != q)[0]
                if not len(others):
                    continue
                mine = rough[n, others]
                if len(others) > 4 * k:  # repeated ids may fill the first places, so count ids
                    floor = np.partition(mine, len(mine) - k)[len(mine) - k] - 1e-9
                    near = mine >= floor
                    if len(np.unique(ids[others[near]])) >= k:
                        others = others[near]
                got, scores = best(ids[others], cosines(queries[n], all_rows[others]), k)
                found[0].append(np.full(len(got), q))
                found[1].append(got)
                found[2].append(scores)
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({c: np.concatenate([*f, e]).astype(e.dtype) for c, f, e in zip(("query_id", "vec_id", "score"), found, empty)})

    return asked.groupBy("list", "part").cogroup(held.groupBy("list", "part")).applyInArrow(meet, FOUND.format(kind="double"))
