"""What the two vector searches share: usable vectors, and best-k lists with defined ties."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillweave.llm.common import ship

FOUND = "query_id bigint, vec_id bigint, score {kind}"


def usable(vector: str) -> Column:
    """Not null and without null, NaN or infinite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v: array<double>, dim) of the rows that take part; a null id takes no part."""
    ship(df.sparkSession)
    kept = df.filter(F.col(key).isNotNull() & usable(vector))
    return kept.select(
        F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("dim")
    )


def matrix(table: pa.Table, column: str = "v") -> np.ndarray:
    """Vectors of equal length as rows of a matrix."""
    values = table.column(column).combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = values.chunk(0) if values.num_chunks else pa.array([], values.type)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores, ties to smaller ids; an id that occurs again counts once."""
    if len(ids) > 4 * k:  # what is below the k-th distinct id's score can't be among them
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= floor
        if len(np.unique(ids[keep])) >= k:
            ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], scores[first]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query from the best of its parts, with ``rank`` from 1."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
