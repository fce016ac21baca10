"""Row-level builds on a stream of JSONL files.

Masking, question/answer and reward rules are stateless column expressions, so the batch
builders run unchanged on a stream.  Exact sampling is not stateless and stays batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str, *, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def run_available(
    stream: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
) -> StreamingQuery:
    """Build all files that have arrived, write Parquet exactly once, then stop."""
    return (
        build(stream)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
