"""Readers: partitioned Parquet, split shards, JSONL trees, tolerant JSONL."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.functions.text import strip

#: ``<subset>/<split>.jsonl``, a file or a folder of parts
_PLACE = r"/([^/]+)/([^/]+)\.jsonl(?:/[^/]*)?$"


def _listing(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, on whatever file system the path names; sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found) if found else []


#: tables above this many bytes are never dealt out anew
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table dealt over all cores where its scan has fewer partitions than that.

    For work that is heavy per row (masking) on a file of one row group.  A table of more
    than ``SPREAD_BYTES`` is split by its scan (``spark.sql.files.maxPartitionBytes``) and
    left alone, however many cores there are.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if size > SPREAD_BYTES or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def require_paths(spark: SparkSession, *patterns: str) -> list[str]:
    found = sorted({p for pattern in patterns for p in _listing(spark, pattern)})
    if not found:
        raise FileNotFoundError(f"nothing under {', '.join(patterns)}")
    return found


def read_subset(
    spark: SparkSession,
    root: str,
    subset: str,
    split: str | None = None,
    schema: str | None = None,
) -> DataFrame:
    """One subset (and split) of a table partitioned by ``subset`` and ``split``.

    Only the subset's own folder is listed and read.  Without ``split`` all splits come
    together, told apart by the ``split`` column.
    """
    folder = f"{root}/subset={subset}"
    require_paths(spark, folder)
    reader = spark.read.option("basePath", root)
    if schema is not None:
        reader = reader.schema(f"{schema}, subset string, split string")
    df = reader.parquet(folder).where(F.col("subset") == subset)
    return df if split is None else df.where(F.col("split") == split)


def read_split_shards(spark: SparkSession, root: str, split: str, schema: str | None = None) -> DataFrame:
    """All ``<split>-*.parquet`` files anywhere under ``root``; none, or a missing one of ``-i-of-n``, is an error."""
    require_paths(spark, root)
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"{split}-*.parquet")
    if schema is not None:
        reader = reader.schema(schema)
    try:
        df = reader.parquet(root)
    except Exception as problem:  # schema inference fails on an empty listing
        if "UNABLE_TO_INFER_SCHEMA" in str(problem):
            raise FileNotFoundError(f"no parquet files of split {split!r} under {root}") from problem
        raise
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{split}-*.parquet")
    names = files.load(root).select("path")
    # by folder and number of shards: how many of them there are
    number = [F.regexp_extract("path", r"^(.*)/[^/]*-(\d+)-of-(\d+)\.parquet$", i) for i in (1, 2, 3)]
    shards = names.select(number[0].alias("folder"), number[1].try_cast("int").alias("shard"), number[2].try_cast("int").alias("shards"))
    told = shards.groupBy("folder", "shards").agg(F.count_distinct("shard").alias("there"), F.max("shard").alias("last")).collect()
    if not told:
        raise FileNotFoundError(f"no parquet files of split {split!r} under {root}")
    for r in told:
        if r["shards"] is not None and (r["there"] != r["shards"] or r["last"] != r["shards"] - 1):
            raise FileNotFoundError(f"{r['there']} of {r['shards']} shards of split {split!r} in {r['folder']}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_jsonl_tree(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Every ``<root>/<subset>/<split>.jsonl``, with ``subset`` and ``split`` columns.

    Also reads the partitioned layout written by ``write_jsonl_tree``, and both together.
    """
    require_paths(spark, root)
    require_paths(spark, f"{root}/*/*.jsonl", f"{root}/subset=*/split=*")
    plain = _listing(spark, f"{root}/*/*.jsonl")
    partitioned = _listing(spark, f"{root}/subset=*/split=*")
    parts = []
    if plain:
        # file paths are URL-encoded, in which a plus sign stands for itself
        place = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        parts.append(
            spark.read.schema(schema)
            .json(plain)
            .select(
                "*",
                F.regexp_extract(place, _PLACE, 1).alias("subset"),
                F.regexp_extract(place, _PLACE, 2).alias("split"),
            )
        )
    if partitioned:
        reader = spark.read.schema(f"{schema}, subset string, split string")
        parts.append(reader.option("basePath", root).json(partitioned))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def _marked_files(spark: SparkSession, files: list[str]) -> list[str]:
    """Those of ``files`` (URLs) that begin with a byte order mark: three bytes of each are read."""
    java = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    codecs = java.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def marked(url: str) -> bool:
        place = java.org.apache.hadoop.fs.Path(java.java.net.URI(url))
        stream = place.getFileSystem(conf).open(place)
        try:
            codec = codecs.getCodec(place)
            stream = stream if codec is None else codec.createInputStream(stream)
            return all(stream.read() == byte for byte in BYTE_ORDER_MARK)
        finally:
            stream.close()

    with ThreadPoolExecutor(16) as pool:
        return [url for url, yes in zip(files, pool.map(marked, files)) if yes]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``, ``file``: every line of text files with all of its bytes.

    Spark's text reader drops a byte order mark at the start of a file; here the first line of
    such a file gets it back.  Files without one are read as ever; a file of nothing else has no line.
    """
    text = spark.read.text(path)
    marked = _marked_files(spark, text.inputFiles())
    name = F.col("_metadata.file_name").alias("file")
    if not marked:
        return text.select("value", name)
    at = F.col("_metadata.file_path")
    # Spark writes local files in both ways
    marked += ["file:/" + url.removeprefix("file:///") for url in marked if url.startswith("file:///")]

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lines of a part of a file lie together and in order, and part 0 begins the file."""
        before = None
        for batch in batches:
            first = []
            for part in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                first.append(part != before and part[1] == 0)
                before = part
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, pa.bool_())], names=["value", "file", "first"])

    parts = text.filter(at.isin(marked)).select(F.col("value").cast("binary"), name, at.alias("at"), F.col("_metadata.file_block_start").alias("start"))
    told = parts.mapInArrow(firsts, "value binary, file string, first boolean")
    whole = F.when(F.col("first"), F.concat(F.unhex(F.lit(BYTE_ORDER_MARK.hex())), "value")).otherwise(F.col("value"))
    return text.filter(~at.isin(marked)).select("value", name).unionByName(told.select(whole.cast("string").alias("value"), "file"))


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, quarantine)``: lines that parse, and the raw lines that do not.

    Blank lines and ``null`` lines are neither.
    """
    lines = spark.read.text(path).select(strip(F.col("value")).alias("line"))
    lines = lines.filter("line <> '' and line <> 'null'")
    broken = "_broken"
    parsed = lines.select(
        "line",
        F.from_json(
            "line",
            f"{schema}, {broken} string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken},
        ).alias("_row"),
    )
    is_broken = F.col("_row").isNull() | F.col(f"_row.{broken}").isNotNull()
    return (
        parsed.filter(~is_broken).select("_row.*").drop(broken),
        parsed.filter(is_broken).select("line"),
    )
