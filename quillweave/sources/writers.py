"""Writers: JSONL, JSONL trees, published Parquet."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.operators.gate import PAIR_COLUMNS, check_columns


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder, removed at exit, if Spark runs on one machine;
    on a cluster that is an error, since every executor would write to its own disk.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="quillweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def staged(df: DataFrame, label: str = "staged") -> DataFrame:
    """``df`` written to the shared folder once and read back; the folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark._jvm.org.apache.hadoop.fs.Path(path)
    stored.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(stored)
    return spark.read.schema(df.schema).parquet(path)


def write_jsonl(df: DataFrame, path: str, *, mode: str = "errorifexists") -> str:
    """Raw UTF-8 JSON lines; null fields are written."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path


def save_pairs(
    df: DataFrame,
    root: str,
    subset: str,
    *,
    split: str = "train",
    columns=PAIR_COLUMNS,
    mode: str = "errorifexists",
) -> str:
    """A checked pair table as ``<root>/<subset>/<split>.jsonl``."""
    check_columns(df, columns)
    return write_jsonl(df, f"{root}/{subset}/{split}.jsonl", mode=mode)


def write_jsonl_tree(df: DataFrame, root: str, *, mode: str = "errorifexists") -> str:
    """All subsets and splits in one job: ``subset=<subset>/split=<split>/`` folders."""
    df.write.mode(mode).option("ignoreNullFields", "false").partitionBy("subset", "split").json(root)
    return root


def publish(
    df: DataFrame,
    root: str,
    *,
    rows_per_file: int = 1_000_000,
    rebalance: bool = False,
    mode: str = "errorifexists",
) -> str:
    """Parquet partitioned by subset and split, in one job.

    Without a shuffle by default.  Where every task holds rows of many subsets that makes
    many small files; ``rebalance`` gathers rows by subset and split first, and splits
    those that are larger than the advisory size, so one large subset is not one task.
    """
    if rebalance:
        df = df.hint("rebalance", F.col("subset"), F.col("split"))
    (
        df.write.mode(mode)
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("subset", "split")
        .parquet(root)
    )
    return root


# ---- split shards ------------------------------------------------------------------------
#: bytes of Parquet that a shard holds on average at most
SHARD_BYTES = 64 << 20


def write_split_shards(df: DataFrame, root: str, split: str, shards: int, *, shard_bytes: int = SHARD_BYTES) -> str:
    """Rows dealt evenly over ``<root>/<split>-<i>-of-<n>.parquet``, with an index of the shards' rows.

    A shard is one file and so one task's work: ``n`` is ``shards``, or more where they would hold over
    ``shard_bytes`` each.  The rows are written as they come, which tells their bytes, and dealt out from
    there, so the input is computed once.  The files are then renamed, and the index
    ``<root>/_shards/<split>`` comes last, so shards without an index are a write that did not end.
    """
    spark = df.sparkSession
    paths = spark._jvm.org.apache.hadoop.fs.Path
    files = paths(root).getFileSystem(spark._jsc.hadoopConfiguration())
    loose, folder = (f"{root}/_staging-{uuid.uuid4().hex}" for _ in range(2))
    df.write.parquet(loose)
    shards = max(shards, -(-files.getContentSummary(paths(loose)).getLength() // shard_bytes))
    spark.read.schema(df.schema).parquet(loose).repartition(shards).write.option("parquet.enable.summary-metadata", "false").parquet(folder)
    files.delete(paths(loose), True)
    parts = sorted(str(x.getPath().getName()) for x in files.listStatus(paths(folder)) if x.getPath().getName().startswith("part-"))
    rows = {r["f"]: r["count"] for r in spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("f")).count().collect()}
    index = []
    for i in range(shards):
        name = f"{split}-{i:05d}-of-{shards:05d}.parquet"
        if i < len(parts):
            files.rename(paths(f"{folder}/{parts[i]}"), paths(f"{root}/{name}"))
        else:  # fewer rows than shards
            empty = f"{folder}-{i}"
            df.limit(0).coalesce(1).write.parquet(empty)
            (part,) = [x.getPath() for x in files.listStatus(paths(empty)) if x.getPath().getName().startswith("part-")]
            files.rename(part, paths(f"{root}/{name}"))
            files.delete(paths(empty), True)
        index.append((name, i, shards, rows.get(parts[i], 0) if i < len(parts) else 0))
    files.delete(paths(folder), True)
    spark.createDataFrame(index, "file string, shard int, shards int, rows bigint").coalesce(1).write.mode("overwrite").json(f"{root}/_shards/{split}")
    return root


# ---- replacing a part of what is published ------------------------------------------------
def republish(df: DataFrame, root: str, *, rows_per_file: int = 1_000_000) -> str:
    """Replace just the subsets and splits that ``df`` holds; all others stay as they are.

    Spark stages the files and moves them at the end of the job, partition by partition (dynamic
    partition overwrite): a job that fails leaves the old rows.  Can be run again.
    """
    (
        df.hint("rebalance", F.col("subset"), F.col("split"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file)
        .partitionBy("subset", "split").parquet(root)
    )
    return root


def _digests(df: DataFrame) -> DataFrame:
    """Rows and an order-free digest of each subset and split."""
    others = sorted(c for c in df.columns if c not in ("subset", "split"))
    return df.groupBy("subset", "split").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*others)).alias("digest"))


def write_manifest(df: DataFrame, root: str) -> str:
    """What ``df`` published, as rows and digests of its subsets and splits, beside the table; replaces the entries of just those."""
    (
        _digests(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("subset", "split").parquet(f"{root}/_manifest")
    )
    return root


def unlike_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Subsets and splits whose rows are not what the manifest says: ``subset``, ``split``, ``rows``, ``rows_there``."""
    there = _digests(spark.read.option("basePath", root).parquet(root)).withColumnsRenamed({"rows": "rows_there", "digest": "digest_there"})
    said = spark.read.parquet(f"{root}/_manifest")
    both = said.join(there, ["subset", "split"], "full")
    same = F.col("rows").eqNullSafe(F.col("rows_there")) & F.col("digest").eqNullSafe(F.col("digest_there"))
    return both.filter(~same).select("subset", "split", "rows", "rows_there")


# ---- shuffled order ----------------------------------------------------------------------
def write_in_order(ranked: DataFrame, root: str, *, rank: str = "rank", rows_per_file: int = 1_000_000) -> str:
    """A table in the order of its dense 0-based ``rank``: folder ``block=i`` holds ranks i*B to (i+1)*B-1, sorted.

    The rank itself says where a row belongs, so no pass samples bounds; rows are sorted inside blocks only.
    """
    placed = ranked.withColumn("block", F.floor(F.col(rank) / rows_per_file).cast("bigint"))
    placed.repartition("block").sortWithinPartitions("block", rank).write.partitionBy("block").parquet(root)
    return root


# ---- lines of JSON, good and bad ----------------------------------------------------------
def sort_jsonl(spark: SparkSession, path: str, schema: str, root: str) -> str:
    """Every line of JSON files once, by ``status``: rows that parse, and what is wrong with the others.

    One parse and one write, partitioned by ``status``: ``row`` (the fields), ``broken`` (no JSON of the
    schema), ``not_utf8``, ``byte_order_mark``; ``file`` and, for all but rows, the raw ``line`` (bytes) are kept.
    Blank lines and ``null`` are nothing.
    """
    from quillweave.functions.text import strip
    from quillweave.sources.readers import read_lines

    broken = "_broken"
    lines = read_lines(spark, path).select("value", strip(F.col("value")).alias("line"), "file")
    lines = lines.filter("line <> '' and line <> 'null'")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}
    parsed = lines.select("value", "file", F.from_json("line", f"{schema}, {broken} string", options).alias("_row"))
    status = (
        F.when(~F.call_function("is_valid_utf8", "value"), "not_utf8")
        .when(F.col("value").startswith("\ufeff"), "byte_order_mark")
        .when(F.col("_row").isNull() | F.col(f"_row.{broken}").isNotNull(), "broken")
        .otherwise("row")
    )
    told = parsed.select(status.alias("status"), "file", "value", "_row").select(
        "status", "file", F.when(F.col("status") != "row", F.col("value").cast("binary")).alias("line"), F.when(F.col("status") == "row", F.col("_row").dropFields(broken)).alias("row")
    )
    told.write.partitionBy("status").parquet(root)
    return root
