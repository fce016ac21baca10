"""What the operators share: tables, whole texts, and tables written to the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application: their Python workers import it."""
    key = spark.sparkContext.applicationId
    if key in _SHIPPED:
        return
    _SHIPPED.add(key)
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="quillweave-code-")  # Spark serves the file from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{package.name}.zip", "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(f"{folder}/{package.name}.zip")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of an installed public vocabulary; only queries that take one need the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_text(name: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a folder of our own only on one machine.

    Raises ``ValueError`` on a cluster that names none, since executors and driver would
    each write to a disk of their own there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = tempfile.mkdtemp(prefix="quillweave-")
        atexit.register(shutil.rmtree, _OWN[key], ignore_errors=True)
    return f"file://{_OWN[key]}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and no executor's loss undoes it.

    What was written goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark._jvm.org.apache.hadoop.fs.Path(path)
    stored.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(stored)
    return spark.read.schema(df.schema).parquet(path)


def text_rows(batches: Iterator[pa.RecordBatch], step: int = 512) -> Iterator[tuple[list, list]]:
    """Lists of (keys, texts) of two-column batches, ``step`` rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()
