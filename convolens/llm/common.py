"""Small helpers shared by the text operators: scratch tables, table reading and byte hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed value: the six characters [\x20\x09-\x0D]
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: where our own folder is kept in a session without spark.checkpoint.dir, which cannot be set later
_OWN = "spark.convolens.scratch.dir"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that all executors share.

    ``spark.checkpoint.dir`` is read from the session. A folder of our own is set only where it is
    unset and all tasks run on this machine; a cluster without it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="convolens-")
        spark.conf.set(_OWN, root)
    return f"{root.rstrip('/')}/convolens/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage so that later passes do not repeat the work, and survives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and that nothing will read any more."""
    files = df.inputFiles()
    if files:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def other_columns(df: DataFrame) -> Column:
    """All columns but ``text`` as one struct ``_row``, so that columns an operator adds can bear any name."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "text"]).alias("_row")


def row_columns(columns: list[str]) -> list[Column]:
    """The ``columns`` again, from ``_row`` and ``text``."""
    return [F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in columns]


def parallelism(spark: SparkSession) -> int:
    """How many partitions a shuffle of a whole table gets."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def polynomial(values: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of ``width`` consecutive unsigned 64-bit values, scrambled."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(base) + values[k : k + n]
    return mix64(out)


def ascii_lower_column(column):
    """Lower-case A-Z only, in the JVM."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """An Arrow batch of ``schema`` from lists or arrays."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
