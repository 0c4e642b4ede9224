"""Tables that an operator keeps for later steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = "spark.convolens.tables.dir"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; below a folder of our own only where that is unset and all tasks run here."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="convolens-")
        spark.conf.set(_OWN, root)
    return f"{root.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back, so that several steps do not each make them again."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
