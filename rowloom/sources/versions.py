"""Versions of tables, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

#: Rows of a part file of a version, at least: of a small one and of a large one.
FEW_ROWS, PART_ROWS = 25_000, 1_000_000


class Version(NamedTuple):
    """A written frame and its folder."""

    frame: DataFrame
    path: str


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and all runs on this machine, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rowloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def parts(rows: int) -> int:
    """Part files of a version: one for FEW_ROWS each up to some hundred, then one for PART_ROWS each."""
    return max(1, min(rows // FEW_ROWS, 200), rows // PART_ROWS)


def settle(df: DataFrame, rows: int) -> Version:
    """Write ``df`` (of about ``rows`` rows) as Parquet and read it back: the lineage ends here, and executors may go."""
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    df.coalesce(parts(rows)).write.parquet(path)
    return Version(spark.read.schema(df.schema).parquet(path), path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a version's folder."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
