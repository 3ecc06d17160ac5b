"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names the folder.  Where it is unset and everything runs
on one machine, as in tests, a folder of our own is made and set.  A stashed table is plain Parquet:
it is complete once written, so a lost executor never costs more than the stage
that is running.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_live: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all processes of the application."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rowloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _live.append((spark, path))
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; cuts the lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete one stashed folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target.getFileSystem(conf).delete(target, True)
    _live[:] = [x for x in _live if x[1] != path]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that end inside go when their query does, not at the driver's next collection of garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def result_only(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions with narrow results: write the result, then delete what was stashed on the way."""

    @functools.wraps(make)
    def run(*args, **kwargs) -> DataFrame:
        before = {path for _, path in _live}
        out = stash(make(*args, **kwargs), make.__name__)
        kept = _live[-1][1]
        for spark, path in list(_live):
            if path not in before and path != kept:
                drop(spark, path)
        return out

    return run


def release_all() -> None:
    """Delete every stashed folder; call it once earlier results are consumed."""
    for spark, path in list(_live):
        drop(spark, path)


def salts(spark: SparkSession) -> int:
    """Shares into which the rows of one key are dealt: several for each task of a shuffle, however many those are."""
    return max(96, 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def unique() -> str:
    return uuid.uuid4().hex[:12]
