"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: The paths that temporary() has given within each scratch() that is open.
_watched: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and all run in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def temporary(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder; what is written there is removed when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    made.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(made)
    for paths in _watched:
        paths.append(path)
    return path


#: Whether the shuffle files of a query go when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries that run within go as each of them ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives a lost executor. What was shuffled for it goes."""
    path = temporary(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _deleted(spark: SparkSession, path: str) -> None:
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def removed(table: DataFrame) -> None:
    """The files of a table that stored() gave go; nothing reads it from here on."""
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        _deleted(table.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that are stored within go at its end, but for those that the frames read which are put into the list."""
    kept: list[DataFrame] = []
    paths: list[str] = []
    _watched.append(paths)
    try:
        yield kept
        name = lambda x: x.rpartition("/")[2]
        read = {name(f.rpartition("/")[0]) for x in kept for f in x.inputFiles()}
        for path in paths:
            if name(path) not in read:
                _deleted(spark, path)
    finally:
        _watched[:] = [x for x in _watched if x is not paths]
