"""Shared folder, intermediate tables and small helpers of the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Characters that separate words: space and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
#: One word, for Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    Where it is unset a local session, whose executor sees the driver's disk, gets a folder
    of its own; on a cluster that is an error, since other machines couldn't read it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), f"heddle-shared-{uuid.uuid4().hex}")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def scope():
    """Notes what is put into the shared folder inside: a list of paths, for one who deletes what was only needed on the way."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/heddle/{what}-{uuid.uuid4().hex}"
    for held in _scopes[-1:]:
        held.append(path)
    return path


#: Spark's setting to remove the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: what follows doesn't recompute it, whoever is lost.

    The shuffle files of the writing job are removed with it, since nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Delete a table that stored() wrote, when nothing reads it any more."""
    discard(df.sparkSession, df.stored_at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
