"""Cutting a plan's lineage in the cluster's shared folder."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a local session without one gets its own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), f"heddle-checkpoints-{uuid.uuid4().hex}")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed and read from the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row.

    A filter on a column is pushed below the projection that makes it, where the column's
    expression stands for each mention of it, and theirs for each of theirs. It isn't pushed
    below a generator that makes the column.
    """
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("__once")
    return df.select("*", made).select(*[c for c in df.columns if c not in columns], "__once.*")


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, sizes and times of the files under paths: another one when a table was written again."""
    seen = []
    for path in sorted(paths):
        where, fs = file_system(spark, path)
        files = fs.listFiles(where, True)
        while files.hasNext():
            s = files.next()
            seen.append(f"{path}|{s.getPath().getName()}|{s.getLen()}|{s.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()
