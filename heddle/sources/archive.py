"""Archive by age: months of a live table move to an archive, and come back verified.

A month's rows are written to the archive first (dynamic overwrite of that month alone),
then the month's manifest with row count and checksum of each file, then the files are read
again and compared with it; only then is the month deleted from the live table. Whatever
breaks off in between, the month is still there, and the next run does it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.lineage import file_system

MANIFEST = "month string, file string, bytes long, sha256 string, rows long"


def write_live(rows: DataFrame, at: str, path: str) -> None:
    """rows as a table in folders by the month of at; months that rows have are replaced."""
    rows.withColumn("month", F.date_format(at, "yyyy-MM")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def months(spark: SparkSession, path: str) -> list[str]:
    where, fs = file_system(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n.split("=", 1)[1] for n in found if n.startswith("month="))


def _files(spark: SparkSession, path: str, month: str) -> DataFrame:
    """The month's files as they are now."""
    where = f"{path}/month={month}"
    sums = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(where)
    sums = sums.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    rows = spark.read.parquet(where).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.count("*").alias("rows"))
    return sums.join(rows, "file", "left").select(F.lit(month).alias("month"), "file", "bytes", "sha256", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def verify(spark: SparkSession, archive: str, month: str) -> bool:
    """Whether the archive's files of a month are those of its manifest."""
    where, fs = file_system(spark, f"{archive}/manifest/month={month}/_SUCCESS")
    if not fs.exists(where) or month not in months(spark, f"{archive}/rows"):
        return False
    told = spark.read.parquet(f"{archive}/manifest/month={month}").select("file", "bytes", "sha256", "rows")
    seen = _files(spark, f"{archive}/rows", month).select("file", "bytes", "sha256", "rows")
    return not told.exceptAll(seen).union(seen.exceptAll(told)).limit(1).count()


def archive_before(spark: SparkSession, live: str, archive: str, before: str, step=lambda what, month: None) -> list[str]:
    """Move the months before a month (yyyy-MM) out of the live table; those that were moved. step is told what is about to be done."""
    moved = []
    for month in [m for m in months(spark, live) if m < before and m[:1].isdigit()]:
        step("rows", month)
        rows = spark.read.parquet(f"{live}/month={month}")
        rows.withColumn("month", F.lit(month)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{archive}/rows")
        step("manifest", month)
        _files(spark, f"{archive}/rows", month).drop("month").coalesce(1).write.mode("overwrite").parquet(f"{archive}/manifest/month={month}")
        step("verify", month)
        if not verify(spark, archive, month) or spark.read.parquet(f"{archive}/rows/month={month}").count() != rows.count():
            raise ValueError(f"the archive of {month} is not what was written")
        step("delete", month)
        where, fs = file_system(spark, f"{live}/month={month}")
        fs.delete(where, True)
        moved.append(month)
    return moved


def restore(spark: SparkSession, archive: str, month: str) -> DataFrame:
    """A month's rows out of the archive, after its files have been compared with the manifest."""
    if not verify(spark, archive, month):
        raise ValueError(f"the archive of {month} differs from its manifest")
    return spark.read.parquet(f"{archive}/rows/month={month}")
