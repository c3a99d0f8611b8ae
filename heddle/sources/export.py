"""CSV export and backup snapshots with checksums."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT_ROWS = 1000


def neutral(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula starts with an apostrophe."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_cell(c: Column) -> Column:
    """Quoted, quotes doubled; null is an empty cell."""
    return F.concat(F.lit('"'), F.replace(neutral(F.coalesce(c.cast("string"), F.lit(""))), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_document(rows: DataFrame, columns: list[str], limit: int = EXPORT_ROWS) -> str:
    """A small CSV file as text: BOM, CRLF, at most limit rows in their order."""
    head = ",".join(f'"{c}"' for c in columns)
    lines = rows.limit(limit).select(F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns]).alias("line")).collect()
    return "﻿" + "\r\n".join([head, *[r.line for r in lines]]) + "\r\n"


# fixed values: columns of the exports
SELLER_COLUMNS = ["id", "canonical_name", "legal_name", "country_code", "province", "city", "official_domain", "identity_confidence", "quality_score", "status", "last_seen_at"]
CONTACT_COLUMNS = ["id", "seller_id", "seller_name", "contact_type", "display_value_masked", "classification", "confidence", "status", "last_seen_at"]


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A CSV folder of any size: each file with BOM and header, CRLF, all cells quoted; formula-safe."""
    columns = columns or rows.columns
    lines = rows.select(F.concat_ws(",", *[csv_cell(F.col(c).cast("string")) for c in columns]).alias("value"))
    head = "\ufeff" + ",".join(f'"{c}"' for c in columns)

    def with_head(batches):
        first = True
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([head] if first else [], pa.string()), batch.column(0).cast(pa.string())])], names=["value"])
                first = False

    lines.mapInArrow(with_head, "value string").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Rows as lines of JSON; a run's earlier output is replaced."""
    rows.write.mode("overwrite").json(path)


def snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write tables as Parquet under path, in order, and return the manifest: table, file, bytes, sha256."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return manifest(spark, path, list(tables))


def manifest(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{path}/{n}" for n in names])
    return files.select(F.element_at(F.split("path", "/"), -2).alias("table"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def restore(spark: SparkSession, path: str, expected: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """The tables, after their files' checksums have been compared with the manifest."""
    now = manifest(spark, path, names)
    odd = expected.join(now, ["table", "file", "sha256"], "left_anti").limit(1).count() + now.join(expected, ["table", "file", "sha256"], "left_anti").limit(1).count()
    if odd:
        raise ValueError("snapshot files differ from the manifest")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
