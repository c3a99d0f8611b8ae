"""Upserts, insert-only writes, chunks and rejects over snapshots, with a policy for each column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: last: the newest row's value, null included. first: the oldest row's. keep: the oldest value that isn't null. sum: added up.
POLICIES = ("last", "first", "keep", "sum")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policy: dict[str, str] | None = None, order: str | None = None, default: str = "last", sticky: dict[str, Column] | None = None) -> DataFrame:
    """old with the rows of new merged in by keys, one row for each key.

    old stands before new; order (a column of new) arranges several new rows of a key.
    sticky: column -> condition on the old row under which its value stays whatever comes.
    One shuffle on the keys with partial aggregation; no join of the two sides.
    """
    policy = policy or {}
    at = F.col(order) if order else F.lit(0)
    both = old.withColumn("__turn", F.struct(F.lit(0).alias("side"), F.lit(None).cast(new.schema[order].dataType if order else "int").alias("at"))).unionByName(
        new.select(*old.columns, F.struct(F.lit(1).alias("side"), at.alias("at")).alias("__turn"))
    )
    out = []
    for c in old.columns:
        if c in keys:
            continue
        how = policy.get(c, default)
        last = F.max_by(F.struct(c), "__turn")[c]
        first = F.min_by(F.struct(c), "__turn")[c]
        if how == "first":
            value = first
        elif how == "keep":
            value = F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__turn")))
        elif how == "sum":
            value = F.sum(c)
        else:
            value = last
        if sticky and c in sticky:
            held = F.max(F.when((F.col("__turn.side") == 0) & sticky[c], F.struct(c)))
            value = F.when(held.isNotNull(), held[c]).otherwise(value)
        out.append(value.alias(c))
    return both.groupBy(*keys).agg(*out).select(*old.columns)


def insert_only(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """old and those rows of new (columns) whose key it lacks, of several the first by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = new.join(old.select(*keys), keys, "left_anti").withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
    return old.unionByName(fresh.select(*columns) if columns else fresh)


def chunks(rows: DataFrame, group: str, order: list[Column], size: int) -> DataFrame:
    """rows with chunk: numbers from 0 within group, size rows each."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def classify_ingest(seen: DataFrame, batch: DataFrame, key: str, digest: str, order: list[str]) -> DataFrame:
    """batch with receipt: new (the first of its key by order, and the key wasn't seen), else duplicate (the digest that was applied) or conflict (another one)."""
    known = seen.select(F.col(key).alias("__key"), F.col(digest).alias("__digest"))
    w = Window.partitionBy(key).orderBy(*order)
    both = batch.withColumn("__k", F.row_number().over(w)).withColumn("__first", F.first(digest).over(w)).join(known, F.col(key) == F.col("__key"), "left")
    applied = F.coalesce("__digest", "__first")
    receipt = F.when(F.col("__key").isNull() & (F.col("__k") == 1), "new").when(applied == F.col(digest), "duplicate").otherwise("conflict")
    return both.withColumn("receipt", receipt).drop("__key", "__digest", "__k", "__first")
