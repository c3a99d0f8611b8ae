"""Relational operators: facets, semi and anti joins, top-1 lookups, paging, ranks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT_DEFAULT, LIMIT_MAX, OFFSET_MAX = 50, 100, 10_000


def conjunction(conditions: Iterable[Column | None]) -> Column:
    """AND of the given conditions; those not asked for are None."""
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out


def like_contains(c: Column, text: str) -> Column:
    """ASCII-case-insensitive substring test; the text's own wildcards are ordinary characters."""
    ascii_lower = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.contains(ascii_lower(c), ascii_lower(F.lit(text)))


def semi_any(left: DataFrame, right: DataFrame, key: str, right_keys: list[str]) -> DataFrame:
    """Rows of left whose key equals any of right_keys: one equi semi join on the exploded endpoints, no nested loop."""
    ends = right.select(F.explode(F.array(*right_keys)).alias("__end")).filter("__end IS NOT NULL").distinct()
    return left.join(ends, left[key] == F.col("__end"), "left_semi")


def anti_any(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of left without a row of right that agrees on any of keys (left -> right): one equi anti join for each, since not (A or B) is not A and not B."""
    for mine, theirs in keys.items():
        side = right.select(F.col(theirs).alias("__key")).filter("__key IS NOT NULL").distinct()
        left = left.join(side, left[mine] == F.col("__key"), "left_anti")
    return left


def unexpired(rows: DataFrame, column: str, as_of: Column) -> DataFrame:
    return rows.filter(F.col(column).isNull() | (F.col(column) > as_of))


def latest(rows: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """key and the columns of keep from its greatest row by order: one partial aggregation, no window."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("__best"))
    return best.select(key, *[F.col(f"__best.{k}").alias(k) for k in keep])


def clamp_page(limit: int | None, offset: int | None) -> tuple[int, int]:
    return min(LIMIT_MAX, max(1, limit or LIMIT_DEFAULT)), min(OFFSET_MAX, max(0, offset or 0))


def page(rows: DataFrame, order: list[Column], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page of rows with the total: a count joined as one row, so the rows are never drawn into one task."""
    limit, offset = clamp_page(limit, offset)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def distinct_text(rows: DataFrame, key: str, column: str, name: str, separator: str) -> DataFrame:
    """key, name: the distinct values of column in order, joined."""
    return rows.select(key, column).distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(column)), separator).alias(name))
