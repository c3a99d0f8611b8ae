"""Capacity, priorities and the state of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: shares of a capacity and what is to be done from there on
BREAKERS = [(0.9, "stop_ingestion"), (0.8, "stop_nonessential_writes"), (0.7, "archive"), (0.6, "warn")]
# fixed values: days until a seller is looked at again
CADENCE = {"high_value": 14, "active": 30, "no_contact": 45, "blocked": 90, "invalid": 180}
# fixed values: what may follow a run's state
NEXT = {
    "queued": ["starting", "cancelled", "failed"],
    "starting": ["running", "cancelled", "failed"],
    "running": ["ingesting", "enriching", "completed", "cancelled", "failed"],
    "ingesting": ["enriching", "completed", "cancelled", "failed"],
    "enriching": ["ingesting", "completed", "cancelled", "failed"],
}


def breaker(used: Column, limit: Column) -> Column:
    """What a share of a capacity asks for; null below all bounds or without a limit."""
    out = F.lit(None).cast("string")
    for share, action in reversed(BREAKERS):
        out = F.when((limit > 0) & (used >= limit * share), action).otherwise(out)
    return out


def priority(bonuses: list[Column], penalties: list[Column]) -> Column:
    """The sum of bonuses less that of penalties; nulls count nothing."""
    add = lambda cs: sum((F.coalesce(c, F.lit(0)) for c in cs), F.lit(0))
    return add(bonuses) - add(penalties)


def next_visit(kind: Column, last: Column) -> Column:
    """When a seller of a kind is due again; a suppressed one (or an unknown kind) never."""
    days = F.try_element_at(F.create_map(*[F.lit(x) for pair in CADENCE.items() for x in pair]), kind)
    return F.date_add(last, days)


def transitions(events: DataFrame) -> DataFrame:
    """events (id, run_id, state, happened) with before and allowed: whether the state may follow the one before; a run begins as queued."""
    w = Window.partitionBy("run_id").orderBy("happened", "id")
    follows = F.create_map(*[x for state, after in NEXT.items() for x in (F.lit(state), F.array(*map(F.lit, after)))])
    e = events.withColumn("before", F.lag("state").over(w))
    ok = F.when(F.col("before").isNull(), F.col("state") == "queued").otherwise(F.coalesce(F.array_contains(F.try_element_at(follows, F.col("before")), F.col("state")), F.lit(False)))
    return e.withColumn("allowed", ok)


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, old_value, new_value, change (added, removed, changed, reverified) for each field of each row of either snapshot."""
    pack = lambda side: F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]).alias(side)
    a = old.select(F.col(key).alias("__old"), pack("a"))
    b = new.select(F.col(key).alias("__new"), pack("b"))
    none = F.transform(F.array(*map(F.lit, fields)), lambda f: F.struct(f.alias("field"), F.lit(None).cast("string").alias("value")))
    j = a.join(b, F.col("__old") == F.col("__new"), "full")
    pairs = F.arrays_zip(F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    rows = j.select(F.coalesce("__old", "__new").alias(key), F.explode(pairs).alias("p")).select(key, F.col("p.a.field").alias("field"), F.col("p.a.value").alias("old_value"), F.col("p.b.value").alias("new_value"))
    change = F.when(F.col("old_value").eqNullSafe(F.col("new_value")), "reverified").when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").otherwise("changed")
    return rows.withColumn("change", change)


def rates(events: DataFrame, key: str, good: list[str], found: list[str], bad: list[str]) -> DataFrame:
    """key, n, and the shares of its events that are in good, in found and in bad; and what was found for each good one, null without any."""
    n = F.count("*")
    share = lambda states: F.count_if(F.col("state").isin(states)) / n
    per = F.try_divide(F.count_if(F.col("state").isin(found)), F.count_if(F.col("state").isin(good)))
    return events.groupBy(key).agg(n.alias("n"), share(good).alias("success_rate"), share(found).alias("find_rate"), share(bad).alias("error_rate"), per.alias("yield"))


def silences(events: DataFrame, seconds: int, done: list[str]) -> DataFrame:
    """run_id, state, since, failed_at of runs that said nothing for so many seconds after an event that didn't end them, as far as the log reaches."""
    w = Window.partitionBy("run_id").orderBy("happened", "id")
    until = F.broadcast(events.agg(F.max("happened").alias("__until")))  # one row
    e = events.withColumn("next", F.lead("happened").over(w)).join(until)
    failed = F.col("happened") + F.expr(f"INTERVAL {int(seconds)} SECONDS")
    quiet = F.coalesce("next", "__until") > failed
    return e.filter(~F.col("state").isin(done) & quiet).select("run_id", "state", F.col("happened").alias("since"), failed.alias("failed_at"))
