"""Chat formatting (operator 7): cumulative-snapshot collapse, native Spark expressions only.

Logs often hold a conversation once for each turn it had. Turn hashes roll into prefix
hashes; a conversation whose whole hash is another's proper prefix is a snapshot of it and
goes by an anti-join, of equal conversations the least conv_id stays, and what remains is
rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "<|end|>"


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that no longer one begins with.

    The prefix hash is the running XOR of two 64-bit hashes of (index, role, text): adding
    a turn changes it in place, and the index makes it depend on the order. Only hashes
    are shuffled.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "__a", "__b")
    body = [F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))]
    t = turns.select("conv_id", "turn", "role", F.xxhash64(*body).alias("__a"), F.xxhash64(F.lit(7), *reversed(body)).alias("__b"))
    t = t.withColumn("i", F.row_number().over(order))
    rolling = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("h1", F.bit_xor(F.xxhash64("i", "__a")).over(rolling)).withColumn("h2", F.bit_xor(F.xxhash64("__b", "i")).over(rolling))
    last = F.lead("i").over(Window.partitionBy("conv_id").orderBy("i")).isNull()
    t = t.select("conv_id", "i", "h1", "h2", last.alias("whole"))
    key = ["i", "h1", "h2"]
    # each key once before they meet: a first turn that millions share is one row of each side
    whole = t.filter("whole").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = t.filter("not whole").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("i").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """conv_id and its turns as one text: <|role|>, the text, <|end|>, each turn on lines of its own.

    A conversation is one row of the result, so its turns meet in one task.
    """
    r, t = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    item = F.struct(F.col("turn"), F.col("role"), F.xxhash64(r, t).alias("a"), F.xxhash64(F.lit(7), t, r).alias("b"), F.concat(F.lit(OPEN), r, F.lit("|>\n"), t, F.lit("\n" + CLOSE)).alias("s"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), "\n").alias("rendered"))


def chat_format(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations, itself included) and rendered, for every maximal conversation.

    Turns stand in the order of turn (nulls first), role and text hash; repeated rows are
    turns of their own. Null roles and texts are empty. Rows without conv_id belong to no
    conversation and are left out. Other columns are left behind.
    """
    turns = turns.select("conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull())
    keep = maximal(turns)
    slim = keep.select(F.col("conv_id").alias("__keep"), "n_turns", "n_copies")
    chosen = turns.join(slim.select("__keep"), F.col("conv_id") == F.col("__keep"), "left_semi")
    return render(chosen).join(slim, F.col("conv_id") == F.col("__keep")).drop("__keep")
