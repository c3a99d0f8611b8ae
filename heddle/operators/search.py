"""Full-text search as a set filter: index documents, prefix AND and OR."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.text import plain_text, tokens
from heddle.operators.lineage import cut, file_system
from heddle.operators.relational import distinct_text

MAX_TERMS = 8
#: Ranges of tokens that postings are stored in, buckets of keys that documents' tokens are stored in.
RANGES, BUCKETS = 64, 64


def parse(text: str) -> list[str]:
    """Up to eight terms: runs of letters and digits, lower case, without accents."""
    return re.findall(r"[^\W_]+", plain_text(text))[:MAX_TERMS]


#: What a seller is found by.
COLUMNS = ["canonical_name", "legal_name", "legal_name_local", "aliases", "brands", "official_domain", "city"]


def seller_documents(sellers: DataFrame, aliases: DataFrame, products: DataFrame) -> DataFrame:
    """seller_id and COLUMNS: the index's documents. aliases: seller_id, alias; products: seller_id, brand. Columns that sellers lack are null."""
    a = distinct_text(aliases.filter("alias IS NOT NULL"), "seller_id", "alias", "aliases", " ").withColumnRenamed("seller_id", "__a")
    b = distinct_text(products.filter("brand IS NOT NULL"), "seller_id", "brand", "brands", " ").withColumnRenamed("seller_id", "__b")
    own = [F.col(c) if c in sellers.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS if c not in ("aliases", "brands")]
    return sellers.select("id", *own).join(a, F.col("id") == F.col("__a"), "left").join(b, F.col("id") == F.col("__b"), "left").select(F.col("id").alias("seller_id"), *COLUMNS)


def refresh(idx: DataFrame, documents: DataFrame, changed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """idx with the documents of the changed keys taken out and indexed anew; a key without a document any more is gone."""
    keys = changed.select(key).distinct()
    return idx.join(keys, key, "left_anti").unionByName(index(documents.join(keys, key, "left_semi"), key, columns))


def index(documents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, token), each token of a document once."""
    text = F.concat_ws(" ", *columns)
    return documents.select(key, F.explode(F.array_distinct(tokens(text))).alias("token"))


def match(idx: DataFrame, key: str, text: str, every: bool = True) -> DataFrame:
    """Keys whose documents have a token with each term's prefix (or any term's). A text without terms filters nothing.

    The prefixes are pushed to the index's scan; what is left is one aggregation by key.
    """
    terms = list(dict.fromkeys(parse(text)))
    if not terms:
        return idx.select(key).distinct()
    near = [F.startswith("token", F.lit(t)) for t in terms]
    any_of = near[0]
    for n in near[1:]:
        any_of = any_of | n
    hits = idx.filter(any_of)
    found = hits.groupBy(key).agg(*[F.max(n.cast("int")).alias(f"t{i}") for i, n in enumerate(near)])
    total = F.lit(0)
    for i in range(len(terms)):
        total = total + F.col(f"t{i}")
    return found.filter(total >= (len(terms) if every else 1)).select(key)


# an index that is kept


def build(documents: DataFrame, key: str, columns: list[str], path: str, ranges: int = RANGES) -> None:
    """Write the index of documents under path: postings, forward and bounds.

    Postings (token, key) are sorted and in folders by range, each range its own interval of
    (token, key), so that a prefix prunes files and row groups by their least and greatest
    token, and a token that a third of all documents have is in several ranges. forward has
    each document's tokens in folders by bucket of its key, for refresh. bounds, the first
    posting of each range, is written last.
    """
    spark = documents.sparkSession
    _tokens_of(documents, key, columns).sortWithinPartitions("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/forward")
    kind = documents.schema[key].dataType.simpleString()
    posts = _forward(spark, path, key, kind).select(F.explode("tokens").alias("token"), key)
    posts = posts.repartitionByRange(ranges, "token", key).withColumn("range", F.spark_partition_id())
    posts.sortWithinPartitions("range", "token", key).write.mode("overwrite").partitionBy("range").parquet(f"{path}/postings")
    bounds = _postings(spark, path, key, kind).groupBy("range").agg(F.min(F.struct("token", key)).alias("b"))
    bounds.select("range", "b.*").coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")


def _tokens_of(documents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return documents.select(key, F.array_distinct(tokens(F.concat_ws(" ", *columns))).alias("tokens"), F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket"))


def _postings(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    return spark.read.schema(f"token string, `{key}` {kind}, range int").parquet(f"{path}/postings")


def _forward(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    return spark.read.schema(f"`{key}` {kind}, tokens array<string>, bucket int").parquet(f"{path}/forward")


def stored_index(spark: SparkSession, path: str) -> DataFrame:
    """(token, key, range) of an index that build wrote; match() prunes it."""
    key = spark.read.parquet(f"{path}/bounds").schema[2]  # an index without postings has no other file
    return _postings(spark, path, key.name, key.dataType.simpleString())


def is_built(spark: SparkSession, path: str) -> bool:
    where, fs = file_system(spark, f"{path}/bounds/_SUCCESS")
    return fs.exists(where)


def refresh_stored(spark: SparkSession, path: str, documents: DataFrame, changed: DataFrame, key: str, columns: list[str]) -> tuple[list[int], list[int]]:
    """Index the changed keys anew in what is stored; the ranges and the buckets that were rewritten.

    What changed is the difference of a key's old tokens (forward, only the buckets of the
    changed keys are read) and its new ones; only ranges that lose or gain a posting are read
    and written. A key without a document any more is gone.
    """
    keys = changed.select(key).distinct()
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    buckets = sorted(r[0] for r in keys.select(bucket).distinct().collect())  # BUCKETS at most
    kind = documents.schema[key].dataType.simpleString()
    held = _forward(spark, path, key, kind).filter(F.col("bucket").isin(buckets))
    old = held.join(keys, key, "left_semi").select(key, F.explode("tokens").alias("token"))
    fresh = cut(_tokens_of(documents.join(keys, key, "left_semi"), key, columns))
    new = fresh.select(key, F.explode("tokens").alias("token"))
    bounds = [r for r in spark.read.parquet(f"{path}/bounds").orderBy("range").collect()]  # a row for each range
    if not bounds:  # nothing was indexed so far
        build(documents, key, columns, path)
        return list(range(RANGES)), list(range(BUCKETS))
    first = F.array(*[F.struct(F.lit(r["token"]).alias("token"), F.lit(r[key]).alias(key)) for r in bounds])
    numbers = F.array(*[F.lit(r["range"]) for r in bounds])
    place = F.greatest(F.lit(1), F.size(F.filter(first, lambda b: b <= F.struct("token", key))))
    gone = old.join(new, [key, "token"], "left_anti").withColumn("change", F.lit(-1))
    come = new.join(old, [key, "token"], "left_anti").withColumn("change", F.lit(1))
    change = cut(gone.unionByName(come).withColumn("range", F.element_at(numbers, place)))
    ranges = sorted(r[0] for r in change.select("range").distinct().collect())  # one for each range at most
    posts = _postings(spark, path, key, kind).filter(F.col("range").isin(ranges))
    after = posts.join(change.filter("change < 0"), ["range", "token", key], "left_anti").select("token", key, "range")
    after = cut(after.unionByName(change.filter("change > 0").select("token", key, "range")))
    forward = cut(held.join(keys, key, "left_anti").unionByName(fresh))
    if ranges:
        after.repartition("range").sortWithinPartitions("range", "token", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("range").parquet(f"{path}/postings")
    if buckets:
        forward.repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/forward")
    return ranges, buckets
