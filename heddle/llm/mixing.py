"""Mixing sources to target weights (operator 3): temperature mixing, native Spark expressions only.

Source shares of tokens are raised to an exponent a in [0, 1] and normalised: 1 keeps the
shares, 0 makes all sources equal. Bisection finds the least a whose mix repeats no source
more often than allowed (or the greatest a that reaches a target entropy). The weights are
realised as block permutations: a source's documents fall into blocks by hash, blocks and
the documents in them are permuted by seeded hashes, and each pass over the permutation
(epoch) takes documents until the source's token budget is spent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.shared import WORD, stored

#: Each pass over the source totals tries so many exponents at once: five halvings.
FAN = 32
ROUNDS = 4
BLOCK_TOKENS = 1 << 20
#: Most sources whose totals are broadcast; beyond that they are joined by shuffling, and AQE splits the hot ones.
MOST_EPOCHS = 1_000_000
BROADCAST_SOURCES = 50_000


def totals(docs: DataFrame) -> DataFrame:
    """source -> tokens, documents; two levels, so that no source's rows meet in one task."""
    return docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def find_exponent(sources: DataFrame, budget: int, max_epochs: float | None = 4.0, min_entropy: float | None = None) -> float:
    """The exponent as a multiple of FAN ** -ROUNDS, by bisection FAN ways at a time.

    With max_epochs: the least a at which no source gets more than max_epochs times its
    tokens; 1.0 if even the plain shares repeat more. With min_entropy (nats): the greatest
    a whose mix has at least this entropy; 0.0 if none has.
    """
    tokens = sources.filter(F.col("tokens") > 0).select(F.col("tokens").cast("double").alias("t"))
    low, width = 0.0, 1.0
    for _ in range(ROUNDS):
        step = width / FAN
        grid = F.array(*[F.lit(low + i * step) for i in range(FAN + 1)])
        at = tokens.select("t", F.posexplode(grid).alias("i", "a"))
        p = F.pow(F.col("t"), F.col("a"))
        sums = at.groupBy("i").agg(F.sum(p).alias("z"), F.sum(p * F.log(p)).alias("zl"), F.max(p / F.col("t")).alias("top"))
        rows = {r["i"]: r for r in sums.collect()}  # FAN + 1 rows
        if not rows:
            return 1.0

        def fine(i: int) -> bool:
            r = rows[i]
            if min_entropy is not None:
                return math.log(r["z"]) - r["zl"] / r["z"] >= min_entropy
            return budget * r["top"] / r["z"] <= max_epochs

        if min_entropy is not None:
            at_most = max((i for i in range(FAN + 1) if fine(i)), default=None)
            if at_most is None:
                return 0.0
            if at_most == FAN:
                return low + width
            low = low + at_most * step
        else:
            least = min((i for i in range(FAN + 1) if fine(i)), default=None)
            if least is None:
                return 1.0
            if least == 0:
                return low
            low = low + (least - 1) * step
        width = step
    return low if min_entropy is not None else low + width


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def permute(docs: DataFrame, sources: DataFrame, key: list[str], seed: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows that the budgets buy: docs' columns, epoch, position.

    sources: source, tokens, want (tokens to take). A document is taken in an epoch if the
    tokens that stand before it in that epoch's permutation leave some of the budget; the
    last one taken may overrun it by less than its own length. position in [0, 1) is the
    share of the source's budget spent before it: ordered by it, every prefix is mixed as
    the whole.
    """
    src = sources.select(
        F.col("source").alias("__src"),
        F.col("tokens").alias("__tokens"),
        F.col("want").alias("__want"),
        F.ceil(F.col("want") / F.col("tokens")).cast("long").alias("__epochs"),
        F.greatest(F.lit(1).cast("long"), F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("long")).alias("__blocks"),
    ).filter((F.col("__tokens") > 0) & (F.col("__want") > 0))
    if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        src = F.broadcast(src)
    rows = docs.filter(F.col("n_tokens") > 0).join(src, F.col("source").eqNullSafe(F.col("__src")))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__epochs") - 1)))
    ids = [F.col(c) for c in key]
    block = F.pmod(F.conv(F.substring(_hash(F.lit(seed), F.lit("block"), *ids), 1, 12), 16, 10).cast("long"), F.col("__blocks"))
    rows = rows.withColumn("__block", block)
    rows = rows.withColumn("__order", _hash(F.lit(seed), F.col("epoch"), *ids))
    blocks = rows.groupBy("__src", "epoch", "__block").agg(F.sum("n_tokens").alias("__in"))
    border = _hash(F.lit(seed), F.col("epoch"), F.col("__block"))
    before = Window.partitionBy("__src", "epoch").orderBy(border, "__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__in").over(before), F.lit(0).cast("long")))
    blocks = blocks.select(F.col("__src").alias("__s"), F.col("epoch").alias("__e"), F.col("__block").alias("__b"), "__before")
    inside = Window.partitionBy("__src", "epoch", "__block").orderBy("__order", *key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0).cast("long")))
    rows = rows.join(blocks, F.col("__src").eqNullSafe(F.col("__s")) & (F.col("epoch") == F.col("__e")) & (F.col("__block") == F.col("__b")))
    spent = F.col("epoch") * F.col("__tokens") + F.col("__before") + F.col("__inside")
    rows = rows.withColumn("position", spent / F.col("__want")).filter(spent < F.col("__want"))
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def mix(docs: DataFrame, budget: int | None = None, max_epochs: float | None = 4.0, min_entropy: float | None = None, seed: int = 17, key: str = "doc_id") -> DataFrame:
    """One row for each time that a document is taken: doc_id, source, n_tokens, epoch, position.

    With min_entropy alone a tiny source may be asked for more than MOST_EPOCHS epochs; that
    is an error, before anything is taken. Tokens are words. budget None: as many as the documents have. Documents without words
    (null, empty) are never taken. A null source is a source. Repeated rows are taken
    each. All other columns of docs are left behind, so names can't clash.
    """
    n = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    slim = stored(docs.select(F.col(key).alias("doc_id"), F.col("source"), n.alias("n_tokens")), "mix")
    sources = stored(totals(slim), "mix-sources")
    if budget is None:
        budget = sources.agg(F.sum("tokens")).first()[0] or 0
    a = find_exponent(sources, budget, max_epochs, min_entropy)
    share = F.pow(F.col("tokens").cast("double"), F.lit(a))
    z = sources.filter(F.col("tokens") > 0).agg(F.sum(share)).first()[0] or 1.0
    weighted = sources.withColumn("want", F.floor(share / F.lit(z) * F.lit(float(budget))).cast("long"))
    most = weighted.filter(F.col("tokens") > 0).agg(F.max(F.col("want") / F.col("tokens"))).first()[0] or 0
    if most > MOST_EPOCHS:
        raise ValueError(f"a source would be taken {most:.0f} times; the most is {MOST_EPOCHS}: ask for less entropy or name max_epochs")
    return permute(slim, weighted, ["doc_id", "n_tokens"], seed)
