"""Linking beyond pairs: components over any of several exact keys, last targets of redirects, similar token sets."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.lineage import cut

#: Members of a block of sets that are compared in one task.
BLOCK = 16_384
#: Sets of up to so many tokens meet on several tokens at once, which a set shows to those of one size in so many choices at most.
SMALL, MOST = 16, 128


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One step of alternating stars: edges (u, v), u > v, hung on the least of each node's neighbourhood.

    large: every greater neighbour of a node goes to the least of them all; small: the node
    and its lesser neighbours do. Leasts are a partial aggregation; the join back has one
    row for each node on that side, so AQE splits a node that many share.
    """
    near = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).withColumn("m", F.least("n", "m"))
    j = near.join(least, F.col("u") == F.col("n"))
    if small:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    else:
        out = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ids that have an edge (u, v): the least id that can be reached. Stored after each round, of which there are few."""
    e = edges.filter("u <> v AND u IS NOT NULL AND v IS NOT NULL").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    e = cut(e)
    before = state(e)
    while True:
        e = cut(_stars(_stars(e, small=False), small=True))
        now = state(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def link_by_keys(keys: DataFrame, exclusive: list[str]) -> DataFrame:
    """(id, entity, conflict) of all ids in keys (id, kind, value): ids that share a value of any kind are one entity, the least id names it.

    exclusive kinds, in order of weight, name one thing only (a registration number): a
    group that would join two values of such a kind is in conflict, and is linked by the
    weightiest exclusive kind in conflict alone. Null values link nothing. A value that many ids share is a
    star around its least id, not pairs.
    """
    own = keys.filter("value IS NOT NULL")
    star = lambda rows: rows.join(rows.groupBy("kind", "value").agg(F.min("id").alias("v")), ["kind", "value"]).select(F.col("id").alias("u"), "v")
    ids = keys.select("id").distinct()
    found = cut(components(star(own)))
    group = ids.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(exclusive) for x in (k, i)]) if exclusive else None
    if rank is None:
        return group.select("id", F.col("component").alias("entity"), F.lit(False).alias("conflict"))
    strong = own.filter(F.col("kind").isin(exclusive)).join(group, "id")
    torn = strong.groupBy("component", "kind").agg(F.min("value").alias("a"), F.max("value").alias("b")).filter("a <> b")
    torn = cut(torn.groupBy("component").agg(F.min_by("kind", F.element_at(rank, F.col("kind"))).alias("by")))
    again = strong.join(torn, "component").filter("kind = by").select("component", "id", F.concat_ws(":", "component", "kind").alias("kind"), "value")
    again = components(star(again.drop("component"))).withColumnRenamed("component", "alone")
    out = group.join(torn.select("component", F.lit(True).alias("conflict")), "component", "left").join(again, "id", "left")
    entity = F.when(F.col("conflict"), F.coalesce("alone", "id")).otherwise(F.col("component"))
    return out.select("id", entity.alias("entity"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


def last_targets(redirects: DataFrame) -> DataFrame:
    """(source_id, last_id, hops, cycle) of redirects (source_id, target_id, one row for each source): where its chain ends.

    Pointer jumping: each round doubles how far a source has looked. A chain that runs into a
    cycle has no end; it stops at the cycle's least id, and cycle is true (for its members too).
    """
    r = redirects.filter("source_id IS NOT NULL AND target_id IS NOT NULL")
    held = cut(r.select("source_id", F.col("target_id").alias("last_id"), F.lit(1).cast("long").alias("hops"), F.least("source_id", "target_id").alias("low")))
    n, far = held.count(), 1
    jump = lambda df: df.select(F.col("source_id").alias("__s"), F.col("last_id").alias("__to"), F.col("hops").alias("__hops"), F.col("low").alias("__low"))
    while far < 2 * n:
        step = held.join(jump(held), F.col("last_id") == F.col("__s"), "left")
        open_ = F.col("__s").isNotNull()
        step = step.select("source_id", F.coalesce("__to", "last_id").alias("last_id"), (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops"), F.least("low", F.coalesce("__low", "low")).alias("low"), open_.alias("moved"))
        step = cut(step)
        held, far = step.drop("moved"), 2 * far
        if not step.filter("moved").limit(1).count():
            break
    # what still moves after so many steps stands on a cycle, and has seen all of it
    end = held.select(F.col("source_id").alias("__s"), F.col("low").alias("__low"))
    out = held.join(end, F.col("last_id") == F.col("__s"), "left")
    cycle = F.col("__s").isNotNull()
    return out.select("source_id", F.when(cycle, F.col("__low")).otherwise(F.col("last_id")).alias("last_id"), F.when(~cycle, F.col("hops")).alias("hops"), cycle.alias("cycle"))


def latest_of_each(decisions: DataFrame, order: list[str]) -> DataFrame:
    """One row for each source_id: of several merges of a source the last one by order holds."""
    keep = [c for c in decisions.columns if c != "source_id"]
    best = decisions.groupBy("source_id").agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("__b"))
    return best.select("source_id", "__b.*").select(*decisions.columns)


def _places(num: int, den: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, partner, ell, places): the places, in a set of size tokens, whose tokens it shows to sets of partner tokens, ell at a time.

    Sets with o tokens in common have the first ell of them among their first size - o + ell
    tokens each. ell is o, where every pair that meets is similar, or as large as MOST allows.
    """
    out = []
    for n in range(1, SMALL + 1):
        for m in range(1, SMALL + 1):
            if min(n, m) * den >= max(n, m) * num:
                o = -(-(n + m) * num // (num + den))
                ell = max([1, *(x for x in range(1, o + 1) if comb(max(n, m) - o + x, x) <= MOST)])
                out += [(n, m, ell, list(p)) for p in combinations(range(n - o + ell), ell)]
    return out


def similar_sets(rows: DataFrame, num: int = 3, den: int = 5, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of rows (id, tokens): all pairs of different sets with a Jaccard similarity of num / den or more.

    members: (id, set_id), the least id with the same set of tokens; copies are one set.
    pairs: (one, two, size_one, size_two, common), set ids, one < two. Tokens are put in
    order of how many sets have them, rare ones first. Two sets of up to SMALL tokens meet
    on several tokens at once, as many as their sizes ask for (_places), so that what meets
    is mostly similar, however few tokens there are. If one is larger, they meet on one token: two similar sets
    have one in common among the first |s| - ceil(t |s|) + 1 of each, so only those prefixes
    meet, with bounds on their sizes, on what can still follow and on the bits in which two
    sets of 64 bits differ. Sets travel with what they meet on, so that a pair is settled
    where it meets, by its first common tokens alone: candidates are neither stored nor
    shuffled. What n sets meet on is dealt into ceil(n / block) blocks, each two of which
    meet in a task of their own: no task grows with a hot token, and nothing is left out.
    Empty and null sets are similar to none.
    """
    own = rows.select("id", F.array_sort(F.array_distinct(F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: t.isNotNull()))).alias("set")).filter(F.size("set") > 0)
    sets = cut(own.groupBy("set").agg(F.min("id").alias("set_id")))
    members = own.join(sets, "set").select("id", "set_id").distinct()
    each = sets.select("set_id", F.size("set").alias("size"), F.explode("set").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("n"))
    ranks = cut(often.orderBy("n", "token").select("token", F.monotonically_increasing_id().alias("rank")))
    ranked = each.join(ranks, "token").groupBy("set_id", "size").agg(F.array_sort(F.collect_list("rank")).alias("set"))  # a set's own tokens
    bit = lambda rank: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(rank, F.lit(64)).cast("int"))
    ranked = ranked.withColumn("bits", F.aggregate("set", F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(bit(x))))
    ranked = cut(ranked.repartition(_tasks(rows), "set_id"))
    pairs = _small_pairs(ranked.filter(F.col("size") <= SMALL), num, den, block)
    return pairs.unionByName(_large_pairs(ranked.filter(F.col("size") * den >= num * (SMALL + 1)), num, den, block)), members


def _tasks(rows: DataFrame) -> int:
    """Partitions for pairs, not merged by their bytes: the work is in the pairs."""
    spark = rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def _in_order(met: DataFrame, common: Column) -> DataFrame:
    swap = F.col("one") > F.col("two")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return met.select(F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two"), either("size_one", "size_two").alias("size_one"), either("size_two", "size_one").alias("size_two"), common.alias("common"))


def _small_pairs(ranked: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Pairs of sets of up to SMALL tokens."""
    places = ranked.sparkSession.createDataFrame(_places(num, den), "size int, partner int, ell int, places array<int>")
    shown = ranked.join(F.broadcast(places), "size").withColumn("key", F.transform("places", lambda i: F.get(F.col("set"), i))).drop("places")
    shown = shown.withColumns({"low": F.least("size", "partner"), "high": F.greatest("size", "partner")})
    keys = ["low", "high", "key"]
    hot = shown.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > block).select(*keys, F.ceil(F.col("n") / block).cast("int").alias("k"))  # at most one of block rows

    def side(name: str, b: str, o: str) -> DataFrame:
        own = shown.filter(F.col("size") == F.col("low" if name == "one" else "high")).join(F.broadcast(hot), keys, "left").withColumn("k", F.coalesce("k", F.lit(1)))
        own = own.withColumn(b, F.pmod(F.xxhash64("set_id"), F.col("k")).cast("int")).withColumn(o, F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        own = own.select(*keys, "i", "j", F.col("set_id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("size", "set", "bits")], *(["ell"] if name == "one" else []))
        return own.repartition(_tasks(ranked), *keys, "i", "j")

    n, m = F.col("size_one"), F.col("size_two")
    differ = F.bit_count(F.col("bits_one").bitwiseXOR(F.col("bits_two")))
    met = side("one", "i", "j").join(side("two", "j", "i").hint("shuffle_hash"), [*keys, "i", "j"])
    met = met.filter(((n < m) | (F.col("one") < F.col("two"))) & (differ * (num + den) <= (n + m) * (den - num)))
    first = lambda c: (F.size(c) * (num + den) >= (n + m) * num) & (F.get(c, F.col("ell") - 1) == F.get(F.col("key"), F.col("ell") - 1))  # noqa: E731  (no common token before these that isn't one of them)
    met = met.select("one", "two", "size_one", "size_two", F.explode(F.filter(F.array(F.array_intersect("set_one", "set_two")), first)).alias("both"))
    return _in_order(met, F.size("both"))


def _large_pairs(ranked: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Pairs of sets of which one has more than SMALL tokens."""
    need = F.ceil(F.col("size") * num / den).cast("int")
    prefix = ranked.select("set_id", "size", "set", "bits", F.posexplode(F.slice("set", F.lit(1), F.col("size") - need + 1)).alias("at", "token"))
    prefix = cut(prefix)
    count = prefix.groupBy(F.col("token").alias("__t")).agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    dealt = prefix.join(count, F.col("token") == F.col("__t")).withColumn("b", F.pmod(F.xxhash64("set_id"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))

    def side(name: str, i: str, j: str) -> DataFrame:
        own = dealt.filter(F.col("b") <= F.col("o") if name == "one" else F.col("b") >= F.col("o"))
        own = own.select("token", F.col(i).alias("i"), F.col(j).alias("j"), F.col("set_id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("size", "at", "set", "bits")])
        return own.repartition(_tasks(ranked), "token", "i", "j")

    n, m = F.col("size_one"), F.col("size_two")
    common = F.size(F.array_intersect("set_one", "set_two"))
    similar = [
        F.greatest(n, m) > SMALL,
        (F.col("i") < F.col("j")) | (F.col("one") < F.col("two")),
        F.least(n, m) * den >= F.greatest(n, m) * num,
        F.least(n - F.col("at_one"), m - F.col("at_two")) * (num + den) >= (n + m) * num,
        F.bit_count(F.col("bits_one").bitwiseXOR(F.col("bits_two"))) * (num + den) <= (n + m) * (den - num),
        common * (num + den) >= (n + m) * num,
        ~F.arrays_overlap(F.slice("set_one", F.lit(1), F.col("at_one")), F.slice("set_two", F.lit(1), F.col("at_two"))),  # no common token before this one
    ]
    a, b = side("one", "b", "o"), side("two", "o", "b")
    met = a.join(b, ["token", "i", "j"]).filter(reduce(and_, similar))
    return _in_order(met, common)
