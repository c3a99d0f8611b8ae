"""Entity resolution: blocking, scoring, decisions, merges and their rollback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.text import bigram_dice, name_dice, sequence_ratio, similarity_bound
from heddle.operators.lineage import once
from heddle.operators.linking import last_targets, latest_of_each

AUTO_MERGE, REVIEW, URGENT = 92, 70, 85
PER_CANDIDATE = 25
#: Of score_all: rows of one name and domain that travel as one array; rows of a block that meet those of another in one task.
TOGETHER, MEETING = 64, 2048
#: fixed values: similarity of names -> points
FUZZY = [(0.96, 32), (0.90, 25), (0.84, 18), (0.78, 10)]


#: Tables whose rows point at a seller.
CHILDREN = ["accounts", "aliases", "product_links", "score_components", "contacts", "suppressions", "outreach_states", "sources", "audit_events", "field_history"]
#: Request -> state it leads to, and the states it may start from.
REQUESTS = {"merge": ("merged", ["pending"]), "keep_separate": ("separate", ["pending"]), "ignore": ("ignored", ["pending"]), "rollback": ("rolled_back", ["merged"])}


def candidates(new: DataFrame, known: DataFrame, per_candidate: int = PER_CANDIDATE) -> DataFrame:
    """Pairs (candidate_id, existing_id), of known rows that are active where they have a status, that agree on domain, name or the name's first eight characters, the first per_candidate by id of each candidate.

    new and known: id, name, domain. One equi join over all rules instead of a nested loop.
    A block's first per_candidate + 1 ids are one array, so a candidate meets one row of each
    rule, whatever its blocks' sizes, and its pairs are cut from its arrays. Sizes of arrays
    can't be foreseen, so no join here or in score is left to an estimate that broadcasts it.
    """
    if "status" in known.columns:
        known = known.filter("status = 'active'")
    blocks = lambda rows, as_: rows.select(F.posexplode(F.array(F.col("domain"), F.col("name"), F.when(F.length("name") >= 8, F.substring("name", 1, 8)))).alias("rule", "block"), F.col("id").alias(as_)).filter("block IS NOT NULL AND block <> ''")
    w = Window.partitionBy("rule", "block").orderBy("existing_id")
    first = blocks(known, "existing_id").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_candidate + 1)
    first = first.groupBy("rule", "block").agg(F.collect_list("existing_id").alias("ids")).hint("shuffle_hash")
    found = blocks(new, "candidate_id").join(first, ["rule", "block"]).groupBy("candidate_id").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    others = F.array_sort(F.array_distinct(F.filter("ids", lambda i: i != F.col("candidate_id"))))
    return found.select("candidate_id", F.explode(F.slice(others, 1, per_candidate)).alias("existing_id"))


def _norm(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def score(pairs: DataFrame, new: DataFrame, known: DataFrame, scorer: str = "dice") -> DataFrame:
    """pairs with score 0..100 and components array<struct<code, points>>.

    Identities: id, name, domain, country, city, and where they have them hashes, aliases,
    tokens (arrays). scorer dice compares names by bigrams; sequence by matching blocks, and
    also looks at aliases and marketplace tokens. Pairs meet hashed identities, dealt by id:
    neither pairs nor identities pass through the driver.
    """
    columns = [c for c in ("id", "name", "domain", "country", "city", "hashes", "aliases", "tokens") if c in new.columns and c in known.columns]
    a = new.select(*[F.col(c).alias(f"a_{c}") for c in columns]).hint("shuffle_hash")
    b = known.select(*[F.col(c).alias(f"b_{c}") for c in columns]).hint("shuffle_hash")
    j = pairs.join(a, F.col("candidate_id") == F.col("a_id")).join(b, F.col("existing_id") == F.col("b_id"))
    j = j.withColumns({f"{x}_{c}": _norm(F.col(f"{x}_{c}")) for c in ("name", "domain", "country", "city") for x in "ab"})
    if scorer == "sequence":
        j = _best_ratio(j.withColumns({"__x": _names("a", columns), "__y": _names("b", columns)}), FUZZY[-1][0]).drop("__x", "__y")
    else:
        j = once(j, __sim=name_dice("a_name", "b_name"))
    return _rated(j, columns, scorer)


def score_all(new: DataFrame, known: DataFrame) -> DataFrame:
    """score, by dice, of all pairs that candidates' rules allow, without a limit for each candidate: quadratic in a block's rows, as the result is.

    Names that are equal or begin alike share a block of the name's first eight characters,
    so there are two rules, and a pair that agrees on both is settled by its domain: pairs
    are neither stored, shuffled nor compared with each other. Up to TOGETHER rows of one
    name and domain meet others as one, so names are compared once for all of them. A block
    of n rows is dealt into ceil(n / MEETING) parts, each of which meets each in a task's
    key of its own: no task holds a block, and nothing is left out.
    """
    if "status" in known.columns:
        known = known.filter("status = 'active'")
    columns = [c for c in ("id", "name", "domain", "country", "city", "hashes") if c in new.columns and c in known.columns]
    a, b = _grouped(new, columns), _grouped(known, columns)
    weight = a.unionByName(b).groupBy("rule", "block").agg(F.sum(F.size("rows")).alias("n"))
    hot = weight.filter(F.col("n") > MEETING).select("rule", "block", F.ceil(F.col("n") / MEETING).cast("int").alias("k"))  # few: each has MEETING rows
    spark = new.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)  # not merged by their bytes: the work is in the pairs

    def side(groups: DataFrame, x: str, own: str, other: str) -> DataFrame:
        g = groups.join(F.broadcast(hot), ["rule", "block"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
        g = g.withColumn(own, F.pmod(F.xxhash64("name", "domain", "part"), F.col("k")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        return g.select("rule", "block", "i", "j", *[F.col(c).alias(f"{x}_{c}") for c in ("name", "domain", "rows")]).repartition(tasks, "rule", "block", "i", "j")

    settled = (F.col("rule") == 1) & F.coalesce((F.col("a_domain") == F.col("b_domain")) & (F.col("a_domain") != ""), F.lit(False))
    j = side(a, "a", "i", "j").join(side(b, "b", "j", "i").hint("shuffle_hash"), ["rule", "block", "i", "j"]).filter(~settled).drop("rule", "block", "i", "j")
    j = j.withColumns({f"{x}_{c}": _norm(F.col(f"{x}_{c}")) for c in ("name", "domain") for x in "ab"})
    j = once(j, __sim=bigram_dice(F.col("a_name"), F.col("b_name")))
    for x in "ab":
        j = j.withColumn("__row", F.explode(f"{x}_rows")).drop(f"{x}_rows").withColumns({f"{x}_{c}": F.col(f"__row.{c}") for c in columns if c not in ("name", "domain")}).drop("__row")
    j = j.filter("a_id <> b_id").withColumnsRenamed({"a_id": "candidate_id", "b_id": "existing_id"})
    return _rated(j, columns, "dice")


def _grouped(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(rule, block, name, domain, part, rows) of rows: up to about TOGETHER rows of one name and domain as an array, in its block by domain (rule 0) and by name (rule 1)."""
    rest = [_norm(F.col(c)).alias(c) if c in ("country", "city") else F.col(c) for c in columns if c not in ("name", "domain")]
    own = rows.select("name", "domain", F.struct(*rest).alias("row"))
    n = own.groupBy(F.col("name").alias("__n"), F.col("domain").alias("__d")).agg(F.ceil(F.count("*") / TOGETHER).alias("k")).hint("shuffle_hash")
    own = own.join(n, F.col("name").eqNullSafe(F.col("__n")) & F.col("domain").eqNullSafe(F.col("__d")))
    own = own.groupBy("name", "domain", F.pmod(F.xxhash64("row.id"), F.col("k")).alias("part")).agg(F.collect_list("row").alias("rows"))
    block = F.array(F.col("domain"), F.when(F.length("name") >= 8, F.substring("name", 1, 8)).otherwise(F.col("name")))
    return own.select("*", F.posexplode(block).alias("rule", "block")).filter("block IS NOT NULL AND block <> ''")


def _names(x: str, columns: list[str]) -> Column:
    none = F.array().cast("array<string>")
    return F.array_union(F.array(F.col(f"{x}_name")), F.transform(F.coalesce(F.col(f"{x}_aliases"), none), _norm) if "aliases" in columns else none)


def _rated(j: DataFrame, columns: list[str], scorer: str) -> DataFrame:
    """candidate_id, existing_id, score, components of pairs with both identities' columns (a_, b_) and their names' similarity __sim."""
    A, B = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    both = lambda c: (A(c) != "") & (B(c) != "")
    part = lambda cond, code, points: F.when(cond, F.struct(F.lit(code).alias("code"), (points if isinstance(points, Column) else F.lit(points)).cast("int").alias("points")))
    names = lambda x: _names(x, columns)
    exact = both("name") & (A("name") == B("name"))
    parts = [part(both("domain") & (A("domain") == B("domain")), "official_domain_match", 52), part(both("domain") & (A("domain") != B("domain")), "official_domain_conflict", -30), part(exact, "normalized_name_exact", 40)]
    taken = exact
    if scorer == "sequence" and "aliases" in columns:
        alias = ~exact & F.arrays_overlap(F.filter(names("a"), lambda n: n != ""), F.filter(names("b"), lambda n: n != ""))
        parts.append(part(alias, "alias_name_exact", 35))
        taken = taken | alias
    if scorer == "sequence" and "tokens" in columns:
        parts.append(part(F.coalesce(F.arrays_overlap("a_tokens", "b_tokens"), F.lit(False)), "marketplace_token_match", 100))
    fuzzy = F.lit(None).cast("int")
    for least, points in reversed(FUZZY):
        fuzzy = F.when(F.col("__sim") >= least, points).otherwise(fuzzy)
    parts.append(part(~taken & both("name") & fuzzy.isNotNull(), "name_fuzzy", fuzzy))
    if "hashes" in columns:
        n = F.size(F.array_intersect(F.coalesce("a_hashes", F.array().cast("array<string>")), F.coalesce("b_hashes", F.array().cast("array<string>"))))
        parts.append(part(n > 0, "contact_hash_overlap", F.least(F.lit(45), 30 + 5 * n)))
    same = A("country") == B("country")
    parts += [part(both("country") & same, "country_match", 6), part(both("country") & ~same, "country_conflict", -18)]
    parts += [part(both("city") & same & (A("city") == B("city")), "city_match", 4), part(both("city") & same & (A("city") != B("city")), "city_conflict", -8)]
    j = once(j, components=F.filter(F.array(*parts), lambda x: x.isNotNull()))
    total = F.aggregate("components", F.lit(0), lambda s, x: s + x["points"])
    return once(j, score=F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")).select("candidate_id", "existing_id", "score", "components")


def _best_ratio(pairs: DataFrame, least: float) -> DataFrame:
    """pairs with __sim, the best sequence_ratio of a name of __x and one of __y where it reaches least, else 0.

    Bounds by length and letters, in the JVM, leave few pairs of names; each distinct one is
    compared once.
    """
    names = pairs.select("candidate_id", "existing_id", F.explode(F.array_distinct("__x")).alias("x"), F.col("__y"))
    names = names.select("candidate_id", "existing_id", "x", F.explode(F.array_distinct("__y")).alias("y")).filter("x <> '' AND y <> ''")
    close = names.filter(similarity_bound(F.col("x"), F.col("y")) >= least - 1e-9)
    ratio = close.select("x", "y").distinct().withColumn("r", F.when(F.col("x") == F.col("y"), 1.0).otherwise(sequence_ratio("x", "y")))
    best_ = close.join(ratio.hint("shuffle_hash"), ["x", "y"]).groupBy("candidate_id", "existing_id").agg(F.max("r").alias("__sim")).hint("merge")
    return pairs.join(best_, ["candidate_id", "existing_id"], "left").withColumn("__sim", F.coalesce("__sim", F.lit(0.0)))


def best(scored: DataFrame) -> DataFrame:
    """Each candidate's best match: highest score, then smallest id."""
    top = scored.groupBy("candidate_id").agg(F.min(F.struct((-F.col("score")).alias("less"), "existing_id", "score")).alias("b"))
    return top.select("candidate_id", "b.existing_id", "b.score")


def action(score_: Column) -> Column:
    return F.when(score_ >= AUTO_MERGE, "auto_merge").when(score_ >= REVIEW, "review_queue").otherwise("no_merge")


def review_priority(score_: Column) -> Column:
    return F.when(score_ >= URGENT, 1).otherwise(2)


def merge_links(tables: dict[str, DataFrame], decisions: DataFrame) -> DataFrame:
    """The rows that merges re-point: decision_id, table_name, row_id, source_id, target_id. decisions: id, source_id, target_id.

    All tables' rows meet the merges in one join, which hashes the merges' side: a task holds
    its part of the merges and sorts nothing, however many rows a table has.
    """
    d = decisions.select(F.col("id").alias("decision_id"), "source_id", "target_id").hint("shuffle_hash")
    rows = [df.select(F.lit(name).alias("table_name"), F.col("id").alias("row_id"), F.col("seller_id").alias("__s")) for name, df in tables.items()]
    j = reduce(DataFrame.unionByName, rows).join(d, F.col("__s") == F.col("source_id"))
    return j.select("decision_id", "table_name", "row_id", "source_id", "target_id")


def repoint(rows: DataFrame, decisions: DataFrame, follow: bool = False) -> DataFrame:
    """rows with seller_id moved to the merge target, with follow to the last one of a chain.

    Of several merges of one source the last holds (by created_at where they have it, then
    id), so no row is doubled. Sources in a cycle go to its least id.
    """
    order = [c for c in ("created_at", "id", "target_id") if c in decisions.columns]
    one = latest_of_each(decisions.select("source_id", "target_id", *[c for c in order if c != "target_id"]), order)
    d = last_targets(one).select(F.col("source_id").alias("__from"), F.col("last_id").alias("__to")) if follow else one.select(F.col("source_id").alias("__from"), F.col("target_id").alias("__to"))
    return rows.join(d, F.col("seller_id") == F.col("__from"), "left").withColumn("seller_id", F.coalesce("__to", "seller_id")).drop("__from", "__to")


def rollback(rows: DataFrame, links: DataFrame, table_name: str) -> DataFrame:
    """rows that the links moved and that still point at the target go back to their source; all others stay. Of several links of a row to one target the last decision's holds."""
    own = links.filter(F.col("table_name") == table_name)
    back = own.groupBy(F.col("row_id").alias("__row"), F.col("target_id").alias("__target")).agg(F.max_by("source_id", F.struct("decision_id", "source_id")).alias("__source"))
    j = rows.join(back, (F.col("id") == F.col("__row")) & (F.col("seller_id") == F.col("__target")), "left")
    return j.withColumn("seller_id", F.coalesce("__source", "seller_id")).drop("__row", "__source", "__target")


def undone(links: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """links with undone: whether a rollback moves the row back, since it still points at the target."""
    out = None
    for name, rows in tables.items():
        own = rows.select(F.col("id").alias("__row"), F.col("seller_id").alias("__target"))
        l = links.filter(F.col("table_name") == name)
        j = l.join(own, (F.col("row_id") == F.col("__row")) & (F.col("target_id") == F.col("__target")), "left")
        j = j.withColumn("undone", F.col("__row").isNotNull()).drop("__row", "__target")
        out = j if out is None else out.unionByName(j)
    return out


def redirects(decisions: DataFrame) -> DataFrame:
    """source_id, target_id, status of merges (source_id, target_id, status): active, or rolled_back."""
    status = F.when(F.col("status") == "merged", "active").when(F.col("status") == "rolled_back", "rolled_back")
    return decisions.select("source_id", "target_id", status.alias("status")).filter("status IS NOT NULL")


def auto_merge(sellers: DataFrame, children: dict[str, DataFrame], best_matches: DataFrame) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(sellers, children, decisions): new sellers whose best match is certain become merged and point at it, and what points at them moves along.

    best_matches: candidate_id, existing_id, score, one row for each candidate. decisions:
    id (the candidate's), source_id, target_id, score, action of every match.
    """
    d = best_matches.select(F.col("candidate_id").alias("id"), F.col("candidate_id").alias("source_id"), F.col("existing_id").alias("target_id"), "score").withColumn("action", action(F.col("score")))
    sure = d.filter("action = 'auto_merge'")
    to = sure.select(F.col("source_id").alias("__from"), F.col("target_id").alias("merged_into"))
    s = sellers.join(to, F.col("id") == F.col("__from"), "left").drop("__from")
    s = s.withColumn("status", F.when(F.col("merged_into").isNotNull(), "merged").otherwise(F.col("status")))
    return s, {name: repoint(rows, sure) for name, rows in children.items()}, d


def decide(decisions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, receipts) after requests (id, request), of which the first by request counts for an id.

    A request whose state is there already is a duplicate; one that the state doesn't allow
    a conflict; an unknown id is not_found, an unknown request invalid.
    """
    leads = F.create_map(*[F.lit(x) for name, (to, _) in REQUESTS.items() for x in (name, to)])
    first = requests.groupBy("id").agg(F.min("request").alias("request")).withColumnRenamed("id", "__id")
    j = first.join(decisions.select("id", "status"), F.col("__id") == F.col("id"), "left").withColumn("to", F.try_element_at(leads, F.col("request")))
    allowed = F.lit(False)
    for name, (_, since) in REQUESTS.items():
        allowed = allowed | ((F.col("request") == name) & F.col("status").isin(since))
    receipt = F.when(F.col("to").isNull(), "invalid").when(F.col("id").isNull(), "not_found").when(F.col("status") == F.col("to"), "duplicate").when(allowed, "applied").otherwise("conflict")
    receipts = j.select(F.col("__id").alias("id"), "request", receipt.alias("receipt"), "to")
    done = receipts.filter("receipt = 'applied'").select(F.col("id").alias("__id"), "to")
    after = decisions.join(done, F.col("id") == F.col("__id"), "left").withColumn("status", F.coalesce("to", "status")).drop("__id", "to")
    return after, receipts.drop("to")


def decision_errors(action_: Column, score_: Column, source: Column, target: Column) -> Column:
    """array<string>: which constraints a decision breaks."""
    rules = {"action": ~action_.isin("auto_merge", "review_queue", "no_merge"), "score": ~score_.between(0, 100), "self": source == target}
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]), lambda e: e.isNotNull())
