"""Listings: sellers by fifteen facets, contacts that nobody suppressed, duplicates and runs, each a page with its total.

Facets over other tables are semi joins, one for each table. They give ids and sort keys only;
the page, at most 100 rows, is stored and broadcast to what is looked up for it, and the
lookups aggregate only rows of the page's sellers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators import relational as R
from heddle.operators import search as S
from heddle.operators.lineage import cut
from heddle.sources.export import EXPORT_ROWS, csv_cell


@dataclass(frozen=True)
class Facets:
    """What a listing is narrowed to; None: not asked for."""

    query: str | None = None
    status: str | None = None
    country: str | None = None
    website: bool | None = None
    marketplace: str | None = None
    account: str | None = None
    category: str | None = None
    brand: str | None = None
    manufacturer: int | None = None
    trader: int | None = None
    duplicate_status: str | None = None
    updated_since: str | None = None
    contact_type: str | None = None
    source_type: str | None = None
    run: int | str | None = None
    seller: int | str | None = None
    confidence: int | None = None
    verified: bool | None = None
    new_since: str | None = None
    official_contact: bool | None = None
    sort: str | None = None
    limit: int | None = None
    offset: int | None = None


#: Sort -> order; ties by id.
SORTS = {
    "newest": lambda: [F.desc("first_seen_at")],
    "recently_updated": lambda: [F.desc("updated_at")],
    "highest_confidence": lambda: [F.desc("confidence")],
    "most_contacts": lambda: [F.desc_nulls_last("n_contacts")],
    "seller_name": lambda: [F.asc(F.lower("name"))],
}


def _has(rows: DataFrame, side: DataFrame, key: str = "seller_id", own: str = "id") -> DataFrame:
    return rows.join(side.select(F.col(key).alias("__key")).filter("__key IS NOT NULL").distinct(), F.col(own) == F.col("__key"), "left_semi")


def _has_each(rows: DataFrame, side: DataFrame, conditions: list[Column], key: str = "seller_id", own: str = "id") -> DataFrame:
    """Rows that have, for each of the conditions, a row of side that meets it: one scan of side and one aggregation for all of them."""
    if not conditions:
        return rows
    met = [F.coalesce(c, F.lit(False)) for c in conditions]
    any_of = met[0]
    for c in met[1:]:
        any_of = any_of | c
    if len(met) == 1:
        return _has(rows, side.filter(any_of), key, own)
    found = side.filter(any_of).groupBy(F.col(key).alias("__key")).agg(*[F.max(c).alias(f"m{i}") for i, c in enumerate(met)])
    return _has(rows, found.filter(R.conjunction([F.col(f"m{i}") for i in range(len(met))])), "__key", own)


def seller_facets(rel: dict[str, DataFrame], f: Facets) -> DataFrame:
    """The sellers that all facets leave; merged ones never. Each relation is looked at once, whatever is asked of it."""
    on = lambda value, cond: None if value is None else cond()
    asked = lambda *conditions: [c for c in conditions if c is not None]
    s = rel["sellers"].filter("status <> 'merged'").filter(
        R.conjunction(
            [
                on(f.status, lambda: F.col("status") == f.status),
                on(f.country, lambda: F.upper("country") == f.country.upper()),
                on(f.website, lambda: F.col("domain").isNotNull() == f.website),
                on(f.manufacturer, lambda: F.col("manufacturer_score") >= f.manufacturer),
                on(f.trader, lambda: F.col("trader_score") >= f.trader),
                on(f.updated_since, lambda: F.col("updated_at") >= F.lit(f.updated_since).cast("date")),
                on(f.new_since, lambda: F.col("first_seen_at") >= F.lit(f.new_since).cast("date")),
                F.col("domain").isNotNull() if f.official_contact else None,
            ]
        )
    )
    if f.query and S.parse(f.query):
        s = _has(s, S.match(rel["index"], "seller_id", f.query))
    accounts = asked(
        on(f.marketplace, lambda: F.col("marketplace") == f.marketplace),
        on(f.account, lambda: R.like_contains(F.col("display_name"), f.account) | R.like_contains(F.col("token"), f.account)),
    )
    products = asked(*[on(text, lambda c=column, t=text: R.like_contains(F.col(c), t)) for column, text in (("category", f.category), ("brand", f.brand))])
    active = F.col("status") == "active"
    contacts = asked(on(f.contact_type, lambda: active & (F.col("contact_type") == f.contact_type)), active & F.col("verified_at").isNotNull() if f.official_contact else None)
    sources = asked(on(f.source_type, lambda: F.col("source_type") == f.source_type))
    runs = asked(on(f.run, lambda: F.col("run_id") == f.run))
    for name, conditions in (("accounts", accounts), ("products", products), ("contacts", contacts), ("sources", sources), ("run_sellers", runs)):
        if conditions:
            s = _has_each(s, rel[name], conditions)
    if f.duplicate_status is not None:
        s = R.semi_any(s, rel["decisions"].filter(F.col("status") == f.duplicate_status), "id", ["candidate_id", "matched_id"])
    return s


def contact_counts(contacts: DataFrame) -> DataFrame:
    """seller_id, contact_count, contact_types of active contacts."""
    active = contacts.filter("status = 'active'")
    return active.groupBy("seller_id").agg(F.count("*").alias("contact_count"), F.array_join(F.array_sort(F.collect_set("contact_type")), ",").alias("contact_types"))


#: What the sorts of sellers look at.
SORT_KEYS = ["first_seen_at", "updated_at", "confidence", "name", "last_seen_at"]


def _page_first(rows: DataFrame, order: list[Column], limit: int | None, offset: int | None) -> DataFrame:
    """The page of rows (ids and sort keys only) with the total, stored: a page at most, 100 rows.

    rows are computed once and kept while they are counted and the page is drawn from them.
    """
    return cut(R.page(cut(rows), order, limit, offset))


def list_sellers(rel: dict[str, DataFrame], f: Facets) -> DataFrame:
    """A page of sellers with their latest account, latest duplicate status, contacts, and the total.

    Facets give ids and sort keys; the page is stored, and everything else is looked up for
    its sellers, with one scan of each relation.
    """
    s = seller_facets(rel, f).select("id", *[c for c in SORT_KEYS if c in rel["sellers"].columns])
    if f.sort == "most_contacts":
        n = rel["contacts"].filter("status = 'active'").groupBy(F.col("seller_id").alias("__s")).agg(F.count("*").alias("n_contacts"))
        s = s.join(n, F.col("id") == F.col("__s"), "left").drop("__s")
    order = SORTS.get(f.sort, lambda: [F.desc("last_seen_at")])()
    page = F.broadcast(_page_first(s, [*order, F.asc("id")], f.limit, f.offset).select(F.col("id").alias("__own"), "total"))  # a page at most
    mine = lambda df, key="seller_id": df.join(page.select("__own"), F.col(key) == F.col("__own")).drop("__own")
    account = R.latest(mine(rel["accounts"]), "seller_id", ["last_seen", "id"], ["marketplace", "display_name"]).withColumnRenamed("seller_id", "__account")
    ends = rel["decisions"].select("id", "created_at", F.col("status").alias("duplicate_status"), F.explode(F.array_distinct(F.array("candidate_id", "matched_id"))).alias("seller_id"))
    duplicate = R.latest(mine(ends), "seller_id", ["created_at", "id"], ["duplicate_status"]).withColumnRenamed("seller_id", "__duplicate")
    counts = contact_counts(mine(rel["contacts"])).withColumnRenamed("seller_id", "__counts")
    out = rel["sellers"].join(page, F.col("id") == F.col("__own")).drop("__own")
    for side in (account, duplicate, counts):
        out = out.join(side, F.col("id") == F.col(side.columns[0]), "left")
    return out.withColumn("contact_count", F.coalesce("contact_count", F.lit(0)).cast("long")).drop("__account", "__duplicate", "__counts")


def visible_contacts(contacts: DataFrame, suppressions: DataFrame, as_of: Column) -> DataFrame:
    """Active contacts that no unexpired suppression names by seller or by hash."""
    return R.anti_any(contacts.filter("status = 'active'"), R.unexpired(suppressions, "expires_at", as_of), {"seller_id": "seller_id", "hash": "hash"})


def list_contacts(rel: dict[str, DataFrame], f: Facets, as_of: Column) -> DataFrame:
    """A page of visible contacts with their seller's name and country, their source's type, and the total."""
    on = lambda value, cond: None if value is None else cond()
    c = visible_contacts(rel["contacts"], rel["suppressions"], as_of).filter(
        R.conjunction(
            [
                on(f.seller, lambda: F.col("seller_id") == f.seller),
                on(f.contact_type, lambda: F.col("contact_type") == f.contact_type),
                on(f.confidence, lambda: F.col("confidence") >= f.confidence),
                on(f.verified, lambda: F.col("verified_at").isNotNull() == f.verified),
            ]
        )
    )
    if f.country is not None:
        c = _has(c, rel["sellers"].filter(F.upper("country") == f.country.upper()), "id", "seller_id")
    if f.query and S.parse(f.query):
        c = _has(c, S.match(rel["index"], "seller_id", f.query), "seller_id", "seller_id")
    if f.source_type is not None:
        c = _has(c, rel["sources"].filter(F.col("source_type") == f.source_type), "id", "source_id")
    rows = _page_first(c.select("id", "last_seen"), [F.desc("last_seen"), F.asc("id")], f.limit, f.offset).select(F.col("id").alias("__own"), "total")
    rows = cut(rel["contacts"].join(F.broadcast(rows), F.col("id") == F.col("__own")).drop("__own"))
    s = rel["sellers"].select(F.col("id").alias("__s"), F.col("name").alias("seller_name"), F.col("country").alias("seller_country"))
    t = rel["sources"].select(F.col("id").alias("__t"), "source_type")
    page = F.broadcast(rows)  # a page at most
    out = s.join(page, F.col("seller_id") == F.col("__s"), "right").drop("__s")
    return t.join(F.broadcast(out), F.col("source_id") == F.col("__t"), "right").drop("__t")


def list_duplicates(rel: dict[str, DataFrame], status: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page of decisions with both names and the total, highest score first."""
    x = rel["decisions"] if status is None else rel["decisions"].filter(F.col("status") == status)
    s = rel["sellers"]
    rows = R.page(x, [F.desc("score"), F.asc("id")], limit, offset)
    for key, name in (("candidate_id", "candidate_name"), ("matched_id", "matched_name")):
        side = s.select(F.col("id").alias("__s"), F.col("name").alias(name))
        rows = side.join(F.broadcast(rows), F.col(key) == F.col("__s"), "right").drop("__s")
    return rows


def list_runs(events: DataFrame, state: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page of runs with their latest state, when it came, counters, and the total, newest first. events: id, run_id, state, happened."""
    runs = events.groupBy("run_id").agg(
        F.max_by("state", F.struct("happened", "id")).alias("state"),
        F.max("happened").alias("last_event_at"),
        F.count("*").alias("n_events"),
        F.count_if(F.col("state") == "error").alias("errors"),
    )
    return R.page(runs if state is None else runs.filter(F.col("state") == state), [F.desc("last_event_at"), F.asc("run_id")], limit, offset)


def metrics(rel: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """One row of counters: sellers, those active and with a website, contacts, pending duplicates, failures of the last seven days."""
    one = rel["sellers"].agg(F.count("*").alias("sellers"), F.count_if(F.col("status") == "active").alias("active_sellers"), F.count_if(F.col("domain").isNotNull()).alias("official_sites"))
    two = rel["contacts"].agg(F.count_if(F.col("status") == "active").alias("contacts"), F.count_distinct(F.when(F.col("verified_at").isNotNull(), F.col("seller_id"))).alias("verified_sellers"))
    three = rel["decisions"].agg(F.count_if(F.col("status") == "pending").alias("pending_duplicates"))
    recent = (F.col("state") == "error") & (F.col("happened") >= as_of - F.expr("INTERVAL 7 DAYS")) & (F.col("happened") < as_of)
    four = rel["log"].agg(F.count_if(recent).alias("recent_failures"), F.count_distinct("run_id").alias("runs"))
    return one.join(F.broadcast(two)).join(F.broadcast(three)).join(F.broadcast(four))


def api_shape(rows: DataFrame) -> DataFrame:
    """rows with their columns' names in camel case."""
    camel = lambda c: "".join(w if i == 0 else w.capitalize() for i, w in enumerate(c.split("_")))
    return rows.select(*[F.col(c).alias(camel(c)) for c in rows.columns])


def reveal(contacts: DataFrame, suppressions: DataFrame, key: Column, actor: str, reason: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(opened, audit): id, contact_type and value of the contacts that may be opened, and an audit event for each that could be.

    contacts: what was asked for, with ciphertext. Only active contacts that nobody
    suppresses at that time are opened, so a suppressed one is as if it weren't there. A
    value opens only under its own contact's id, seller and type.
    """
    from heddle.functions.ids import open_sealed, uuid7

    may = visible_contacts(contacts, suppressions, at)
    opened = may.withColumn("value", open_sealed(F.col("ciphertext"), key, contact_aad()))
    event = F.concat_ws(":", F.lit("reveal"), F.lit(actor), F.col("id"), at.cast("string"))
    audit = opened.filter("value IS NOT NULL").select(
        uuid7("audit", event).alias("id"), F.lit("contact_revealed").alias("event_type"), F.lit("contact").alias("entity_type"), F.col("id").cast("string").alias("entity_id"),
        F.lit(actor).alias("actor_id"), F.col("hash").alias("old_value_hash"), F.lit(reason).alias("reason"), at.alias("created_at"),
    )
    return opened.select("id", "contact_type", "value"), audit


def contact_aad() -> Column:
    """What a contact's sealed value is bound to."""
    return F.concat_ws(":", F.lit("contact"), F.col("id"), F.col("seller_id"), F.col("contact_type"))


def seller_detail(rel: dict[str, DataFrame], seller, as_of: Column, most: int = R.LIMIT_MAX) -> DataFrame:
    """Everything about one seller: part (seller, alias, contact, evidence, duplicate), rank, id, label.

    Each part has its own order and at most most rows. Contacts are those that nobody suppresses.
    """
    mine = lambda name: rel[name].filter(F.col("seller_id") == seller)
    text = lambda c: F.col(c).cast("string")
    ends = rel["decisions"].filter((F.col("candidate_id") == seller) | (F.col("matched_id") == seller))
    parts = [
        ("seller", rel["sellers"].filter(F.col("id") == seller).select("id", text("name").alias("label"), F.lit(0).alias("o")), [F.asc("o")]),
        ("alias", mine("aliases").select("id", text("alias").alias("label"), F.col("alias").alias("o")), [F.asc("o")]),
        ("contact", visible_contacts(mine("contacts"), rel["suppressions"], as_of).select("id", text("contact_type").alias("label"), F.col("last_seen").alias("o")), [F.desc("o")]),
        ("evidence", mine("sources").select("id", text("source_type").alias("label"), F.col("first_seen_at").alias("o")), [F.desc("o")]),
        ("duplicate", ends.select("id", text("status").alias("label"), F.col("score").alias("o")), [F.desc("o")]),
    ]
    out = None
    for name, rows, order in parts:
        top = rows.orderBy(*order, F.asc("id")).limit(most)
        ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order, F.asc("id"))))  # at most most rows
        ranked = ranked.select(F.lit(name).alias("part"), "rank", "id", "label")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def export_sellers(rel: dict[str, DataFrame], f: Facets, columns: list[str], rows: int = EXPORT_ROWS) -> DataFrame:
    """(place, line) of the CSV rows of the sellers that the facets leave, in the listing's order, at most rows; formula-safe."""
    order = SORTS.get(f.sort, lambda: [F.desc("last_seen_at")])()
    s = seller_facets(rel, f)
    if f.sort == "most_contacts":
        n = rel["contacts"].filter("status = 'active'").groupBy(F.col("seller_id").alias("__s")).agg(F.count("*").alias("n_contacts"))
        s = s.join(n, F.col("id") == F.col("__s"), "left")
    top = s.orderBy(*order, F.asc("id")).limit(rows)
    place = F.row_number().over(Window.orderBy(*order, F.asc("id")))  # at most rows
    return top.select(place.alias("place"), F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns]).alias("line"))
