"""Queries of the read side: listings, facets, counters, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import listing as L
from heddle.operators import relational as R
from heddle.plans.registry import query
from heddle.sources.domain import oracle, relation
from heddle.streaming.ingest import by_day, latest_states

AS_OF = "2024-01-15 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _sell(spark, d):
    return relation(spark, d, "sellers").filter("status <> 'merged'")


def visible(spark, d):
    return L.visible_contacts(relation(spark, d, "contacts"), relation(spark, d, "suppressions"), as_of())


VISIBLE = f"""vis AS (SELECT * FROM contacts c WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM suppressions s
  WHERE (s.seller_id = c.seller_id OR s.hash = c.hash) AND (s.expires_at IS NULL OR s.expires_at > TIMESTAMP '{AS_OF}')))"""


@query("contacts_visible", oracle(f"WITH {VISIBLE} SELECT id, seller_id, contact_type, confidence FROM vis"))
def contacts_visible(spark, d):
    return visible(spark, d).select("id", "seller_id", "contact_type", "confidence")


@query("contacts_filtered", oracle(f"WITH {VISIBLE} SELECT id, seller_id, confidence FROM vis WHERE confidence >= 50 AND verified_at IS NOT NULL AND contact_type = 'click'"))
def contacts_filtered(spark, d):
    conditions = [F.col("confidence") >= 50, F.col("verified_at").isNotNull(), None, F.col("contact_type") == "click"]
    return visible(spark, d).filter(R.conjunction(conditions)).select("id", "seller_id", "confidence")


@query("contacts_page_with_total", oracle(f"WITH {VISIBLE} SELECT id, last_seen, (SELECT count(*) FROM vis) AS total FROM vis ORDER BY last_seen DESC, id LIMIT 100 OFFSET 20"))
def contacts_page_with_total(spark, d):
    return R.page(visible(spark, d).select("id", "last_seen"), [F.desc("last_seen"), F.asc("id")], 999, 20)


@query(
    "contacts_enriched",
    oracle(f"WITH {VISIBLE} SELECT v.id, v.contact_type, s.name AS seller_name, s.country FROM vis v LEFT JOIN sellers s ON s.id = v.seller_id"),
)
def contacts_enriched(spark, d):
    s = relation(spark, d, "sellers").select(F.col("id").alias("sid"), F.col("name").alias("seller_name"), "country")
    return visible(spark, d).join(s, F.col("seller_id") == F.col("sid"), "left").select("id", "contact_type", "seller_name", "country")


@query(
    "contact_metadata",
    oracle("SELECT seller_id, count(*) AS contact_count, string_agg(DISTINCT contact_type, ',' ORDER BY contact_type) AS contact_types FROM contacts WHERE status = 'active' GROUP BY seller_id"),
)
def contact_metadata(spark, d):
    c = relation(spark, d, "contacts").filter("status = 'active'")
    return c.groupBy("seller_id").agg(F.count("*").alias("contact_count"), F.array_join(F.array_sort(F.collect_set("contact_type")), ",").alias("contact_types"))


@query(
    "seller_contact_rank",
    oracle("""WITH n AS (SELECT seller_id, count(*) AS n FROM contacts WHERE status = 'active' GROUP BY seller_id)
    SELECT s.id, coalesce(n.n, 0) AS n_contacts FROM sellers s LEFT JOIN n ON n.seller_id = s.id WHERE s.status <> 'merged' ORDER BY n DESC NULLS LAST, s.id LIMIT 50"""),
)
def seller_contact_rank(spark, d):
    n = relation(spark, d, "contacts").filter("status = 'active'").groupBy("seller_id").agg(F.count("*").alias("n"))
    s = _sell(spark, d).join(n, F.col("id") == F.col("seller_id"), "left")
    return s.orderBy(F.desc_nulls_last("n"), "id").limit(50).select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_contacts"))


@query("sellers_by_marketplace", oracle("SELECT id, name FROM sellers s WHERE status <> 'merged' AND EXISTS (SELECT 1 FROM accounts a WHERE a.seller_id = s.id AND a.marketplace = '1-URGENT')"))
def sellers_by_marketplace(spark, d):
    a = relation(spark, d, "accounts").filter("marketplace = '1-URGENT'").select("seller_id")
    return _sell(spark, d).join(a, F.col("id") == a["seller_id"], "left_semi").select("id", "name")


@query(
    "sellers_by_brand_like",
    oracle("SELECT id, name FROM sellers s WHERE status <> 'merged' AND EXISTS (SELECT 1 FROM products p WHERE p.seller_id = s.id AND contains(lower(p.brand), 'brand#1') AND contains(lower(p.category), 'e'))"),
)
def sellers_by_brand_like(spark, d):
    p = relation(spark, d, "products").filter(R.like_contains(F.col("brand"), "Brand#1") & R.like_contains(F.col("category"), "E")).select("seller_id")
    return _sell(spark, d).join(p, F.col("id") == p["seller_id"], "left_semi").select("id", "name")


@query(
    "sellers_by_duplicate_status",
    oracle("SELECT id, status FROM sellers s WHERE EXISTS (SELECT 1 FROM decisions x WHERE x.status = 'pending' AND (x.candidate_id = s.id OR x.matched_id = s.id))"),
)
def sellers_by_duplicate_status(spark, d):
    pending = relation(spark, d, "decisions").filter("status = 'pending'")
    return R.semi_any(relation(spark, d, "sellers"), pending, "id", ["candidate_id", "matched_id"]).select("id", "status")


@query(
    "sellers_facets_intersect",
    oracle("""SELECT id FROM sellers WHERE status <> 'merged' AND id IN (SELECT seller_id FROM accounts WHERE marketplace = '2-HIGH')
    AND id IN (SELECT seller_id FROM contacts WHERE contact_type = 'click' AND status = 'active') AND id IN (SELECT candidate_id FROM decisions WHERE score >= 50)"""),
)
def sellers_facets_intersect(spark, d):
    s = _sell(spark, d).select("id")
    for rel, cond, key in (("accounts", "marketplace = '2-HIGH'", "seller_id"), ("contacts", "contact_type = 'click' AND status = 'active'", "seller_id"), ("decisions", "score >= 50", "candidate_id")):
        side = relation(spark, d, rel).filter(cond).select(F.col(key).alias("k"))
        s = s.join(side, s["id"] == F.col("k"), "left_semi")
    return s


@query(
    "sellers_latest_account",
    oracle("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY last_seen DESC, id DESC) AS k FROM accounts)
    SELECT s.id, r.marketplace, r.last_seen FROM sellers s LEFT JOIN r ON r.seller_id = s.id AND r.k = 1 WHERE s.status <> 'merged'"""),
)
def sellers_latest_account(spark, d):
    top = R.latest(relation(spark, d, "accounts"), "seller_id", ["last_seen", "id"], ["marketplace", "last_seen"])
    return _sell(spark, d).join(top, F.col("id") == F.col("seller_id"), "left").select("id", "marketplace", "last_seen")


SORTS = {"newest": [F.desc, "id"], "name": [F.asc, "normalized_name"], "confidence": [F.desc, "confidence"]}


@query("sellers_sorted_nocase", oracle("SELECT id, name, confidence FROM sellers WHERE status <> 'merged' ORDER BY lower(name), id LIMIT 100"))
def sellers_sorted_nocase(spark, d):
    way, column = SORTS["name"]
    return _sell(spark, d).orderBy(way(column), "id").limit(100).select("id", "name", "confidence")


@query("sellers_highest_confidence", oracle("SELECT id, name, confidence FROM sellers WHERE status <> 'merged' AND confidence >= 40 AND country LIKE 'NATION_1%' AND domain IS NOT NULL ORDER BY confidence DESC, id LIMIT 25 OFFSET 5"))
def sellers_highest_confidence(spark, d):
    way, column = SORTS["confidence"]
    cond = R.conjunction([F.col("confidence") >= 40, F.col("country").startswith("NATION_1"), F.col("domain").isNotNull()])
    return _sell(spark, d).filter(cond).orderBy(way(column), "id").offset(5).limit(25).select("id", "name", "confidence")


@query("seller_by_id", oracle("SELECT id, name, country, status FROM sellers WHERE id = 42"))
def seller_by_id(spark, d):
    return relation(spark, d, "sellers").filter(F.col("id") == 42).limit(1).select("id", "name", "country", "status")


@query("seller_detail_products", oracle("SELECT DISTINCT name, brand FROM products WHERE seller_id = 7 ORDER BY name, brand LIMIT 100"))
def seller_detail_products(spark, d):
    return relation(spark, d, "products").filter("seller_id = 7").select("name", "brand").distinct().orderBy("name", "brand").limit(100)


@query("sellers_account_fanout", oracle("SELECT s.id, s.name, a.id AS account_id, a.marketplace FROM sellers s LEFT JOIN accounts a ON a.seller_id = s.id"))
def sellers_account_fanout(spark, d):
    a = relation(spark, d, "accounts").select(F.col("id").alias("account_id"), "seller_id", "marketplace")
    return relation(spark, d, "sellers").join(a, F.col("id") == F.col("seller_id"), "left").select("id", "name", "account_id", "marketplace")


@query(
    "metrics_sellers",
    oracle("""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE domain IS NOT NULL) AS official,
    (SELECT count(DISTINCT seller_id) FROM accounts WHERE starts_with(lower(marketplace), '1-')) AS marketplace_sellers FROM sellers"""),
)
def metrics_sellers(spark, d):
    s = relation(spark, d, "sellers").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("domain").isNotNull()).alias("official"))
    a = relation(spark, d, "accounts").filter(F.startswith(F.lower("marketplace"), F.lit("1-"))).agg(F.countDistinct("seller_id").alias("marketplace_sellers"))
    return s.join(F.broadcast(a))


@query(
    "metrics_contacts",
    oracle("SELECT (SELECT count(*) FROM contacts WHERE status = 'active') AS contacts, (SELECT count(*) FROM decisions WHERE status = 'pending') AS pending, (SELECT count(DISTINCT seller_id) FROM contacts WHERE verified_at IS NOT NULL) AS verified_sellers"),
)
def metrics_contacts(spark, d):
    c = relation(spark, d, "contacts")
    one = c.agg(F.count_if(F.col("status") == "active").alias("contacts"))
    two = relation(spark, d, "decisions").agg(F.count_if(F.col("status") == "pending").alias("pending"))
    three = c.filter("verified_at IS NOT NULL").agg(F.countDistinct("seller_id").alias("verified_sellers"))
    return one.join(F.broadcast(two)).join(F.broadcast(three))


@query("metrics_recent_failures", oracle(f"SELECT count(*) AS failures FROM log WHERE state = 'error' AND happened >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND happened < TIMESTAMP '{AS_OF}'"))
def metrics_recent_failures(spark, d):
    since = as_of() - F.expr("INTERVAL 7 DAYS")
    return relation(spark, d, "log").filter((F.col("state") == "error") & (F.col("happened") >= since) & (F.col("happened") < as_of())).agg(F.count("*").alias("failures"))


@query("metrics_cooldown_domains", oracle("SELECT count(DISTINCT domain) AS domains FROM sellers WHERE status = 'active' AND confidence < 30"))
def metrics_cooldown_domains(spark, d):
    return relation(spark, d, "sellers").filter("status = 'active' AND confidence < 30").agg(F.countDistinct("domain").alias("domains"))


@query(
    "duplicates_named",
    oracle("""SELECT x.id, c.name AS candidate_name, m.name AS matched_name, x.score FROM decisions x JOIN sellers c ON c.id = x.candidate_id JOIN sellers m ON m.id = x.matched_id
    WHERE x.status = 'pending'"""),
)
def duplicates_named(spark, d):
    s = relation(spark, d, "sellers")
    c = s.select(F.col("id").alias("cid"), F.col("name").alias("candidate_name"))
    m = s.select(F.col("id").alias("mid"), F.col("name").alias("matched_name"))
    x = relation(spark, d, "decisions").filter("status = 'pending'")
    return x.join(c, F.col("candidate_id") == F.col("cid")).join(m, F.col("matched_id") == F.col("mid")).select("id", "candidate_name", "matched_name", "score")


@query(
    "runs_with_counters",
    oracle("""WITH n AS (SELECT run_id, count(*) FILTER (WHERE state = 'purchase') AS found, count(*) FILTER (WHERE state = 'error') AS errors FROM log GROUP BY run_id)
    SELECT s.id AS run_id, coalesce(n.found, 0) AS found, coalesce(n.errors, 0) AS errors FROM sellers s LEFT JOIN n ON n.run_id = s.id"""),
)
def runs_with_counters(spark, d):
    n = relation(spark, d, "log").groupBy("run_id").agg(F.count_if(F.col("state") == "purchase").alias("found"), F.count_if(F.col("state") == "error").alias("errors"))
    s = relation(spark, d, "sellers").select("id").join(n, F.col("id") == F.col("run_id"), "left")
    return s.select(F.col("id").alias("run_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("found", "errors")])


@query(
    "run_stage_counts",
    oracle("SELECT run_id, count(DISTINCT CASE WHEN state = 'view' THEN id % 10 END) AS discovered, count(DISTINCT CASE WHEN state = 'purchase' THEN id % 10 END) AS enriched FROM log GROUP BY run_id"),
)
def run_stage_counts(spark, d):
    part = F.col("id") % 10
    return relation(spark, d, "log").groupBy("run_id").agg(F.countDistinct(F.when(F.col("state") == "view", part)).alias("discovered"), F.countDistinct(F.when(F.col("state") == "purchase", part)).alias("enriched"))


@query("run_latest_state", oracle("SELECT run_id, arg_max(state, (happened, id)) AS state FROM log GROUP BY run_id"))
def run_latest_state(spark, d):
    return latest_states(relation(spark, d, "log"), "run_id", "state", ["happened", "id"])


@query(
    "run_rollup",
    oracle("""SELECT run_id, count(*) AS n, count(DISTINCT state) AS states, round(sum(value), 4) AS total,
    CASE WHEN count(*) FILTER (WHERE state = 'error' AND value > 60) > 0 THEN 'blocked' WHEN count(*) FILTER (WHERE state = 'error') > 0 THEN 'failed' ELSE 'completed' END AS status FROM log GROUP BY run_id"""),
)
def run_rollup(spark, d):
    err = F.col("state") == "error"
    status = F.when(F.count_if(err & (F.col("value") > 60)) > 0, "blocked").when(F.count_if(err) > 0, "failed").otherwise("completed")
    return relation(spark, d, "log").groupBy("run_id").agg(F.count("*").alias("n"), F.countDistinct("state").alias("states"), F.round(F.sum("value"), 4).alias("total"), status.alias("status"))


@query("queue_head", oracle("SELECT id, run_id FROM log WHERE state = 'signup' ORDER BY happened, id LIMIT 1"))
def queue_head(spark, d):
    return relation(spark, d, "log").filter("state = 'signup'").orderBy("happened", "id").limit(1).select("id", "run_id")


@query(
    "cooldown_allowed",
    oracle(f"""WITH b AS (SELECT run_id, max(CASE WHEN state = 'error' THEN happened + INTERVAL 24 HOUR END) AS blocked_until FROM log GROUP BY run_id)
    SELECT run_id, blocked_until, blocked_until IS NULL OR blocked_until <= TIMESTAMP '{AS_OF}' AS allowed FROM b"""),
)
def cooldown_allowed(spark, d):
    b = relation(spark, d, "log").groupBy("run_id").agg(F.max(F.when(F.col("state") == "error", F.col("happened") + F.expr("INTERVAL 24 HOURS"))).alias("blocked_until"))
    return b.withColumn("allowed", F.col("blocked_until").isNull() | (F.col("blocked_until") <= as_of()))


@query("run_domains", oracle("SELECT DISTINCT domain, country FROM sellers WHERE domain IS NOT NULL"))
def run_domains(spark, d):
    return relation(spark, d, "sellers").filter("domain IS NOT NULL").select("domain", "country").distinct()


@query("orphan_contacts", oracle("SELECT id, seller_id FROM contacts c WHERE NOT EXISTS (SELECT 1 FROM sellers s WHERE s.id = c.seller_id AND s.status = 'active')"))
def orphan_contacts(spark, d):
    s = relation(spark, d, "sellers").filter("status = 'active'").select(F.col("id").alias("sid"))
    return relation(spark, d, "contacts").join(s, F.col("seller_id") == F.col("sid"), "left_anti").select("id", "seller_id")


@query("daily_indicators", oracle("SELECT date_trunc('day', happened) AS day, count(*) AS n, count(*) FILTER (WHERE state = 'error') AS errors FROM log GROUP BY 1"))
def daily_indicators(spark, d):
    return by_day(relation(spark, d, "log"), "happened")


@query(
    "china_bands",
    oracle("""WITH s AS (SELECT id, least(100, greatest(0, (CASE WHEN country = 'NATION_7' THEN 60 ELSE 0 END) + (CASE WHEN province = 'ASIA' THEN 20 ELSE 0 END) + confidence // 5)) AS score FROM sellers)
    SELECT id, CAST(score AS INT) AS score, CASE WHEN score >= 80 THEN 'very_likely' WHEN score >= 60 THEN 'likely' WHEN score >= 35 THEN 'possible' ELSE 'unlikely' END AS band FROM s"""),
)
def china_bands(spark, d):
    score = F.when(F.col("country") == "NATION_7", 60).otherwise(0) + F.when(F.col("province") == "ASIA", 20).otherwise(0) + F.expr("confidence div 5")
    s = relation(spark, d, "sellers").select("id", F.least(F.lit(100), F.greatest(F.lit(0), score)).cast("int").alias("score"))
    band = F.when(F.col("score") >= 80, "very_likely").when(F.col("score") >= 60, "likely").when(F.col("score") >= 35, "possible").otherwise("unlikely")
    return s.withColumn("band", band)


@query(
    "snapshot_diff",
    oracle("""WITH a AS (SELECT id, confidence, domain FROM sellers WHERE id % 10 <> 0), b AS (SELECT id, CAST(CASE WHEN id % 7 = 0 THEN confidence + 1 ELSE confidence END AS INT) AS confidence, domain FROM sellers WHERE id % 11 <> 0)
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.confidence <> b.confidence OR a.domain IS DISTINCT FROM b.domain THEN 'changed' ELSE 'reverified' END AS change
    FROM a FULL JOIN b ON a.id = b.id"""),
)
def snapshot_diff(spark, d):
    s = relation(spark, d, "sellers")
    a = s.filter("id % 10 <> 0").select("id", F.struct("confidence", "domain").alias("old"))
    b = s.filter("id % 11 <> 0").select(F.col("id").alias("bid"), F.struct(F.when(F.col("id") % 7 == 0, F.col("confidence") + 1).otherwise(F.col("confidence")).cast("int").alias("confidence"), "domain").alias("new"))
    j = a.join(b, F.col("id") == F.col("bid"), "full")
    change = F.when(F.col("id").isNull(), "added").when(F.col("bid").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("reverified")
    return j.select(F.coalesce("id", "bid").alias("id"), change.alias("change"))


@query("retention_split", oracle(f"SELECT state, count(*) FILTER (WHERE happened < TIMESTAMP '{AS_OF}') AS archive, count(*) FILTER (WHERE happened >= TIMESTAMP '{AS_OF}') AS live FROM log GROUP BY state"))
def retention_split(spark, d):
    old = F.col("happened") < as_of()
    return relation(spark, d, "log").groupBy("state").agg(F.count_if(old).alias("archive"), F.count_if(~old).alias("live"))


# whole listings


class Relations(dict):
    """The relations by name, read when they are asked for."""

    def __init__(self, spark, d):
        super().__init__()
        self.spark, self.d = spark, d

    def __missing__(self, name):
        from heddle.operators.search import stored_index
        from heddle.plans.catalogue import kept_index

        self[name] = stored_index(self.spark, kept_index(self.spark, self.d)) if name == "index" else relation(self.spark, self.d, name)
        return self[name]


_LOOKUPS = """LEFT JOIN (SELECT seller_id, arg_max(marketplace, (last_seen, id)) AS marketplace, arg_max(display_name, (last_seen, id)) AS display_name FROM accounts GROUP BY seller_id) a ON a.seller_id = p.id
  LEFT JOIN (SELECT sid, arg_max(status, (created_at, id)) AS duplicate_status FROM (SELECT id, status, created_at, candidate_id AS sid FROM decisions UNION SELECT id, status, created_at, matched_id FROM decisions) GROUP BY sid) x ON x.sid = p.id
  LEFT JOIN (SELECT seller_id, count(*) AS contact_count, string_agg(DISTINCT contact_type, ',' ORDER BY contact_type) AS contact_types FROM contacts WHERE status = 'active' GROUP BY seller_id) c ON c.seller_id = p.id"""
_SHOWN = "p.id, p.name, p.country, p.domain, a.marketplace, a.display_name, x.duplicate_status, coalesce(c.contact_count, 0) AS contact_count, c.contact_types, p.total"
_SHOWN_COLUMNS = ["id", "name", "country", "domain", "marketplace", "display_name", "duplicate_status", "contact_count", "contact_types", "total"]


@query(
    "sellers_listing",
    oracle(f"""WITH s AS (SELECT * FROM sellers s WHERE status <> 'merged' AND domain IS NOT NULL AND id IN (SELECT seller_id FROM aliases WHERE contains(lower(alias), 'building'))
      AND id IN (SELECT seller_id FROM accounts WHERE marketplace = '1-URGENT') AND id IN (SELECT seller_id FROM accounts WHERE contains(lower(display_name), 'shop 1'))
      AND id IN (SELECT seller_id FROM products WHERE contains(lower(category), 'e')) AND id IN (SELECT seller_id FROM products WHERE contains(lower(brand), '#1'))),
    n AS (SELECT seller_id, count(*) AS n FROM contacts WHERE status = 'active' GROUP BY seller_id),
    p AS (SELECT s.*, count(*) OVER () AS total FROM s LEFT JOIN n ON n.seller_id = s.id ORDER BY n DESC NULLS LAST, s.id LIMIT 20)
    SELECT {_SHOWN} FROM p {_LOOKUPS}"""),
)
def sellers_listing(spark, d):
    f = L.Facets(query="Societe BUILD", website=True, marketplace="1-URGENT", account="SHOP 1", category="E", brand="#1", sort="most_contacts", limit=20)
    return L.list_sellers(Relations(spark, d), f).select(*_SHOWN_COLUMNS)


@query(
    "sellers_listing_scored",
    oracle(f"""WITH s AS (SELECT * FROM sellers s WHERE status = 'active' AND manufacturer_score >= 30 AND trader_score >= 15 AND updated_at >= DATE '2024-01-03' AND country IN (SELECT min(country) FROM sellers WHERE id = 4)
      AND EXISTS (SELECT 1 FROM decisions x WHERE x.status = 'merged' AND (x.candidate_id = s.id OR x.matched_id = s.id))),
    p AS (SELECT *, count(*) OVER () AS total FROM s ORDER BY lower(name), id LIMIT 50)
    SELECT {_SHOWN} FROM p {_LOOKUPS}"""),
)
def sellers_listing_scored(spark, d):
    rel = Relations(spark, d)
    country = rel["sellers"].filter("id = 4").first()["country"]
    f = L.Facets(status="active", country=country.lower(), manufacturer=30, trader=15, updated_since="2024-01-03", duplicate_status="merged", sort="seller_name")
    return L.list_sellers(rel, f).select(*_SHOWN_COLUMNS)


@query(
    "sellers_listing_sourced",
    oracle(f"""WITH s AS (SELECT * FROM sellers s WHERE status <> 'merged' AND id IN (SELECT seller_id FROM contacts WHERE contact_type = 'click' AND status = 'active')
      AND id IN (SELECT seller_id FROM sources WHERE source_type = 'official_site') AND id IN (SELECT seller_id FROM run_sellers WHERE run_id = 7)),
    p AS (SELECT *, count(*) OVER () AS total FROM s ORDER BY updated_at DESC, id LIMIT 10 OFFSET 3)
    SELECT {_SHOWN} FROM p {_LOOKUPS}"""),
)
def sellers_listing_sourced(spark, d):
    f = L.Facets(contact_type="click", source_type="official_site", run=7, sort="recently_updated", limit=10, offset=3)
    return L.list_sellers(Relations(spark, d), f).select(*_SHOWN_COLUMNS)


@query(
    "contacts_listing",
    oracle(f"""WITH {VISIBLE}, c AS (SELECT * FROM vis WHERE confidence >= 20 AND verified_at IS NULL AND seller_id IN (SELECT id FROM sellers WHERE contains(lower(name), 'customer')) AND source_id IN (SELECT id FROM sources WHERE source_type = 'directory')),
    p AS (SELECT *, count(*) OVER () AS total FROM c ORDER BY last_seen DESC, id LIMIT 40)
    SELECT p.id, p.seller_id, p.contact_type, s.name AS seller_name, s.country AS seller_country, o.source_type, p.total FROM p LEFT JOIN sellers s ON s.id = p.seller_id LEFT JOIN sources o ON o.id = p.source_id"""),
)
def contacts_listing(spark, d):
    f = L.Facets(query="customer", confidence=20, verified=False, source_type="directory", limit=40)
    return L.list_contacts(Relations(spark, d), f, as_of()).select("id", "seller_id", "contact_type", "seller_name", "seller_country", "source_type", "total")


@query(
    "duplicates_page",
    oracle("""WITH p AS (SELECT *, count(*) OVER () AS total FROM decisions WHERE status = 'pending' ORDER BY score DESC, id LIMIT 30 OFFSET 10)
    SELECT p.id, p.score, c.name AS "candidateName", m.name AS "matchedName", p.total FROM p LEFT JOIN sellers c ON c.id = candidate_id LEFT JOIN sellers m ON m.id = matched_id"""),
)
def duplicates_page(spark, d):
    return L.api_shape(L.list_duplicates(Relations(spark, d), "pending", 30, 10).select("id", "score", "candidate_name", "matched_name", "total"))


@query(
    "runs_page",
    oracle("""WITH r AS (SELECT run_id, arg_max(state, (happened, id)) AS state, max(happened) AS last_event_at, count(*) AS n_events, count(*) FILTER (WHERE state = 'error') AS errors FROM log GROUP BY run_id)
    SELECT *, (SELECT count(*) FROM r WHERE state = 'view') AS total FROM r WHERE state = 'view' ORDER BY last_event_at DESC, run_id LIMIT 25"""),
)
def runs_page(spark, d):
    return L.list_runs(relation(spark, d, "log"), "view", 25)


@query(
    "metrics_all",
    oracle(f"""SELECT (SELECT count(*) FROM sellers) AS sellers, (SELECT count(*) FROM sellers WHERE status = 'active') AS active_sellers, (SELECT count(domain) FROM sellers) AS official_sites,
    (SELECT count(*) FROM contacts WHERE status = 'active') AS contacts, (SELECT count(DISTINCT seller_id) FROM contacts WHERE verified_at IS NOT NULL) AS verified_sellers, (SELECT count(*) FROM decisions WHERE status = 'pending') AS pending_duplicates,
    (SELECT count(*) FROM log WHERE state = 'error' AND happened >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND happened < TIMESTAMP '{AS_OF}') AS recent_failures, (SELECT count(DISTINCT run_id) FROM log) AS runs"""),
)
def metrics_all(spark, d):
    return L.metrics(Relations(spark, d), as_of())


@query(
    "sellers_listing_new",
    oracle(f"""WITH s AS (SELECT * FROM sellers s WHERE status <> 'merged' AND domain IS NOT NULL AND first_seen_at >= DATE '2023-02-01' AND id IN (SELECT seller_id FROM contacts WHERE status = 'active' AND verified_at IS NOT NULL)),
    p AS (SELECT *, count(*) OVER () AS total FROM s ORDER BY first_seen_at DESC, id LIMIT 15)
    SELECT {_SHOWN} FROM p {_LOOKUPS}"""),
)
def sellers_listing_new(spark, d):
    return L.list_sellers(Relations(spark, d), L.Facets(new_since="2023-02-01", official_contact=True, sort="newest", limit=15)).select(*_SHOWN_COLUMNS)
