"""Queries of linking: components over exact keys, chains of redirects, similar sets, numbering plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import extraction as E
from heddle.operators import linking as L
from heddle.operators import resolution as X
from heddle.plans.registry import query, table
from heddle.sources.domain import oracle, relation

#: Keys of the sellers as SQL that Spark and DuckDB both run: what a contact says, a marketplace token, a name with its place; a registration number is exclusive.
_KEYS = """SELECT seller_id AS id, 'contact' AS kind, concat(hash, '/', contact_type, '/', CAST(confidence AS STRING)) AS value FROM contacts WHERE status = 'active'
  UNION ALL SELECT o_custkey AS id, 'token' AS kind, concat(o_orderpriority, '/', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)) AS value FROM {orders}
  UNION ALL SELECT c_custkey AS id, 'place' AS kind, concat(CAST(c_nationkey AS STRING), '/', c_mktsegment, '/', CAST(CAST(floor(c_acctbal / 50) AS BIGINT) AS STRING)) AS value FROM {customer}
  UNION ALL SELECT c_custkey AS id, 'registration' AS kind, CASE WHEN c_acctbal > 9000 THEN concat(c_mktsegment, '/', CAST(c_nationkey AS STRING)) END AS value FROM {customer}"""

_COMPONENTS = """star AS (SELECT k.id, m.id AS other FROM k JOIN (SELECT kind, value, min(id) AS id FROM k WHERE value IS NOT NULL GROUP BY kind, value) m USING (kind, value)),
  both_ways AS (SELECT id, other FROM star UNION SELECT other, id FROM star),
  reach(id, other) AS (SELECT id, other FROM both_ways UNION SELECT r.id, b.other FROM reach r JOIN both_ways b ON b.id = r.other),
  comp AS (SELECT id, min(least(id, other)) AS component FROM reach GROUP BY id),
  grp AS (SELECT i.id, coalesce(component, i.id) AS component FROM (SELECT DISTINCT id FROM k) i LEFT JOIN comp USING (id)),
  torn AS (SELECT component FROM grp JOIN k USING (id) WHERE kind = 'registration' GROUP BY component HAVING count(DISTINCT value) > 1),
  alone AS (SELECT component, value, min(id) AS entity FROM grp JOIN k USING (id) WHERE kind = 'registration' AND value IS NOT NULL GROUP BY component, value)"""


def _keys(spark, d):
    return spark.sql(_KEYS.replace("contacts", "{contacts}"), contacts=relation(spark, d, "contacts"), orders=table(spark, d, "orders"), customer=table(spark, d, "customer"))


@query(
    "sellers_linked",
    oracle("WITH RECURSIVE k AS (" + _KEYS.replace("{", "").replace("}", "") + f"), {_COMPONENTS}"
    """ SELECT g.id, CASE WHEN t.component IS NULL THEN g.component ELSE coalesce((SELECT min(a.entity) FROM k JOIN alone a ON a.component = g.component AND k.value = a.value WHERE k.id = g.id AND k.kind = 'registration'), g.id) END AS entity, t.component IS NOT NULL AS conflict
    FROM grp g LEFT JOIN torn t ON t.component = g.component"""),
)
def sellers_linked(spark, d):
    return L.link_by_keys(_keys(spark, d), ["registration"])


_LAST = "SELECT candidate_id AS source_id, arg_max(matched_id, (created_at, id)) AS target_id FROM decisions WHERE status = 'merged' GROUP BY candidate_id"


def _merged(spark, d):
    merged = relation(spark, d, "decisions").filter("status = 'merged'")
    rows = merged.select(F.col("candidate_id").alias("source_id"), F.col("matched_id").alias("target_id"), "created_at", "id")
    return L.latest_of_each(rows, ["created_at", "id"])


_WALK = f"""r AS ({_LAST}),
  walk(source_id, here, path) AS (SELECT source_id, target_id, [source_id] FROM r UNION ALL SELECT w.source_id, r.target_id, list_append(w.path, w.here) FROM walk w JOIN r ON r.source_id = w.here WHERE NOT list_contains(w.path, w.here)),
  ends AS (SELECT w.source_id, w.here, w.path FROM walk w LEFT JOIN r ON r.source_id = w.here WHERE r.source_id IS NULL OR list_contains(w.path, w.here)),
  last AS (SELECT source_id, CASE WHEN list_contains(path, here) THEN list_min(list_slice(path, list_position(path, here), len(path))) ELSE here END AS last_id, CASE WHEN NOT list_contains(path, here) THEN CAST(len(path) AS BIGINT) END AS hops, list_contains(path, here) AS cycle FROM ends)"""


@query("redirect_chains", oracle(f"WITH RECURSIVE {_WALK} SELECT * FROM last"))
def redirect_chains(spark, d):
    """Where each merged seller's chain of redirects ends; the latest merge of a seller holds."""
    return L.last_targets(_merged(spark, d))


@query("er_chained_children", oracle(f"WITH RECURSIVE {_WALK} SELECT a.id, coalesce(last_id, seller_id) AS seller_id FROM accounts a LEFT JOIN last ON a.seller_id = source_id"))
def er_chained_children(spark, d):
    """Accounts of merged sellers at the last seller of the chain."""
    return X.repoint(relation(spark, d, "accounts"), _merged(spark, d), follow=True).select("id", "seller_id")


_BASKETS = "SELECT o_custkey AS id, p_brand AS token FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey WHERE l_quantity >= 46"


@query(
    "brand_overlap",
    f"""WITH b AS ({_BASKETS.replace("{", "").replace("}", "")}), s AS (SELECT id, list(DISTINCT token ORDER BY token) AS t FROM b GROUP BY id), u AS (SELECT min(id) AS id, t FROM s GROUP BY t),
    p AS (SELECT x.id AS one, y.id AS two, len(x.t) AS n, len(y.t) AS m, len(list_intersect(x.t, y.t)) AS c FROM u x JOIN u y ON x.id < y.id AND 5 * len(x.t) >= 3 * len(y.t) AND 5 * len(y.t) >= 3 * len(x.t))
    SELECT one, two, CAST(n AS INTEGER) AS size_one, CAST(m AS INTEGER) AS size_two, CAST(c AS INTEGER) AS common FROM p WHERE 5 * c >= 3 * (n + m - c)""",
)
def brand_overlap(spark, d):
    """Pairs of different brand sets, of customers' large orders, with a Jaccard similarity of 0.6 or more."""
    rows = spark.sql(_BASKETS, **{t: table(spark, d, t) for t in ("lineitem", "orders", "part")})
    return L.similar_sets(rows.groupBy("id").agg(F.collect_set("token").alias("tokens")))[0]


#: A customer's number as people write it, from its own columns: lengths from five digits on, with and without signs, trunk prefixes and codes.
_PHONE = """CASE CAST(floor(abs(c_acctbal)) AS BIGINT) % 6 WHEN 0 THEN concat('+', cc, ' ', num) WHEN 1 THEN concat('00', cc, '-', num) WHEN 2 THEN concat('(0', substr(num, 1, 3), ') ', substr(num, 4)) WHEN 3 THEN num WHEN 4 THEN concat('tel:+', cc, '(0)', num) END"""
_CODES = ["1", "44", "86", "49", "33", "39", "34", "91", "61", "852", "886", "81", "82", "7", "55", "52", "90", "62", "84", "66", "60", "65", "63", "92", "880"]
_REGIONS = ["US", "GB", "CN", "DE", "FR", "IT", "ES", "IN", "AU", "HK", "TW", "JP", "KR", "RU", "BR", "MX", "TR", "ID", "VN", "TH", "MY", "SG", "PH", "PK", "BD"]


def _pick(values):
    return "CASE c_nationkey " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_NUMBERS = f"""SELECT c_custkey AS id, {_pick(_REGIONS)} AS region, {_PHONE} AS raw FROM
  (SELECT *, {_pick(_CODES)} AS cc, concat(CAST(2 + c_custkey % 7 AS STRING), CAST(CAST(floor(abs(c_acctbal) * 1000003) AS BIGINT) AS STRING)) AS num FROM {{customer}}) x"""
_PLANS = ", ".join(f"('{code}', {low}, {high}, '{trunk}')" for code, (low, high, trunk) in E.NUMBERING.items())


@query(
    "phones_planned",
    f"""WITH n AS ({_NUMBERS.replace("{customer}", "customer")}), plans(code, low, high, trunk) AS (VALUES {_PLANS}), regions(region, code) AS (VALUES {", ".join(f"('{r}', '{c}')" for r, c in E.REGIONS.items())}),
    a AS (SELECT id, region, regexp_replace(replace(raw, '(0)', ''), '[^0-9+]', '', 'g') AS t FROM n),
    b AS (SELECT id, CASE WHEN t LIKE '+%' THEN substr(t, 2) WHEN t LIKE '00%' THEN substr(t, 3) WHEN region IN ('US', 'CA') AND t LIKE '011%' THEN substr(t, 4) END AS whole, t, region FROM a),
    c AS (SELECT b.id, whole, t, p.* FROM b JOIN regions r USING (region) JOIN plans p ON p.code = r.code),
    e AS (SELECT id, coalesce(whole, code || CASE WHEN trunk <> '' AND starts_with(t, trunk) AND length(t) - length(trunk) BETWEEN low AND high THEN substr(t, length(trunk) + 1) ELSE t END) AS digits FROM c),
    f AS (SELECT e.id, digits, p.code, low, high FROM e JOIN plans p ON starts_with(digits, p.code) QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY length(p.code) DESC) = 1)
    SELECT n.id, CASE WHEN length(digits) - length(code) BETWEEN low AND high AND length(digits) <= 15 THEN '+' || digits END AS phone FROM n LEFT JOIN f USING (id)""",
)
def phones_planned(spark, d):
    """Customers' numbers by the numbering plans of their countries."""
    rows = spark.sql(_NUMBERS, customer=table(spark, d, "customer"))
    return rows.select("id", E.planned_phone(F.col("raw"), F.col("region")).alias("phone"))

