"""Queries of records, policies, health and small functions, over rows made from the driver tables so that SQL knows the answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators import extraction as E
from heddle.operators import health as H
from heddle.operators import marketplace as M
from heddle.operators import records as Rec
from heddle.operators import resolution as X
from heddle.plans.registry import query, table
from heddle.sources import batches as B
from heddle.sources.domain import oracle, relation


def _uuid(namespace: str, value: str) -> str:
    """The id of a value, in DuckDB's SQL."""
    h = f"sha256('{namespace}:' || {value})"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-7' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@query(
    "account_records",
    f"""WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'TOKEN' || c_custkey END AS token, 'Shop ' || c_custkey AS name FROM customer)
    SELECT {_uuid('account', "('m:' || coalesce(token, lower(name)))")} AS id, CAST(k AS VARCHAR) AS seller_id, token AS merchant_token, name AS display_name, 'active' AS status FROM a""",
)
def account_records(spark, d):
    k = F.col("c_custkey").cast("string")
    found = table(spark, d, "customer").select(k.alias("seller_id"), F.lit("m").alias("marketplace"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("TOKEN"), k)).alias("merchant_token"), F.concat(F.lit("Shop "), k).alias("display_name"), F.lit(None).cast("string").alias("profile_url"))
    return Rec.account_records(found, F.lit("2024")).select("id", "seller_id", "merchant_token", "display_name", "status")


@query(
    "alias_records",
    f"""WITH a AS (SELECT c_nationkey AS k, lower(c_mktsegment) AS n, min(c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' LTD' ELSE '' END) AS alias FROM customer GROUP BY 1, 2)
    SELECT {_uuid('alias', "(CAST(k AS VARCHAR) || ':' || n)")} AS id, CAST(k AS VARCHAR) AS seller_id, alias, n AS normalized_alias FROM a""",
)
def alias_records(spark, d):
    alias = F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, " LTD").otherwise(""))
    found = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("seller_id"), alias.alias("alias"))
    return Rec.alias_records(found, F.lit("2024")).select("id", "seller_id", "alias", "normalized_alias")


@query(
    "product_records",
    f"""SELECT {_uuid('product', "(CAST(p_size AS VARCHAR) || ':' || CASE WHEN p_partkey % 2 = 0 THEN 'https://x.com/' || p_partkey ELSE p_name || p_partkey END)")} AS id, lower(p_name) || p_partkey AS normalized_product_name,
    replace(lower(p_brand), '#', ' ') AS normalized_brand, CAST(1 AS INT) AS schema_version FROM part""",
)
def product_records(spark, d):
    k = F.col("p_partkey").cast("string")
    found = table(spark, d, "part").select(F.col("p_size").cast("string").alias("seller_id"), F.concat("p_name", k).alias("product_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://x.com/"), k)).alias("product_url"))
    return Rec.product_records(found, F.lit("2024")).select("id", "normalized_product_name", "normalized_brand", "schema_version")


@query(
    "source_records",
    f"""SELECT {_uuid('source', "('https://shop' || c_custkey || '.com/x')")} AS id, 'https://shop' || c_custkey || '.com/x' AS canonical_url, 'shop' || c_custkey || '.com' AS source_domain, 'official_site' AS source_type FROM customer""",
)
def source_records(spark, d):
    k = F.col("c_custkey").cast("string")
    pages = table(spark, d, "customer").select(k.alias("seller_id"), F.concat(F.lit("HTTPS://www.Shop"), k, F.lit(".com:443/a/../x/?q=1")).alias("url"), F.lit("t").alias("title"), F.lit("h").alias("content_hash"), F.lit("e").alias("evidence_snippet"))
    return Rec.source_records(pages, F.lit("2024")).select("id", "canonical_url", "source_domain", "source_type")


@query(
    "contact_records",
    f"""SELECT {_uuid('contact', "(CAST(c_custkey AS VARCHAR) || ':email:sales@shop' || c_custkey || '.com')")} AS id, sha256('contact' || chr(0) || 'sales@shop' || c_custkey || '.com') AS normalized_hash, 'sales@shop' || c_custkey || '.com' AS opened, true AS sealed FROM customer""",
)
def contact_records(spark, d):
    from heddle.functions.ids import open_sealed

    k = F.col("c_custkey").cast("string")
    value = F.concat(F.lit("sales@shop"), k, F.lit(".com"))
    found = table(spark, d, "customer").select(k.alias("seller_id"), F.lit("s").alias("source_id"), F.lit("email").alias("contact_type"), value.alias("value"), F.lit("sa***").alias("masked"), F.lit("c").alias("classification"), F.lit(80).alias("confidence"))
    key, nonce = F.lit(b"0123456789abcdef0123456789abcdef"), F.unhex(F.substring(F.sha2("seller_id", 256), 1, 24))
    r = Rec.contact_records(found, key, nonce, F.lit("2024"))
    c = F.col("contact_value_ciphertext")
    return r.select("id", "normalized_hash", open_sealed(c, key, F.lit("contacts")).alias("opened"), c.rlike(B.ENVELOPE).alias("sealed"))


@query(
    "seller_records",
    f"""SELECT {_uuid('seller', "('amazon.com:' || CASE WHEN c_custkey % 2 = 0 THEN 'T' || c_custkey ELSE 'shop ' || c_custkey END)")} AS id, 'Shop ' || c_custkey AS canonical_name, 'shop ' || c_custkey AS normalized_name,
    CAST(25 + CASE WHEN c_custkey % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 15 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 25 ELSE 0 END AS INT) AS quality_score FROM customer""",
)
def seller_records(spark, d):
    k = F.col("c_custkey")
    when = lambda m, c: F.when(k % m == 0, c)
    shop = F.concat(F.lit("Shop "), k.cast("string"))
    found = table(spark, d, "customer").select(
        F.lit("amazon.com").alias("marketplace"), when(2, F.concat(F.lit("T"), k.cast("string"))).alias("merchant_token"), shop.alias("display_name"), F.lit(None).cast("string").alias("business_name"),
        when(3, F.lit("Leeds")).alias("public_location"), F.lit("GB").alias("country_code"), when(5, F.lit("https://shop.com/")).alias("official_website_url"),
    )
    return M.seller_records(found, F.lit("2024")).select("id", "canonical_name", "normalized_name", "quality_score")


@query("identity_confidences", "SELECT c_custkey AS id, CAST(CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 80 ELSE 60 END WHEN 1 THEN CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN 90 ELSE 75 END WHEN 2 THEN 80 END AS INT) AS confidence FROM customer")
def identity_confidences(spark, d):
    k = F.col("c_custkey")
    seen = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'seller_page' WHEN 2 THEN 'official_site' ELSE 'elsewhere' END")
    return table(spark, d, "customer").select(k.alias("id"), Rec.identity_confidence(seen, F.when(k % 3 == 0, "t"), F.when(k % 5 == 0, "n")).alias("confidence"))


@query("first_names", oracle("SELECT domain, arg_min(name, (first_seen_at, id)) AS name FROM sellers WHERE domain IS NOT NULL GROUP BY domain"))
def first_names(spark, d):
    return Rec.first_names(relation(spark, d, "sellers"), ["first_seen_at", "id"])


@query("approved_domains", "SELECT c_custkey AS id, array_to_string(CASE c_custkey % 3 WHEN 0 THEN ['a', 'b', 'c'] WHEN 1 THEN ['a', 'b'] ELSE ['b', 'c'] END, ',') AS domains FROM customer")
def approved_domains(spark, d):
    known = F.expr("CASE WHEN c_custkey % 3 < 2 THEN array('a', 'b', 'a') END")
    new = F.expr("CASE WHEN c_custkey % 3 <> 1 THEN array('b', 'c') END")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(Rec.approved_domains(known, new), ",").alias("domains"))


@query("run_totals", oracle("WITH b AS (SELECT run_id, id % 7 AS batch_number, max(CAST(floor(value) AS BIGINT)) AS n FROM log GROUP BY 1, 2) SELECT run_id, batch_number, CAST(sum(n) OVER (PARTITION BY run_id ORDER BY batch_number) AS BIGINT) AS total_found FROM b"))
def run_totals(spark, d):
    log = relation(spark, d, "log").selectExpr("run_id", "id % 7 AS batch_number", "CAST(floor(value) AS BIGINT) AS contacts_found")
    return Rec.run_totals(log).select("run_id", "batch_number", "total_found")


_TITLE = "concat(CASE c_custkey % 6 WHEN 0 THEN 'Home | ' WHEN 1 THEN '' WHEN 2 THEN 'Contact - ' WHEN 3 THEN 'Acme | ' WHEN 4 THEN 'Acme – ' ELSE 'Untitled page' END, CASE WHEN c_custkey % 6 < 5 THEN c_name ELSE '' END)"


@query(
    "company_titles",
    f"""SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 3 THEN 'Acme' WHEN 4 THEN 'Acme' WHEN 5 THEN 'Big Shop' ELSE {_TITLE} END AS company FROM customer""",
)
def company_titles(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), E.company_from_title(F.expr(_TITLE), F.lit("big-shop.com")).alias("company"))


@query("evidence_lines", "SELECT c_custkey AS id, 'name=' || c_name || CASE WHEN c_custkey % 2 = 0 THEN '|segment=' || c_mktsegment ELSE '' END || '|page=1' AS line FROM customer")
def evidence_lines(spark, d):
    fields = {"name": F.col("c_name"), "segment": F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), "empty": F.lit(""), "page": F.lit("1")}
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), E.evidence_line(fields).alias("line"))


@query("sitemap_urls", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'https://a.com/' || c_custkey || ',http://b.com/' ELSE 'https://c.com/' || c_custkey END AS urls FROM customer")
def sitemap_urls(spark, d):
    k = F.col("c_custkey").cast("string")
    xml = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("<urlset><url><LOC> https://a.com/"), k, F.lit(" </LOC></url><loc>http://b.com/</loc>https://no.com/"))).otherwise(F.concat(F.lit("see https://c.com/"), k, F.lit(" and more")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(E.sitemap_urls(xml), ",").alias("urls"))


@query("context_windows", "SELECT c_custkey AS id, trim(substr(repeat('x ', c_custkey % 200) || c_name || repeat(' y', 100), greatest(1, 2 * (c_custkey % 200) + 1 - 20), least(20, 2 * (c_custkey % 200)) + length(c_name) + 20)) AS near FROM customer")
def context_windows(spark, d):
    text = F.concat(F.repeat(F.lit("x "), F.col("c_custkey") % 200), "c_name", F.repeat(F.lit(" y"), 100))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.context_window(text, F.upper("c_name"), 20).alias("near"))


@query("iso_times", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN TIMESTAMP '2024-03-01 10:00:00' + to_hours(c_custkey % 24) WHEN 1 THEN TIMESTAMP '2024-03-01 08:30:00' END AS at FROM customer")
def iso_times(spark, d):
    text = F.when(F.col("c_custkey") % 3 == 0, F.date_format(F.expr("timestampadd(HOUR, CAST(c_custkey % 24 AS INT), TIMESTAMP '2024-03-01 10:00:00')"), "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("c_custkey") % 3 == 1, "2024-03-01T10:30:00+02:00").otherwise("yesterday")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.iso_time(text).cast("timestamp_ntz").alias("at"))


@query("texts_without_accents", "SELECT doc_id, strip_accents(lower(text)) AS plain FROM documents")
def texts_without_accents(spark, d):
    """All texts, which are of Latin letters here; of others DuckDB takes other marks off."""
    return table(spark, d, "documents").select("doc_id", T.without_accents(F.col("text")).alias("plain"))


@query("spool_checked", "SELECT c_custkey AS id, c_custkey % 5 <> 0 AS ok FROM customer")
def spool_checked(spark, d):
    from heddle.sources.batches import sound

    body = F.encode(F.col("c_name"), "UTF-8")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.base64(body).alias("body_base64"), F.sha2(F.when(F.col("c_custkey") % 5 == 0, F.lit("other")).otherwise(F.col("c_name")), 256).alias("body_sha256"))
    return sound(rows).select("id", "ok")


@query("spool_replay", "SELECT c_custkey AS id, CAST(2 AS INT) AS attempts FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 <> 1")
def spool_replay(spark, d):
    c = table(spark, d, "customer")
    body = F.to_json(F.struct(F.col("c_custkey").alias("id")))
    spool = c.select(body.alias("b"), F.when(F.col("c_custkey") % 5 == 0, "x").otherwise(F.sha2(body, 256)).alias("body_sha256")).select(F.base64(F.encode("b", "UTF-8")).alias("body_base64"), "body_sha256", F.lit(1).alias("attempts"))
    receipts = c.filter("c_custkey % 3 < 2").select(F.sha2(body, 256).alias("body_sha256"), F.when(F.col("c_custkey") % 3 == 1, "duplicate").otherwise("conflict").alias("receipt"))
    send, _, _ = B.replay(B.sound(spool), receipts)
    return send.select(F.get_json_object("body", "$.id").cast("long").alias("id"), "attempts")


@query("url_policies", "SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN 'scheme' WHEN 1 THEN 'credentials' WHEN 2 THEN 'private' WHEN 3 THEN 'private' WHEN 4 THEN 'robots' WHEN 5 THEN 'terms' WHEN 6 THEN 'host' END AS refused FROM customer")
def url_policies(spark, d):
    url = F.expr("CASE c_custkey % 8 WHEN 0 THEN 'ftp://a.com' WHEN 1 THEN 'https://u:p@a.com/' WHEN 2 THEN 'http://LOCALHOST:80/x' WHEN 3 THEN 'http://127.0.0.1/' WHEN 6 THEN 'https:///x' ELSE 'https://a.com/x' END")
    robots, terms = F.when(F.col("c_custkey") % 8 == 4, "deny").otherwise("respect"), F.when(F.col("c_custkey") % 8 == 5, "restricted").otherwise("low")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), M.url_policy(url, robots, terms).alias("refused"))


@query(
    "source_policies",
    """SELECT c_custkey AS id, array_to_string(list_filter([CASE WHEN c_custkey % 6 = 0 THEN 'canonical_url' END, CASE WHEN c_custkey % 6 = 1 THEN 'credentials' END, CASE WHEN c_custkey % 6 = 2 THEN 'domain' END,
    CASE WHEN c_nationkey % 2 = 0 AND c_custkey % 4 <> 0 THEN 'allow_list' END], lambda e: e IS NOT NULL), ',') AS errors FROM customer""",
)
def source_policies(spark, d):
    k = F.col("c_custkey")
    host = F.concat(F.lit("shop"), (k % 4).cast("string"), F.lit(".com"))
    user = F.when(k % 6 == 1, "u@").otherwise("")
    c = table(spark, d, "customer")
    sources = c.select(k.alias("id"), F.col("c_nationkey").alias("run_id"), F.concat(F.lit("https://"), user, host, F.lit("/x")).alias("source_url"), F.when(k % 6 == 0, "ftp://x").otherwise("https://x.com").alias("canonical_url"), F.when(k % 6 == 2, "other.com").otherwise(host).alias("source_domain"))
    allowed = c.filter("c_nationkey % 2 = 0").select(F.col("c_nationkey").alias("run_id"), F.lit("shop0.com").alias("domain")).distinct()
    return M.source_policy(sources, allowed).select("id", F.array_join("errors", ",").alias("errors"))


@query(
    "sellers_filtered",
    """SELECT c_custkey AS id FROM customer WHERE c_nationkey % 3 = 0 AND c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AND contains(lower(c_mktsegment), 'build') AND c_custkey % 7 * 10 >= 30""",
)
def sellers_filtered(spark, d):
    k = F.col("c_custkey")
    found = table(spark, d, "customer").select(
        k.alias("id"), F.when(F.col("c_nationkey") % 3 == 0, "CN").otherwise("US").alias("country_code"), F.when(k % 2 == 0, "x").alias("public_location"), F.when(k % 5 != 0, "https://x.com").alias("official_website_url"),
        F.col("c_mktsegment").alias("business_name"), F.lit(None).cast("string").alias("display_name"), (k % 7 * 10).alias("manufacturer_score"),
    )
    return found.filter(M.seller_filter(["CN", "HK"], True, True, "BUILD", "manufacturer")).select("id")


@query("marketplace_codes", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'amazon.com' WHEN 1 THEN 'amazon.co.uk' WHEN 2 THEN 'amazon.de' END AS code, CASE WHEN c_custkey % 4 < 3 AND c_custkey % 3 = 0 THEN 'SELLER' || c_custkey END AS token FROM customer")
def marketplace_codes(spark, d):
    host = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'www.amazon.com' WHEN 1 THEN 'WWW.Amazon.co.uk:443' WHEN 2 THEN 'amazon.de' ELSE 'amazon.com.evil.com' END")
    url = F.concat(F.lit("https://"), host, F.lit("/sp?x=1&seller="), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("seller"), F.col("c_custkey").cast("string"))).otherwise("no-token"))
    token = F.when(M.marketplace(url).isNotNull(), M.token(url))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), M.marketplace(url).alias("code"), token.alias("token"))


@query("decision_constraints", oracle("SELECT id, array_to_string(list_filter([CASE WHEN status = 'separate' THEN 'action' END, CASE WHEN score > 90 THEN 'score' END, CASE WHEN candidate_id % 10 = matched_id % 10 THEN 'self' END], lambda e: e IS NOT NULL), ',') AS errors FROM decisions"))
def decision_constraints(spark, d):
    action = F.when(F.col("status") == "separate", "huh").otherwise("no_merge")
    errors = X.decision_errors(action, F.col("score") + 10, F.col("candidate_id") % 10, F.col("matched_id") % 10)
    return relation(spark, d, "decisions").select("id", F.array_join(errors, ",").alias("errors"))


@query("circuit_breakers", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 100 >= 90 THEN 'stop_ingestion' WHEN s_suppkey % 100 >= 80 THEN 'stop_nonessential_writes' WHEN s_suppkey % 100 >= 70 THEN 'archive' WHEN s_suppkey % 100 >= 60 THEN 'warn' END AS action FROM supplier")
def circuit_breakers(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), H.breaker(F.col("s_suppkey") % 100, F.lit(100)).alias("action"))


@query("recrawl_plan", "SELECT c_custkey AS id, c_custkey % 7 + 5 - coalesce(CASE WHEN c_custkey % 2 = 0 THEN 3 END, 0) AS priority, CASE c_custkey % 6 WHEN 0 THEN DATE '2024-01-15' WHEN 1 THEN DATE '2024-01-31' WHEN 2 THEN DATE '2024-02-15' WHEN 3 THEN DATE '2024-03-31' WHEN 4 THEN DATE '2024-06-29' END AS due FROM customer")
def recrawl_plan(spark, d):
    k = F.col("c_custkey")
    kind = F.expr("CASE c_custkey % 6 WHEN 0 THEN 'high_value' WHEN 1 THEN 'active' WHEN 2 THEN 'no_contact' WHEN 3 THEN 'blocked' WHEN 4 THEN 'invalid' ELSE 'suppressed' END")
    return table(spark, d, "customer").select(k.alias("id"), H.priority([k % 7, F.lit(5)], [F.when(k % 2 == 0, 3)]).alias("priority"), H.next_visit(kind, F.lit("2024-01-01").cast("date")).alias("due"))


_STATE = "CASE id % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'starting' WHEN 2 THEN 'running' WHEN 3 THEN 'ingesting' WHEN 4 THEN 'enriching' WHEN 5 THEN 'completed' ELSE 'failed' END"


@query(
    "run_transitions",
    oracle(f"""WITH e AS (SELECT id, run_id, happened, {_STATE} AS state FROM log), b AS (SELECT *, lag(state) OVER (PARTITION BY run_id ORDER BY happened, id) AS before FROM e)
    SELECT id, before, CASE WHEN before IS NULL THEN state = 'queued' WHEN before IN ('completed', 'failed') THEN false WHEN state = 'failed' THEN true WHEN before = 'queued' THEN state = 'starting' WHEN before = 'starting' THEN state = 'running'
    WHEN before = 'running' THEN state IN ('ingesting', 'enriching', 'completed') WHEN before = 'ingesting' THEN state IN ('enriching', 'completed') ELSE state IN ('ingesting', 'completed') END AS allowed FROM b"""),
)
def run_transitions(spark, d):
    events = relation(spark, d, "log").withColumn("state", F.expr(_STATE))
    return H.transitions(events).select("id", "before", "allowed")


@query(
    "field_changes",
    oracle("""WITH a AS (SELECT id, name, domain FROM sellers WHERE id % 10 <> 0), b AS (SELECT id, CASE WHEN id % 7 = 0 THEN concat(name, '!') ELSE name END AS name, CASE WHEN id % 5 = 0 THEN NULL WHEN domain IS NULL THEN 'new.example' ELSE domain END AS domain FROM sellers WHERE id % 11 <> 0),
    j AS (SELECT coalesce(a.id, b.id) AS id, unnest([{'f': 'name', 'o': a.name, 'n': b.name}, {'f': 'domain', 'o': a.domain, 'n': b.domain}]) AS p FROM a FULL JOIN b ON a.id = b.id)
    SELECT id, p.f AS field, p.o AS old_value, p.n AS new_value, CASE WHEN p.o IS NOT DISTINCT FROM p.n THEN 'reverified' WHEN p.o IS NULL THEN 'added' WHEN p.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM j"""),
)
def field_changes(spark, d):
    s = relation(spark, d, "sellers")
    new = s.filter("id % 11 <> 0").selectExpr("id", "CASE WHEN id % 7 = 0 THEN concat(name, '!') ELSE name END AS name", "CASE WHEN id % 5 = 0 THEN NULL WHEN domain IS NULL THEN 'new.example' ELSE domain END AS domain")
    return H.field_changes(s.filter("id % 10 <> 0"), new, "id", ["name", "domain"])


@query("stable_json", """SELECT c_custkey AS id, '{"a":' || c_nationkey || ',"b":"' || c_name || '"' || CASE WHEN c_custkey % 2 = 0 THEN ',"c":"' || c_mktsegment || '"' ELSE '' END || '}' AS body FROM customer""")
def stable_json(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_name").alias("b"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("c"), F.col("c_nationkey").alias("a"), F.col("c_custkey").alias("id"))
    return rows.select("id", B.stable_json(["c", "a", "b"]).alias("body"))


@query("folded_texts", "SELECT p_partkey AS id, lower(p_name) || ' ss fi' AS folded FROM part")
def folded_texts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.search_text(F.concat("p_name", F.lit(" ẞ ﬁ"))).alias("folded"))


@query(
    "run_rates",
    oracle("""SELECT run_id, count(*) AS n, round(count(*) FILTER (WHERE state IN ('view', 'click')) / count(*), 9) AS success_rate, round(count(*) FILTER (WHERE state = 'purchase') / count(*), 9) AS find_rate,
    round(count(*) FILTER (WHERE state = 'error') / count(*), 9) AS error_rate, round(count(*) FILTER (WHERE state = 'purchase') / nullif(count(*) FILTER (WHERE state IN ('view', 'click')), 0), 9) AS yield FROM log GROUP BY run_id"""),
)
def run_rates(spark, d):
    r = H.rates(relation(spark, d, "log"), "run_id", ["view", "click"], ["purchase"], ["error"])
    return r.withColumns({c: F.round(c, 9) for c in ("success_rate", "find_rate", "error_rate", "yield")})
