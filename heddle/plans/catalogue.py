"""Queries of functions, extraction, search, resolution, writes and ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heddle.functions import ids, text as T
from heddle.operators import extraction as E
from heddle.operators import resolution as X
from heddle.operators import search as S
from heddle.operators import upsert as U
from heddle.operators.lineage import file_system, fingerprint, shared
from heddle.plans.registry import query, spread, table
from heddle.sources import batches as B
from heddle.sources.domain import oracle, relation
from heddle.streaming import ingest as I

# functions


@query("normalize_text", "SELECT p_partkey AS id, lower(trim(regexp_replace(regexp_replace(p_brand || ' - ' || p_name || '  (' || p_type || ')', '[[:punct:]]', ' ', 'g'), '\\s+', ' ', 'g'))) AS normalized FROM part")
def normalize_text(spark, d):
    p = table(spark, d, "part")
    raw = F.concat("p_brand", F.lit(" - "), "p_name", F.lit("  ("), "p_type", F.lit(")"))
    return p.select(F.col("p_partkey").alias("id"), T.search_text(raw).alias("normalized"))


_COMPANY = "CASE p_size % 4 WHEN 0 THEN ' Co., Ltd.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' Incorporated' ELSE '' END"


@query(
    "company_names",
    f"""WITH n AS (SELECT p_partkey AS id, p_name || {_COMPANY} AS original FROM part),
    m AS (SELECT *, lower(trim(regexp_replace(regexp_replace(original, '[[:punct:]]', ' ', 'g'), '\\s+', ' ', 'g'))) AS t FROM n)
    SELECT id, original, regexp_replace(t, '(^| )(co ltd|llc|incorporated)$', '') AS normalized, nullif(regexp_extract(t, '(^| )(co ltd|llc|incorporated)$', 2), '') AS suffix_removed FROM m""",
)
def company_names(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.col("p_name"), F.expr(_COMPANY)).alias("original"))
    c = p.select("id", T.company_name(F.col("original")).alias("c"))
    return c.select("id", "c.original", "c.normalized", "c.suffix_removed")


@query(
    "country_codes",
    """SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN 'CN' WHEN 1 THEN 'US' WHEN 2 THEN 'UK' WHEN 3 THEN 'DE' END AS code FROM nation""",
)
def country_codes(spark, d):
    name = F.expr("CASE n_nationkey % 5 WHEN 0 THEN \"People's Republic of China\" WHEN 1 THEN ' U.S.A. ' WHEN 2 THEN 'uk' WHEN 3 THEN 'Germany' ELSE 'Atlantis' END")
    n = table(spark, d, "nation")
    # "U.S.A." has spaces for its dots, which the table doesn't know
    return n.select(F.col("n_nationkey").alias("id"), T.country_code(F.replace(name, F.lit("."), F.lit(""))).alias("code"))


@query("domains", "SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '') AS domain FROM pages")
def domains(spark, d):
    return table(spark, d, "pages").select("page_id", T.domain(F.col("url")).alias("domain"))


@query(
    "address_masks",
    "SELECT s_suppkey AS id, '***, District ' || s_nationkey || ', City, Country' AS masked FROM supplier",
)
def address_masks(spark, d):
    a = F.concat(F.lit("Building "), F.col("s_suppkey"), F.lit(", "), F.col("s_name"), F.lit(" Road\nDistrict "), F.col("s_nationkey"), F.lit(", City,, Country "))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), T.masked_address(a).alias("masked"))


@query(
    "hash_ids",
    """WITH h AS (SELECT c_custkey AS id, sha256('seller' || chr(0) || c_name) AS hash, substr(sha256('seller:' || c_name), 1, 32) AS u, CAST(('0x' || substr(sha256(c_name), 1, 7)) AS BIGINT) AS batch FROM customer)
    SELECT id, hash, substr(u,1,8) || '-' || substr(u,9,4) || '-7' || substr(u,14,3) || '-8' || substr(u,18,3) || '-' || substr(u,21,12) AS uuid,
    substr(u,1,8) || '-' || substr(u,9,4) || '-7' || substr(u,14,3) || '-' || translate(substr(u,17,1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(u,18,3) || '-' || substr(u,21,12) AS uuid_masked, batch * 100 + id AS batch, true AS is_uuid FROM h""",
)
def hash_ids(spark, d):
    n = F.col("c_name")
    masked = ids.uuid7("seller", n, masked_variant=True)
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), ids.namespaced_hash("seller", n).alias("hash"), ids.uuid7("seller", n).alias("uuid"), masked.alias("uuid_masked"), ids.batch_number(n, F.col("c_custkey")).alias("batch"), ids.is_uuid7(masked).alias("is_uuid")
    )


@query(
    "masks",
    """SELECT c_custkey AS id, CASE WHEN length(c_mktsegment) <= 2 THEN substr(c_mktsegment, 1, 1) ELSE substr(c_mktsegment, 1, 2) END || '***@x.example' AS email,
    '+' || repeat('*', greatest(3, length(CAST(5550000 + c_custkey AS VARCHAR)) - 4)) || right(CAST(5550000 + c_custkey AS VARCHAR), 4) AS phone,
    substr(c_name, 1, 2) || '***' || right(c_name, 2) AS handle, substr(c_name, 1, 4) || '...' || right(c_name, 4) AS token FROM customer""",
)
def masks(spark, d):
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        ids.masked_email(F.concat("c_mktsegment", F.lit("@x.example"))).alias("email"),
        ids.masked_phone(F.concat(F.lit("+"), (F.lit(5550000) + F.col("c_custkey")).cast("string"))).alias("phone"),
        ids.masked_handle(F.col("c_name")).alias("handle"),
        ids.masked_token(F.col("c_name")).alias("token"),
    )


# pages and documents


@query("page_titles", "SELECT page_id, coalesce(nullif(left(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 200), ''), 'Untitled page') AS title, sha256(html) AS content_hash FROM pages")
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", E.page_title(F.col("html")).alias("title"), F.sha2("html", 256).alias("content_hash"))


@query(
    "canonical_urls",
    """WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS s, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '') AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)
    SELECT page_id, s || '://' || h || CASE WHEN rtrim(p, '/') = '' THEN '/' ELSE rtrim(p, '/') END AS canonical FROM u""",
)
def canonical_urls(spark, d):
    return table(spark, d, "pages").select("page_id", E.canonical_url("url", F.lit(None).cast("string")).alias("canonical"))


@query(
    "page_links",
    "SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS BIGINT) AS n_links, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)[1] AS first_link FROM pages",
)
def page_links(spark, d):
    p = table(spark, d, "pages").select("page_id", E.parse_html("html").alias("doc"))
    return p.select("page_id", F.size("doc.links").cast("long").alias("n_links"), F.get("doc.links", F.lit(0)).alias("first_link"))


_PATHS = "CASE c_custkey % 6 WHEN 0 THEN '/About' WHEN 1 THEN '/' WHEN 2 THEN '/login/about' WHEN 3 THEN '/our-company' WHEN 4 THEN '' ELSE '/blog' END"


@query("allowed_urls", "SELECT c_custkey AS id, c_custkey % 6 IN (0, 1, 4) AS plain, c_custkey % 6 IN (0, 1, 3, 4) AS from_sitemap FROM customer")
def allowed_urls(spark, d):
    url = F.concat(F.lit("https://shop"), F.col("c_custkey").cast("string"), F.lit(".com"), F.expr(_PATHS))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), E.allowed_url(url).alias("plain"), E.allowed_url(url, F.lit(True)).alias("from_sitemap"))


@query(
    "blocked_pages",
    "SELECT doc_id, doc_id % 10 = 3 OR regexp_matches(lower(text), 'access denied|are you human|captcha|challenge|explicit block|forbidden|unusual traffic|verify you are human') AS blocked FROM documents",
)
def blocked_pages(spark, d):
    status = F.when(F.col("doc_id") % 10 == 3, 429).otherwise(200)
    return table(spark, d, "documents").select("doc_id", E.blocked(status, F.col("text")).alias("blocked"))


_FILL = "lorem ipsum " * 20
_K = "CAST(c_custkey AS STRING)"
#: A shop's page, in SQL that Spark and DuckDB run: what is on it is known, and far enough apart to be out of each other's context.
_SHOP_HTML = f"""concat('<html><head><title>Shop ', {_K}, ' | Home</title><script>x="hidden@evil.com"</script></head><body><p>{_FILL}</p><a href="mailto:Sales@shop', {_K}, '.com?subject=x">Write</a><p>{_FILL}</p>',
    '<p>Email: info@mail', {_K}, '.com</p><!-- a@b.com --><p>{_FILL}</p><p>owner', {_K}, ' [at] shop', {_K}, ' (dot) com</p><p>{_FILL}</p><p>', CASE WHEN c_custkey % 5 = 0 THEN concat('me', {_K}, '@gmail.com') ELSE 'name@example.com' END,
    '</p><p>{_FILL}</p><p>Telephone +1415', lpad({_K}, 7, '0'), '</p><p>{_FILL}</p><a href="tel:+44-20-7946-', lpad({_K}, 6, '0'), '">Call</a><p>{_FILL}</p><p>WhatsApp +8613', lpad({_K}, 9, '0'),
    '</p><style>c@d.com</style><p>{_FILL}</p><p>WeChat ID: acme_', lpad({_K}, 6, '0'), '</p><p>{_FILL}</p></body></html>')"""
_SHOP_URL = f"concat('https://www.shop', {_K}, '.com', CASE c_custkey % 3 WHEN 0 THEN '/contact-us' WHEN 1 THEN '/about' ELSE '/directory/x' END)"

_MASK_PHONE = "'+' || repeat('*', length(value) - 5) || right(value, 4)"
#: type, value, the points and rules that a contact page, a plain page and a directory give it, whether its context has a label.
_SHOP_CONTACTS = f"""x AS (SELECT c_custkey AS page_id, c_custkey % 3 AS c, unnest([
    {{'t': 'email', 'v': 'sales@shop' || {_K} || '.com', 'p': [85, 40, 10], 'n': [4, 3, 4], 'l': true}}, {{'t': 'email', 'v': 'info@mail' || {_K} || '.com', 'p': [85, 30, 0], 'n': [4, 2, 3], 'l': true}},
    {{'t': 'email', 'v': 'owner' || {_K} || '@shop' || {_K} || '.com', 'p': [55, 0, 0], 'n': [2, 0, 1], 'l': false}}, {{'t': 'email', 'v': CASE WHEN c_custkey % 5 = 0 THEN 'me' || {_K} || '@gmail.com' END, 'p': [35, 0, 0], 'n': [3, 1, 2], 'l': false}},
    {{'t': 'phone', 'v': '+1415' || lpad({_K}, 7, '0'), 'p': [85, 30, 0], 'n': [4, 2, 3], 'l': true}}, {{'t': 'phone', 'v': '+44207946' || lpad({_K}, 6, '0'), 'p': [85, 30, 0], 'n': [4, 2, 3], 'l': true}},
    {{'t': 'phone', 'v': '+8613' || lpad({_K}, 9, '0'), 'p': [85, 30, 0], 'n': [4, 2, 3], 'l': true}}, {{'t': 'whatsapp', 'v': '+8613' || lpad({_K}, 9, '0'), 'p': [90, 35, 5], 'n': [4, 2, 3], 'l': true}},
    {{'t': 'wechat', 'v': 'acme_' || lpad({_K}, 6, '0'), 'p': [90, 35, 5], 'n': [4, 2, 3], 'l': true}}]) AS r FROM customer),
shop AS (SELECT page_id, r.t AS contact_type, r.v AS value, CAST(r.p[c + 1] AS INT) AS confidence, CAST(r.n[c + 1] AS INT) AS n_components, r.l AS labeled FROM x WHERE r.v IS NOT NULL)"""


def _shops(spark, d):
    c = table(spark, d, "customer").select("c_custkey").repartition(2 * spark.sparkContext.defaultParallelism, "c_custkey")  # the pages are a thousand times the ids they are made of
    return c.select(F.col("c_custkey").alias("page_id"), F.expr(_SHOP_URL).alias("url"), F.expr(_SHOP_HTML).alias("html"))


_STATIC = ", ".join(f"'{p}'" for p in E.STATIC_PATHS)


@query(
    "crawl_plan",
    f"""WITH u AS (SELECT c_custkey AS page_id, list_concat(['/x'], [{_STATIC}], ['/company/export']) AS paths FROM customer)
    SELECT page_id, CAST(i AS BIGINT) AS position, 'https://shop' || page_id || '.com' || paths[i] AS url FROM u, unnest(range(1, 13)) AS r(i)""",
)
def crawl_plan(spark, d):
    k = F.col("c_custkey").cast("string")
    links = F.lit('<a href="/contact">c</a><a href="/login">l</a><a href="https://other.com/about">o</a><a href="/about?x=1">a</a>')
    loc = lambda path: F.concat(F.lit("<url><loc>https://shop"), k, F.lit(f".com{path}</loc></url>"))
    pages = spread(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://www.shop"), k, F.lit(".com/x")).alias("url"), links.alias("html"), F.concat(loc("/company/export"), loc("/business")).alias("sitemap"))
    return E.crawl_plan(pages)


def _docs_as_pages(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("page_id"), F.lit("https://www.acme.example.com/contact").alias("url"), F.struct(F.col("text").alias("text"), F.array().cast("array<string>").alias("links")).alias("doc"))


_SQL_RUN = r"""[^\s@<>()\[\]{},;:"''/?=&|\\]+"""
_SQL_AT, _SQL_DOT = (rf"(?:\s*[\[(]\s*{w}\s*[\])]\s*|\s+{w}\s+)" for w in ("at", "dot"))


@query(
    "emails_extracted",
    rf"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '(?i)[a-z0-9._%+-]+{_SQL_AT}[a-z0-9-]+(?:(?:{_SQL_DOT}|\.)[a-z0-9-]+)*{_SQL_DOT}[a-z]{{2,24}}\b') AS spelled FROM documents),
    r AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_SQL_RUN}@{_SQL_RUN}')) AS raw FROM t
      UNION ALL SELECT doc_id, unnest(list_transform(spelled, lambda m: regexp_replace(regexp_replace(m, '(?i){_SQL_AT}', '@', 'g'), '(?i){_SQL_DOT}', '.', 'g'))) FROM t),
    v AS (SELECT doc_id, lower(trim(raw, '.,;:<>[](){{}}"''')) AS value FROM r)
    SELECT DISTINCT doc_id AS page_id, value FROM v WHERE regexp_full_match(value, '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,24}}') AND NOT contains(value, '..') AND split_part(value, '@', 2)[1] <> '-' AND right(split_part(value, '@', 2), 1) <> '-'
    AND NOT contains(value, '%') AND NOT regexp_matches(value, '\.(example|invalid|test|localhost)$')
    AND value NOT IN ('email@example.com','info@example.com','name@example.com','test@example.com','user@example.com','user@domain.com') AND split_part(value, '@', 1) NOT IN ('noreply','no-reply','donotreply','do-not-reply')""",
)
def emails_extracted(spark, d):
    return E.contacts(_docs_as_pages(spark, d), ["email"], least=0).filter(~F.contains("value", F.lit("%"))).select("page_id", "value")


@query(
    "phones_extracted",
    f"""WITH v AS (SELECT c_custkey AS page_id, '+14157' || lpad({_K}, 6, '0') AS value FROM customer)
    SELECT page_id, value, {_MASK_PHONE} AS masked, CAST(85 AS INT) AS confidence FROM v""",
)
def phones_extracted(spark, d):
    text = F.concat(F.lit("Phone (415) 7"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(", room 12"))
    doc = F.struct(text.alias("text"), F.array().cast("array<string>").alias("links"))
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.lit("https://www.acme.com/contact").alias("url"), doc.alias("doc"))
    return E.contacts(pages, ["phone"], region="US", least=0).select("page_id", "value", "masked", "confidence")


@query(
    "contacts_best",
    f"""WITH {_SHOP_CONTACTS} SELECT page_id, contact_type, value, confidence, CASE WHEN confidence >= 80 THEN 'accepted' WHEN confidence >= 55 THEN 'manual_review' END AS review_status,
    CASE contact_type WHEN 'email' THEN left(value, 2) || '***@' || split_part(value, '@', 2) WHEN 'wechat' THEN left(value, 2) || '***' || right(value, 2) ELSE {_MASK_PHONE} END AS masked FROM shop""",
)
def contacts_best(spark, d):
    return E.contacts(_shops(spark, d), least=0).select("page_id", "contact_type", "value", "confidence", "review_status", "masked")


@query("contacts_of_pages")
def contacts_of_pages(spark, d):
    return E.contacts(table(spark, d, "pages"), least=0).select("page_id", "contact_type", "value", "confidence", "review_status")


@query(
    "confidence_scored",
    f"""WITH {_SHOP_CONTACTS} SELECT page_id, contact_type, value, confidence, CASE WHEN confidence >= 80 THEN 'business_verified' WHEN labeled THEN 'business_public_manual_review' ELSE 'low_confidence_manual_review' END AS classification, n_components FROM shop""",
)
def confidence_scored(spark, d):
    return E.contacts(_shops(spark, d), least=0).select("page_id", "contact_type", "value", "confidence", "classification", F.size("components").alias("n_components"))


@query(
    "pages_enriched",
    f"""WITH {_SHOP_CONTACTS}, n AS (SELECT page_id, count(*) AS n, max(confidence) AS best, min(contact_type || ' ' || value) AS first FROM shop WHERE confidence >= 55 GROUP BY page_id)
    SELECT c_custkey AS page_id, 'shop' || {_K} || '.com' AS domain, 'Shop ' || {_K} || ' | Home' AS title, 'Shop ' || {_K} AS company, coalesce(n, 0) AS n_contacts, best, first AS first_contact FROM customer LEFT JOIN n ON page_id = c_custkey""",
)
def pages_enriched(spark, d):
    e = E.enriched(_shops(spark, d))
    first = F.get("contacts", F.lit(0))
    best = F.array_max(F.transform("contacts", lambda c: c["confidence"]))
    return e.select("page_id", "domain", "title", "company", F.size("contacts").cast("long").alias("n_contacts"), best.alias("best"), F.concat(first["contact_type"], F.lit(" "), first["value"]).alias("first_contact"))


@query(
    "evidence_snippets",
    f"""SELECT c_custkey AS page_id, 'Reach us: <masked-email> or +*******' || right('000' || lpad({_K}, 7, '0'), 4) || ' today | Reach us: <masked-email> or <masked-phone> today' AS snippet FROM customer""",
)
def evidence_snippets(spark, d):
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("Reach us: Sales@SHOP"), k, F.lit(".com or +1415"), F.lpad(k, 7, "0"), F.lit(" today"))
    doc = F.struct(text.alias("text"), F.array().cast("array<string>").alias("links"))
    pages = spread(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("page_id"), F.lit("https://www.acme.com/contact").alias("url"), doc.alias("doc"))
    g = E.contacts(pages, ["email", "phone"], least=0).groupBy("page_id").agg(F.array_sort(F.collect_list("evidence")).alias("e"))
    return g.select("page_id", E.evidence_snippet(F.col("e"), F.lit("Untitled page")).alias("snippet"))


@query(
    "business_type_scores",
    """SELECT doc_id, CAST(least(100, 15 * (contains(lower(text), 'manufacturer')::INT + contains(lower(text), 'manufacturing')::INT + contains(lower(text), 'factory')::INT + contains(lower(text), 'oem')::INT + contains(lower(text), 'odm')::INT)) AS INT) AS manufacturer,
    CAST(least(100, 15 * (contains(lower(text), 'trading company')::INT + contains(lower(text), 'wholesaler')::INT + contains(lower(text), 'distributor')::INT + contains(lower(text), 'reseller')::INT)) AS INT) AS trader FROM documents""",
)
def business_type_scores(spark, d):
    return table(spark, d, "documents").select("doc_id", E.business_scores(F.col("text")).alias("s")).select("doc_id", "s.manufacturer", "s.trader")


# search


_DOCS = """docs AS (SELECT s.id AS seller_id, concat_ws(' ', s.name, s.legal_name, s.domain, s.city, (SELECT string_agg(alias, ' ') FROM aliases a WHERE a.seller_id = s.id), b.brands) AS doc
  FROM sellers s LEFT JOIN (SELECT seller_id, string_agg(DISTINCT brand, ' ') AS brands FROM products GROUP BY seller_id) b ON b.seller_id = s.id),
seller_tokens AS (SELECT DISTINCT seller_id, token FROM (SELECT seller_id, unnest(regexp_split_to_array(strip_accents(lower(doc)), '[^\\p{L}\\p{N}]+')) AS token FROM docs) WHERE token <> '')"""


def seller_index(spark, d):
    return S.index(seller_documents(spark, d), "seller_id", S.COLUMNS)


def kept_index(spark, d, build_anew: bool = False):
    """The folder of the search index of d, in the shared folder: built once, and again when a table that it is made of was written again."""
    tables = ["customer", "nation", "region", "orders", "lineitem", "part"]
    path = f"{shared(spark)}/heddle/search-{fingerprint(spark, [f'{d}/{t}.parquet' for t in tables])}"
    if build_anew or not S.is_built(spark, path):
        fresh = f"{path}-{uuid.uuid4().hex}"
        S.build(seller_documents(spark, d), "seller_id", S.COLUMNS, fresh)
        if build_anew:
            return fresh
        where, fs = file_system(spark, fresh)
        if not fs.rename(where, file_system(spark, path)[0]):  # somebody else's is there by now
            fs.delete(where, True)
    return path


def seller_documents(spark, d):
    s = relation(spark, d, "sellers").withColumnsRenamed({"name": "canonical_name", "domain": "official_domain"})
    return S.seller_documents(s, relation(spark, d, "aliases"), relation(spark, d, "products"))


@query("search_stored", oracle(f"WITH {_DOCS} SELECT seller_id FROM seller_tokens GROUP BY seller_id HAVING bool_or(starts_with(token, 'customer')) AND bool_or(starts_with(token, 'auto') OR starts_with(token, 'mach'))"))
def search_stored(spark, d):
    """Two searches in the index that is kept: postings by prefix, neither orders nor lineitem are read."""
    idx = S.stored_index(spark, kept_index(spark, d))
    either = S.match(idx, "seller_id", "auto mach", every=False)
    return S.match(idx, "seller_id", "CUSTOMER").join(either, "seller_id", "left_semi")


@query("search_stored_refreshed", oracle(f"WITH {_DOCS} SELECT seller_id, CASE WHEN seller_id IN (SELECT id FROM sellers WHERE country = 'CHINA') AND token = 'ltd' THEN 'gmbh' ELSE token END AS token FROM seller_tokens"))
def search_stored_refreshed(spark, d):
    """A stored index after the sellers of one country changed their legal form, by the ranges that this touches."""
    path = kept_index(spark, d, build_anew=True)
    moved = relation(spark, d, "sellers").filter("country = 'CHINA'").select(F.col("id").alias("seller_id"))
    docs = seller_documents(spark, d).withColumn("legal_name", F.regexp_replace("legal_name", " LTD$", " GmbH"))
    S.refresh_stored(spark, path, docs, moved, "seller_id", S.COLUMNS)
    return S.stored_index(spark, path).select("seller_id", "token")


@query("search_index", oracle(f"WITH {_DOCS} SELECT seller_id, token FROM seller_tokens"))
def search_index(spark, d):
    return seller_index(spark, d)


@query("sellers_search_accents", oracle(f"WITH {_DOCS} SELECT seller_id FROM seller_tokens GROUP BY seller_id HAVING bool_or(starts_with(token, 'societe')) AND bool_or(starts_with(token, 'build')) AND bool_or(starts_with(token, '7'))"))
def sellers_search_accents(spark, d):
    return S.match(seller_index(spark, d), "seller_id", "SOCIETÉ build 7")


@query("search_refreshed", oracle(f"WITH {_DOCS} SELECT seller_id, token FROM seller_tokens WHERE seller_id % 10 <> 0 OR seller_id IN (SELECT id FROM sellers WHERE status = 'active')"))
def search_refreshed(spark, d):
    """The index after every tenth seller was looked at again, and those that aren't active are gone."""
    s = relation(spark, d, "sellers").withColumnsRenamed({"name": "canonical_name", "domain": "official_domain"})
    args = relation(spark, d, "aliases"), relation(spark, d, "products")
    now = S.seller_documents(s.filter("id % 10 <> 0 OR status = 'active'"), *args)
    changed = s.filter("id % 10 = 0").select(F.col("id").alias("seller_id"))
    return S.refresh(seller_index(spark, d), now, changed, "seller_id", S.COLUMNS)


_TOKENS = "tok AS (SELECT DISTINCT id, unnest(regexp_split_to_array(lower(name || ' ' || domain || ' ' || country), '[^a-z0-9]+')) AS t FROM identities)"


def _idx(spark, d):
    return S.index(relation(spark, d, "identities"), "id", ["name", "domain", "country"])


@query("sellers_search_prefix_and", oracle(f"WITH {_TOKENS} SELECT id FROM tok GROUP BY id HAVING bool_or(starts_with(t, 'gea')) AND bool_or(starts_with(t, 'brand')) AND bool_or(starts_with(t, '1'))"))
def sellers_search_prefix_and(spark, d):
    return S.match(_idx(spark, d), "id", 'Gea "brand" 1*')


@query("sellers_search_prefix_or", oracle(f"WITH {_TOKENS} SELECT id FROM tok GROUP BY id HAVING bool_or(starts_with(t, 'blue')) OR bool_or(starts_with(t, 'bolt'))"))
def sellers_search_prefix_or(spark, d):
    return S.match(_idx(spark, d), "id", "blue OR bolt".replace(" OR ", " "), every=False)


# resolution


def _new(spark, d):
    return relation(spark, d, "identities")


_MATCH = """identities a JOIN identities b
  ON a.id <> b.id AND (a.domain = b.domain OR a.name = b.name OR (length(a.name) >= 8 AND length(b.name) >= 8 AND substr(a.name, 1, 8) = substr(b.name, 1, 8)))"""
_CAND = f"""cand AS (SELECT candidate_id, existing_id FROM (SELECT a.id AS candidate_id, b.id AS existing_id, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS k FROM {_MATCH}) WHERE k <= 25)"""
_ALL = f"cand AS (SELECT a.id AS candidate_id, b.id AS existing_id FROM {_MATCH})"
_SCORED = f"""{_CAND}, nm AS (SELECT *, lower(trim(name)) AS n, list_transform(range(1, length(lower(trim(name)))), lambda i: substr(lower(trim(name)), i, 2)) AS g FROM identities),
  sim AS (SELECT candidate_id, existing_id, a.n = b.n AS exact, a.domain = b.domain AS domain_same, a.country = b.country AS country_same, a.city = b.city AS city_same,
    CASE WHEN a.n = b.n THEN 1.0 WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0.0 ELSE
      2.0 * coalesce(list_sum(list_transform(list_intersect(a.g, b.g), lambda x: least(len(list_filter(a.g, lambda y: y = x)), len(list_filter(b.g, lambda y: y = x))))), 0) / (len(a.g) + len(b.g)) END AS dice
    FROM cand JOIN nm a ON a.id = candidate_id JOIN nm b ON b.id = existing_id),
  pt AS (SELECT *, CASE WHEN exact THEN 40 WHEN dice >= 0.96 THEN 32 WHEN dice >= 0.90 THEN 25 WHEN dice >= 0.84 THEN 18 WHEN dice >= 0.78 THEN 10 ELSE 0 END AS name_points FROM sim),
  sc AS (SELECT *, CAST(greatest(0, least(100, CASE WHEN domain_same THEN 52 ELSE -30 END + name_points + CASE WHEN country_same THEN 6 + CASE WHEN city_same THEN 4 ELSE -8 END ELSE -18 END)) AS INT) AS score,
    CAST(2 + (name_points > 0)::INT + country_same::INT AS INT) AS n_components FROM pt)"""


@query("er_candidates", oracle(f"WITH {_CAND} SELECT * FROM cand"))
def er_candidates(spark, d):
    return X.candidates(_new(spark, d), _new(spark, d))


def scored(spark, d):
    return X.score(er_candidates(spark, d), _new(spark, d), _new(spark, d))


@query("er_scored", oracle(f"WITH {_SCORED.replace(_CAND, _ALL)} SELECT candidate_id, existing_id, score, n_components FROM sc"))
def er_scored(spark, d):
    """All pairs, without a limit for each candidate."""
    return X.score_all(_new(spark, d), _new(spark, d)).select("candidate_id", "existing_id", "score", F.size("components").alias("n_components"))


@query(
    "er_scored_hashes",
    oracle(f"""WITH {_SCORED} SELECT candidate_id, existing_id, CAST(greatest(0, least(100, CASE WHEN domain_same THEN 52 ELSE -30 END + name_points + CASE WHEN country_same THEN 6 + CASE WHEN city_same THEN 4 ELSE -8 END ELSE -18 END
    + CASE domain_same::INT + country_same::INT WHEN 0 THEN 0 WHEN 1 THEN 35 ELSE 40 END)) AS INT) AS score FROM sc"""),
)
def er_scored_hashes(spark, d):
    """Identities with hashes of contacts: one that those of a domain share, one that those of a country share."""
    i = _new(spark, d).withColumn("hashes", F.array(F.md5("domain"), F.md5(F.concat(F.lit("c"), "country"))))
    return X.score(X.candidates(i, i), i, i).select("candidate_id", "existing_id", "score")


@query("er_scored_sequence")
def er_scored_sequence(spark, d):
    return X.score(er_candidates(spark, d), _new(spark, d), _new(spark, d), scorer="sequence").select("candidate_id", "existing_id", "score")


@query("er_best_match", oracle(f"WITH {_SCORED} SELECT candidate_id, existing_id, score FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, existing_id) AS k FROM sc) WHERE k = 1"))
def er_best_match(spark, d):
    return X.best(scored(spark, d))


@query(
    "er_decisions",
    oracle(f"WITH {_SCORED} SELECT candidate_id, existing_id, score, CASE WHEN score >= 92 THEN 'auto_merge' WHEN score >= 70 THEN 'review_queue' ELSE 'no_merge' END AS action FROM sc"),
)
def er_decisions(spark, d):
    return scored(spark, d).select("candidate_id", "existing_id", "score", X.action(F.col("score")).alias("action"))


@query("er_review_queue", oracle(f"WITH {_SCORED} SELECT candidate_id, existing_id, CASE WHEN score >= 85 THEN 1 ELSE 2 END AS priority FROM sc WHERE score >= 70 AND score < 92"))
def er_review_queue(spark, d):
    s = scored(spark, d).filter(X.action(F.col("score")) == "review_queue")
    return s.select("candidate_id", "existing_id", X.review_priority(F.col("score")).alias("priority"))


_BEST = "best AS (SELECT candidate_id, min(matched_id) AS existing_id, max(score) AS score FROM decisions GROUP BY candidate_id)"


@query(
    "er_auto_merged",
    oracle(f"""WITH {_BEST} SELECT a.id, CASE WHEN best.score >= 92 THEN existing_id ELSE seller_id END AS seller_id, CASE WHEN best.score >= 92 THEN 'merged' ELSE s.status END AS seller_status
    FROM accounts a LEFT JOIN best ON candidate_id = seller_id JOIN sellers s ON s.id = a.seller_id"""),
)
def er_auto_merged(spark, d):
    """Accounts after the merges that scores decide, with the state of the seller that they had."""
    best = relation(spark, d, "decisions").groupBy("candidate_id").agg(F.min("matched_id").alias("existing_id"), F.max("score").alias("score"))
    accounts = relation(spark, d, "accounts").select("id", "seller_id")
    sellers, children, _ = X.auto_merge(relation(spark, d, "sellers"), {"accounts": accounts}, best)
    before = accounts.select(F.col("id").alias("a"), F.col("seller_id").alias("s"))
    had = sellers.select(F.col("id").alias("own"), F.col("status").alias("seller_status"))
    return children["accounts"].join(before, F.col("id") == F.col("a")).join(had, F.col("s") == F.col("own")).select("id", "seller_id", "seller_status")


_REQUESTS = "req AS (SELECT id, CASE id % 4 WHEN 0 THEN 'merge' WHEN 1 THEN 'keep_separate' WHEN 2 THEN 'rollback' ELSE 'split' END AS request FROM decisions UNION ALL SELECT -id - 1, 'merge' FROM decisions)"


@query(
    "er_decision_requests",
    oracle(f"""WITH {_REQUESTS} SELECT req.id, request, CASE WHEN request = 'split' THEN 'invalid' WHEN d.id IS NULL THEN 'not_found'
    WHEN d.status = CASE request WHEN 'merge' THEN 'merged' WHEN 'keep_separate' THEN 'separate' ELSE 'rolled_back' END THEN 'duplicate'
    WHEN d.status = CASE request WHEN 'rollback' THEN 'merged' ELSE 'pending' END THEN 'applied' ELSE 'conflict' END AS receipt FROM req LEFT JOIN decisions d ON d.id = req.id"""),
)
def er_decision_requests(spark, d):
    x = relation(spark, d, "decisions")
    requests = x.selectExpr("id", "CASE id % 4 WHEN 0 THEN 'merge' WHEN 1 THEN 'keep_separate' WHEN 2 THEN 'rollback' ELSE 'split' END AS request").union(x.selectExpr("-id - 1", "'merge'"))
    return X.decide(x, requests)[1]


_MERGES = "mg AS (SELECT candidate_id AS source_id, min(matched_id) AS target_id, min(id) AS id FROM decisions WHERE status = 'merged' GROUP BY candidate_id)"


def _merges(spark, d):
    return relation(spark, d, "decisions").filter("status = 'merged'").groupBy(F.col("candidate_id").alias("source_id")).agg(F.min("matched_id").alias("target_id"), F.min("id").alias("id"))


def _children(spark, d):
    return {name: relation(spark, d, name, hashed=("orders",)) for name in X.CHILDREN}


@query("er_merge_links", oracle(f"WITH {_MERGES} " + " UNION ALL ".join(f"SELECT mg.id AS decision_id, '{t}' AS table_name, c.id AS row_id, mg.source_id, target_id FROM {t} c JOIN mg ON c.seller_id = mg.source_id" for t in X.CHILDREN)))
def er_merge_links(spark, d):
    return X.merge_links(_children(spark, d), _merges(spark, d))


@query("er_merged_children", oracle(f"WITH {_MERGES} SELECT a.id, coalesce(target_id, seller_id) AS seller_id FROM accounts a LEFT JOIN mg ON a.seller_id = source_id"))
def er_merged_children(spark, d):
    return X.repoint(relation(spark, d, "accounts"), _merges(spark, d)).select("id", "seller_id")


@query("er_rollback", oracle("SELECT id, seller_id FROM accounts"))
def er_rollback(spark, d):
    merges = _merges(spark, d)
    links = X.merge_links(_children(spark, d), merges)
    return X.rollback(X.repoint(relation(spark, d, "accounts"), merges), links, "accounts").select("id", "seller_id")


@query("er_rollback_marks", oracle(f"WITH {_MERGES} SELECT 'accounts' AS table_name, a.id AS row_id, target_id % 2 = 0 AS undone FROM accounts a JOIN mg ON a.seller_id = source_id"))
def er_rollback_marks(spark, d):
    """After the merges, rows of odd targets moved on, so a rollback leaves them."""
    merges = _merges(spark, d)
    accounts = relation(spark, d, "accounts").select("id", "seller_id")
    links = X.merge_links({"accounts": accounts}, merges)
    moved = links.select(F.col("row_id").alias("id"), F.when(F.col("target_id") % 2 == 0, F.col("target_id")).otherwise(-1).alias("seller_id"))
    return X.undone(links, {"accounts": moved}).select("table_name", "row_id", "undone")


@query("er_redirects", oracle("SELECT candidate_id AS source_id, matched_id AS target_id, CASE status WHEN 'merged' THEN 'active' ELSE 'rolled_back' END AS status FROM decisions WHERE status IN ('merged', 'separate')"))
def er_redirects(spark, d):
    x = relation(spark, d, "decisions").select(F.col("candidate_id").alias("source_id"), F.col("matched_id").alias("target_id"), F.when(F.col("status") == "separate", "rolled_back").otherwise(F.col("status")).alias("status"))
    return X.redirects(x)


# writes


_OLD = "SELECT id, name, CASE WHEN id % 3 = 0 THEN domain END AS domain, id % 100 AS seen FROM sellers WHERE id % 2 = 0"
_NEWS = "SELECT id, concat(name, '!') AS name, CASE WHEN id % 5 = 0 THEN domain END AS domain, id % 100 + 7 AS seen FROM sellers WHERE id % 3 <> 1"


def _old_new(spark, d):
    s = relation(spark, d, "sellers")
    return spark.sql(_OLD.replace("sellers", "{s}"), s=s), spark.sql(_NEWS.replace("sellers", "{s}"), s=s)


def _merged_sql(domain: str, name: str = "CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END") -> str:
    return oracle(f"WITH o AS ({_OLD}), n AS ({_NEWS}) SELECT coalesce(o.id, n.id) AS id, {name} AS name, {domain} AS domain, coalesce(o.seen, n.seen) AS seen FROM o FULL JOIN n ON o.id = n.id")


@query("upsert_sellers", _merged_sql("CASE WHEN n.id IS NOT NULL THEN n.domain ELSE o.domain END"))
def upsert_sellers(spark, d):
    return U.upsert(*_old_new(spark, d), ["id"], {"seen": "first"})


@query("upsert_sources", _merged_sql("coalesce(o.domain, n.domain)"))
def upsert_sources(spark, d):
    return U.upsert(*_old_new(spark, d), ["id"], {"seen": "first", "domain": "keep"})


@query("upsert_review", _merged_sql("coalesce(o.domain, n.domain)", "CASE WHEN o.id % 4 = 0 THEN o.name WHEN n.id IS NOT NULL THEN n.name ELSE o.name END"))
def upsert_review(spark, d):
    return U.upsert(*_old_new(spark, d), ["id"], {"seen": "first", "domain": "keep"}, sticky={"name": F.col("id") % 4 == 0})


@query("insert_only", oracle(f"WITH o AS ({_OLD}), n AS ({_NEWS}) SELECT id, name FROM o UNION ALL SELECT id, name FROM n WHERE id NOT IN (SELECT id FROM o)"))
def insert_only(spark, d):
    return U.insert_only(*_old_new(spark, d), ["id"], [F.asc("name")]).select("id", "name")


@query("batch_chunks", oracle("SELECT id, seller_id, CAST(floor((row_number() OVER (PARTITION BY seller_id ORDER BY id) - 1) / 17) AS BIGINT) AS chunk FROM contacts"))
def batch_chunks(spark, d):
    return U.chunks(relation(spark, d, "contacts"), "seller_id", [F.asc("id")], 17).select("id", "seller_id", "chunk")


# ingest


_SEEN = "SELECT concat(CAST(run_id AS STRING), ':', CAST(id % 5 AS STRING)) AS k, min(md5(state)) AS digest FROM log WHERE id % 4 = 0 GROUP BY 1"
_BATCH = "SELECT concat(CAST(run_id AS STRING), ':', CAST(id % 5 AS STRING)) AS k, md5(state) AS digest, id FROM log WHERE id % 4 <> 0"


@query(
    "ingest_classify",
    oracle(f"""WITH seen AS ({_SEEN}), batch AS ({_BATCH}), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS rn, first_value(digest) OVER (PARTITION BY k ORDER BY id) AS first FROM batch)
    SELECT f.id, CASE WHEN s.k IS NULL AND rn = 1 THEN 'new' WHEN coalesce(s.digest, first) = f.digest THEN 'duplicate' ELSE 'conflict' END AS receipt FROM f LEFT JOIN seen s ON s.k = f.k"""),
)
def ingest_classify(spark, d):
    log = relation(spark, d, "log")
    seen, batch = (spark.sql(q.replace("FROM log", "FROM {log}"), log=log) for q in (_SEEN, _BATCH))
    return U.classify_ingest(seen, batch, "k", "digest", ["id"]).select("id", "receipt")


@query("nonce_replay", oracle("SELECT id, run_id % 40 < 5 OR row_number() OVER (PARTITION BY run_id % 40 ORDER BY id) > 1 AS replay FROM log"))
def nonce_replay(spark, d):
    requests = relation(spark, d, "log").select("id", (F.col("run_id") % 40).alias("nonce"))
    return I.replayed(requests, requests.filter("nonce < 5").select("nonce"), order=["id"]).select("id", "replay")


@query("late_events", oracle("SELECT id, abs((id * 37) % 900 - 450) <= 300 AS accepted FROM log"))
def late_events(spark, d):
    log = relation(spark, d, "log").withColumn("happened", F.col("happened").cast("timestamp"))
    log = log.withColumn("arrived", F.expr("timestampadd(SECOND, CAST((id * 37) % 900 - 450 AS INT), happened)"))
    return log.select("id", I.timely("happened", "arrived").alias("accepted"))


@query("events_in_time", oracle("SELECT id FROM log WHERE abs((id * 37) % 900 - 450) <= 120"))
def events_in_time(spark, d):
    log = relation(spark, d, "log").withColumn("happened", F.col("happened").cast("timestamp"))
    log = log.withColumn("arrived", F.expr("timestampadd(SECOND, CAST((id * 37) % 900 - 450 AS INT), happened)"))
    return I.in_time(log, "happened", "arrived", 120).select("id")


_BODY = """concat('{"schema_version":1,"parser_version":"p","crawl_run_id":"01890000-0000-7000-8000-', lpad(CAST(c_custkey AS STRING), 12, '0'), '","batch_number":', CASE WHEN c_custkey % 7 = 3 THEN '-1' ELSE '5' END,
    ',"generated_at":"2024","feature_flags":[{"flag_name":"', CASE WHEN c_custkey % 7 = 6 THEN '' ELSE 'f' END, '","updated_at":"u"', CASE c_custkey % 7 WHEN 1 THEN ',"x":1' WHEN 2 THEN ',"enabled":"yes"' ELSE ',"enabled":true' END, '}]}')"""


@query(
    "batch_contract",
    """SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN '$.feature_flags[0].x is not allowed' WHEN 2 THEN '$.feature_flags[0].enabled must be a boolean' WHEN 3 THEN '$.batch_number must be a non-negative integer'
    WHEN 4 THEN 'body must be valid JSON' WHEN 5 THEN 'body must be a JSON object' ELSE '$.feature_flags[0].flag_name is required' END AS errors, CAST(CASE WHEN c_custkey % 7 IN (4, 5) THEN 0 ELSE 1 END AS INT) AS writes FROM customer""",
)
def batch_contract(spark, d):
    body = F.when(F.col("c_custkey") % 7 == 4, "{broken").when(F.col("c_custkey") % 7 == 5, "[1]").otherwise(F.expr(_BODY))
    requests = spread(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("id"), body.alias("body"))
    return B.checked(requests).select("id", F.array_join("errors", "; ").alias("errors"), "writes")


@query("batch_fan_out", "SELECT c_custkey AS id, '01890000-0000-7000-8000-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') || ':5' AS idempotency_key, 'f' AS flag_name, true AS enabled FROM customer WHERE c_custkey % 7 IN (0, 4, 5)")
def batch_fan_out(spark, d):
    accepted, _ = B.validated(spread(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("id"), F.expr(_BODY).alias("body")))
    rows = B.fan_out(accepted, "feature_flags")
    key = F.concat_ws(":", "__run", "__number")
    return rows.select(F.substring("__run", -12, 12).cast("long").alias("id"), key.alias("idempotency_key"), "flag_name", "enabled")


@query(
    "csv_safe_cells",
    """SELECT p_partkey AS id, '"' || replace(CASE WHEN p_size % 5 = 0 THEN '''=' || p_name ELSE p_name END, '"', '""') || '"' AS cell FROM part""",
)
def csv_safe_cells(spark, d):
    from heddle.sources.export import csv_cell

    cell = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("="), F.col("p_name"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), csv_cell(cell).alias("cell"))


_INNER, _OUTER = (bytes(b ^ x for b in b"test-secret".ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


@query("hmac_signatures", f"SELECT event_id, sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode(event_id || '.' || sha256(props))))) AS signature FROM events")
def hmac_signatures(spark, d):
    return table(spark, d, "events").select("event_id", ids.hmac_sha256(b"test-secret", F.concat_ws(".", F.col("event_id"), F.sha2("props", 256))).alias("signature"))


@query("sealed_contacts", "SELECT c_custkey AS id, c_name AS opened FROM customer")
def sealed_contacts(spark, d):
    key, aad = F.lit(b"0123456789abcdef0123456789abcdef"), F.lit("contacts")
    nonce = F.unhex(F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 24))
    sealed = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), ids.seal(F.col("c_name"), key, nonce, aad).alias("envelope"))
    return sealed.select("id", ids.open_sealed(F.col("envelope"), key, aad).alias("opened"))
