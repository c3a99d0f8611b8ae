"""Queries of marketplace pages, made from the driver tables so that SQL knows what is in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import marketplace as M
from heddle.plans.registry import query, spread, table
from heddle.sources.domain import oracle, relation


def _parts(spark, d):
    return spread(spark, d, "part", "p_partkey").withColumn("asin", F.format_string("B%09d", "p_partkey"))


@query("marketplace_search", "SELECT p_partkey AS page_id, CAST(0 AS BIGINT) AS position, printf('B%09d', p_partkey) AS asin, 'https://www.amazon.de/dp/' || printf('B%09d', p_partkey) AS product_url, p_name AS title FROM part")
def marketplace_search(spark, d):
    html = F.format_string("<div data-asin='%s'><h2><a href='/x/dp/%s/ref=1'><span>%s</span></a></h2></div><div data-asin='%s'></div>", "asin", "asin", "p_name", "asin")
    pages = _parts(spark, d).select(F.col("p_partkey").alias("page_id"), F.lit("https://www.amazon.de/s?k=x").alias("url"), html.alias("html"))
    return M.search_results(pages, 24)


@query(
    "marketplace_products",
    """SELECT p_partkey AS page_id, printf('B%09d', p_partkey) AS asin, p_name AS title, p_brand AS brand, 'SELLER' || p_size AS merchant_token,
    'https://www.amazon.com/sp?seller=SELLER' || p_size AS seller_profile_url, p_type AS category FROM part WHERE contains(lower(p_type), 'e') AND contains(p_brand, '#2')""",
)
def marketplace_products(spark, d):
    html = F.format_string(
        "<input id=ASIN value=%s><h1><span id=productTitle>%s</span></h1><a id=bylineInfo>Visit the %s Store</a><a href='/sp?seller=seller%d'>S</a><div id=nav-subnav><a>%s</a></div>", "asin", "p_name", "p_brand", "p_size", "p_type"
    )
    pages = _parts(spark, d).select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://www.amazon.com/dp/"), "asin").alias("url"), html.alias("html"))
    found = M.products(pages).filter(M.product_filter(category="E", brand="brand#2"))
    return found.select("page_id", "asin", "title", "brand", "merchant_token", "seller_profile_url", "category")


@query(
    "marketplace_sellers",
    """SELECT s_suppkey AS page_id, s_name AS business_name, CASE s_suppkey % 3 WHEN 0 THEN 'CN' WHEN 1 THEN 'GB' ELSE NULL END AS country_code,
    CASE WHEN s_suppkey % 2 = 0 THEN 'https://shop' || s_suppkey || '.example/' END AS official_website_url,
    CAST(CASE WHEN s_suppkey % 5 = 0 THEN 30 ELSE 0 END AS INT) AS manufacturer_score, CAST(15 AS INT) AS trader_score FROM supplier""",
)
def marketplace_sellers(spark, d):
    s = table(spark, d, "supplier")
    place = F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'Shenzhen, China' WHEN 1 THEN 'Leeds, United Kingdom' ELSE 'Nowhere' END")
    trade = F.when(F.col("s_suppkey") % 5 == 0, "OEM factory, wholesaler").otherwise("wholesaler")
    site = F.when(F.col("s_suppkey") % 2 == 0, F.format_string("<a href='https://www.shop%d.example/x'>Official website</a>", "s_suppkey")).otherwise("<a href='https://x.com/y'>Website</a>")
    html = F.concat(F.lit("<h1>Shop</h1><div id=page-section-detail-seller-info>Business Name: "), "s_name", F.lit(" Business Address: "), place, F.lit(" Company capability: "), trade, F.lit("</div>"), site)
    pages = s.select(F.col("s_suppkey").alias("page_id"), F.lit("https://www.amazon.com/sp?seller=A1FIXTURE123").alias("url"), html.alias("html"))
    return M.sellers(pages).select("page_id", "business_name", "country_code", "official_website_url", "manufacturer_score", "trader_score")


@query("public_urls", "SELECT page_id, page_id % 4 = 0 AS public, page_id % 4 <> 1 AS declared FROM pages")
def public_urls(spark, d):
    host = F.expr("CASE page_id % 4 WHEN 0 THEN 'shop.example.com' WHEN 1 THEN '10.1.2.3' WHEN 2 THEN 'user@shop.example.com' ELSE 'shop.example.com:x@' END")
    url = F.when(F.col("page_id") % 4 == 3, "ftp://shop.example.com/").otherwise(F.concat(F.lit("https://"), host, F.lit("/x")))
    return table(spark, d, "pages").select("page_id", M.public_url(url).alias("public"), M.declared_source(url, F.lit("www.shop.example.com")).alias("declared"))


@query(
    "cooldown_rows",
    oracle("""SELECT id, CASE WHEN id % 2 = 0 THEN 'amazon:amazon.fr' ELSE 'official_site:shop.example' END AS adapter, CASE WHEN id % 3 = 0 THEN 'rate_limited' ELSE 'blocked' END AS reason,
    happened + to_seconds(CASE WHEN id % 3 = 0 THEN 90 WHEN id % 2 = 0 THEN 604800 ELSE 86400 END) AS until FROM log WHERE state = 'error'""").replace("AS until", "AS blocked_until").replace("SELECT id, CASE", "SELECT CASE")
    .replace("happened + to_seconds", "date_trunc('second', happened) + to_seconds"),
)
def cooldown_rows(spark, d):
    log = relation(spark, d, "log")
    status = F.when(F.col("state") == "error", F.when(F.col("id") % 3 == 0, 429).otherwise(403)).otherwise(200)
    url = F.when(F.col("id") % 2 == 0, "https://www.amazon.fr/s").otherwise("https://www.shop.example/")
    rows = log.select(url.alias("url"), status.alias("status"), F.lit("").alias("body"), F.lit("90").alias("retry_after"), F.col("happened").cast("timestamp").alias("at"))
    return M.cooldowns(rows).withColumn("blocked_until", F.col("blocked_until").cast("timestamp_ntz"))


_FRONTIER = """WITH RECURSIVE n AS (SELECT max(p_partkey) AS n FROM part), links AS (SELECT DISTINCT p_partkey AS source, (p_partkey * k + 11 * k) % n + 1 AS target FROM part, n, (VALUES (2), (3), (5), (7)) AS v(k)),
f AS (SELECT p_partkey AS seed, p_partkey AS url, 0 AS depth FROM part UNION SELECT seed, target, depth + 1 FROM f JOIN links ON url = source WHERE depth < 3),
m AS (SELECT seed, url, CAST(min(depth) AS INT) AS depth FROM f GROUP BY seed, url)
SELECT seed, url, depth FROM m QUALIFY row_number() OVER (PARTITION BY seed ORDER BY depth, url) <= 25"""


@query("crawl_frontier", _FRONTIER)
def crawl_frontier(spark, d):
    """Every part is a seed and has four links, so that the budget binds."""
    p = table(spark, d, "part").select("p_partkey")
    n = p.agg(F.max("p_partkey").alias("n"))
    links = p.join(F.broadcast(n)).selectExpr("p_partkey AS source", "n", "explode(array(2, 3, 5, 7)) AS k").selectExpr("source", "(source * k + 11 * k) % n + 1 AS target").distinct()
    return M.frontier(p.select(F.col("p_partkey").alias("seed")), links, depth=3, budget=25)
