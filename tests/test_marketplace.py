from datetime import datetime

from pyspark.sql import functions as F

from heddle.operators import marketplace as M

SEARCH = "<div data-asin='B012345678'><h2><a href='/x/dp/B012345678/ref=1'><span>First</span></a></h2></div><div data-asin='B012345678'></div><div data-asin='bad'></div><div data-asin='B000000002'><a href='/gp/product/B000000002?x'>y</a><h2>Second</h2></div>"
PRODUCT = "<input id=ASIN value=B012345678><span id=productTitle> A  title </span><a id=bylineInfo>Visit the Maplewood Store</a><a id=sellerProfileTriggerId href='/sp?seller=a2maple77z9'>Fixture Seller</a><div id=nav-subnav><a>Tools</a></div>"
SELLER = "<h1 id=sellerName>Shop</h1><div id=page-section-detail-seller-info>Business Name: Maplewood Goods Ltd Business Address: 1 Road, Dhaka, Bangladesh Company capability: OEM factory</div><a href='https://facebook.com/x'>Website</a><a href='https://www.maplewood-goods.example/home'>Official website</a><a href='/stores/page/1'>Store</a>"


def pages(spark, html, url):
    return spark.createDataFrame([(1, url, html), (2, url, None)], "page_id long, url string, html string")


def test_pages(spark):
    got = M.search_results(pages(spark, SEARCH, "https://www.amazon.com/s?k=x")).orderBy("position").collect()
    assert [(r.asin, r.product_url, r.title) for r in got] == [("B012345678", "https://www.amazon.com/dp/B012345678", "First"), ("B000000002", "https://www.amazon.com/dp/B000000002", "Second")]
    p = M.products(pages(spark, PRODUCT, "https://www.amazon.com/dp/B012345678")).filter("page_id = 1").first()
    assert (p.asin, p.title, p.brand, p.seller, p.merchant_token, p.seller_profile_url, p.category) == ("B012345678", "A title", "Maplewood", "Fixture Seller", "A2MAPLE77Z9", "https://www.amazon.com/sp?seller=A2MAPLE77Z9", "Tools")
    found = M.sellers(pages(spark, SELLER, "https://www.amazon.com/sp?seller=A2MAPLE77Z9"))
    s = found.filter("page_id = 1").first()
    assert (s.display_name, s.business_name, s.country_code, s.official_website_url, s.manufacturer_score, s.trader_score) == ("Shop", "Maplewood Goods Ltd", "BD", "https://maplewood-goods.example/", 30, 0)
    assert found.filter(M.seller_filter(["BD"], location=True, website=True, name="maplewood", business="manufacturer")).count() == 1
    r = M.seller_records(found.filter("page_id = 1"), F.lit("2024")).first()
    assert (r.normalized_name, r.official_domain, r.quality_score) == ("maplewood goods", "maplewood-goods.example", 100)


def test_urls_and_cooldowns(spark):
    df = spark.createDataFrame([(u,) for u in ("https://a.com/x", "http://u:p@a.com", "http://10.0.0.1/", "ftp://a.com", "http://[::1]/", "http://db.internal", "https://172.20.1.1", "https://172.40.1.1")], "u string")
    assert [r.x for r in df.select(M.public_url(F.col("u")).alias("x")).collect()] == [True, False, False, False, False, False, False, True]
    at = datetime(2024, 1, 1)
    rows = [("https://www.amazon.de/x", 503, "Captcha here", None, at), ("https://www.a.com/", 429, "", "120", at), ("https://a.com/", 200, "fine", None, at)]
    got = {r.adapter: (r.blocked_until, r.reason) for r in M.cooldowns(spark.createDataFrame(rows, "url string, status int, body string, retry_after string, at timestamp")).collect()}
    assert got == {"amazon:amazon.de": (datetime(2024, 1, 8), "blocked"), "official_site:a.com": (datetime(2024, 1, 1, 0, 2), "rate_limited")}
    assert M.search_url("amazon.de", " two  words ", 2) == "https://www.amazon.de/s?k=two+words&page=2"


def test_frontier(spark):
    seeds = spark.createDataFrame([("s",)], "seed string")
    links = spark.createDataFrame([("s", "a"), ("s", "b"), ("a", "s"), ("a", "c"), ("c", "d"), ("d", "e")], "source string, target string")
    assert [(r.url, r.depth) for r in M.frontier(seeds, links).orderBy("depth", "url").collect()] == [("s", 0), ("a", 1), ("b", 1), ("c", 2), ("d", 3)]
    assert M.frontier(seeds, links, budget=2).count() == 2


def test_frontier_of_all_parts(spark, tmp_path):
    from heddle.plans.registry import queries

    n = 600
    spark.range(1, n + 1).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    want = set()
    for seed in range(1, n + 1):
        depth, edge = {seed: 0}, {seed}
        for level in (1, 2, 3):
            edge = {(u * k + 11 * k) % n + 1 for u in edge for k in (2, 3, 5, 7)} - depth.keys()
            depth |= dict.fromkeys(edge, level)
        want |= {(seed, u, depth[u]) for u in sorted(depth, key=lambda u: (depth[u], u))[:25]}
    got = [tuple(r) for r in queries()["crawl_frontier"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
    assert max(sum(s == seed for s, _, _ in want) for seed in range(1, n + 1)) == 25


def test_what_is_sought_is_normalized_once(spark):
    """No worker is asked to normalize the filter's own words for each row."""
    from pyspark.sql import functions as F

    from heddle.functions import text as T
    from heddle.operators import marketplace as M

    df = spark.createDataFrame([("Ｆｕｌｌ—Width STRASSE ß", "Brand#2", "s")], "category string, brand string, title string")
    found = df.filter(M.product_filter(category="full width strasse SS", brand="brand#2"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("nfkc(") == 2 and found.count() == 1
    for x in ("Ｆｕｌｌ—Width  STRASSE ß", "  a#B ", "Ⓐ-x", ""):
        assert df.select((T.search_text(F.lit(x)) == T.sought_text(x)).alias("x")).first().x
