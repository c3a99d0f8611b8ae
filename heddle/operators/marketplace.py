"""Marketplace pages: search results, products and sellers as records, their URLs, filters and cooldowns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from heddle.functions import ids, text as T
from heddle.operators.extraction import MANUFACTURER, TRADER, blocked, retry_after
from heddle.operators.lineage import cut, once

# fixed values: marketplaces by code, each at www.<code>; domains that are no company's own site; patterns of tokens
MARKETPLACES = ["amazon.com", "amazon.co.uk", "amazon.ca", "amazon.com.au", "amazon.de", "amazon.fr", "amazon.it", "amazon.es"]
SOCIAL = ["facebook.com", "instagram.com", "linkedin.com", "pinterest.com", "tiktok.com", "twitter.com", "x.com", "youtube.com"]
PLACES = ["United States of America", "United Kingdom", "Bangladesh", "Australia", "Vietnam", "Pakistan", "Germany", "France", "Canada", "China", "India", "Italy", "Spain", "USA", "UK"]
WEBSITE_LABELS = ["company website", "official website", "website", "web site"]
NAME_LABELS = ["Business Name", "Legal Business Name", "Company Name"]
STOP_LABELS = ["Business Address", "Business Name", "Legal Business Name", "Company Name", "Company capability", "Phone", "VAT"]
ASIN, TOKEN = "[A-Za-z0-9]{10}", "[A-Z0-9]{6,32}"


def _host(url: Column) -> Column:
    return T.domain(url, ascii_only=True)


def marketplace(url: Column) -> Column:
    """The marketplace's code of a URL or host, null for others."""
    host = _host(url)
    return F.when(host.isin(MARKETPLACES), host)


def token(url: Column) -> Column:
    """Merchant token: the first of the parameters seller, me and merchant that is one."""
    get = lambda k: F.upper(F.regexp_extract(url, rf"[?&]{k}=([^&#]*)", 1))
    return F.coalesce(*[F.when(get(k).rlike(f"^{TOKEN}$"), get(k)) for k in ("seller", "me", "merchant")])


def product_url(url: Column) -> Column:
    asin = F.upper(F.regexp_extract(url, rf"/(?:dp|gp/product)/({ASIN})(?:[/?#]|$)", 1))
    return F.when(marketplace(url).isNotNull() & (asin != ""), F.concat(F.lit("https://www."), marketplace(url), F.lit("/dp/"), asin))


def seller_url(url: Column) -> Column:
    store = F.regexp_extract(url, r"://[^/?#]+(/stores/[^?#]*)", 1)
    base = F.concat(F.lit("https://www."), marketplace(url))
    return F.coalesce(F.concat(base, F.lit("/sp?seller="), token(url)), F.when(store != "", F.concat(base, F.rtrim(store, F.lit("/")))))


def search_url(code: str, query: str, page: int = 1) -> str:
    from urllib.parse import urlencode

    query = " ".join(query.split())
    if code not in MARKETPLACES or not 2 <= len(query) <= 100 or not 1 <= page <= 3:
        raise ValueError("no such marketplace, query or page")
    return f"https://www.{code}/s?{urlencode({'k': query} | ({'page': page} if page > 1 else {}))}"


class _Node:
    def __init__(self, tag, attrs, up):
        self.tag, self.attrs, self.up, self.parts = tag, attrs, up, []

    def all(self) -> Iterator["_Node"]:
        for p in self.parts:
            if isinstance(p, _Node):
                yield p
                yield from p.all()

    def text(self) -> str:
        return " ".join("".join(p if isinstance(p, str) else f" {p.text()} " for p in self.parts if isinstance(p, str) or p.tag not in ("script", "style")).split())

    def under(self, key: str) -> bool:
        node = self
        while node:
            if node.attrs.get("id") == key:
                return True
            node = node.up
        return False


class _Dom(HTMLParser):
    EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)
        self.feed(markup or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in self.EMPTY:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.up and node.tag != tag:
            node = node.up
        if node.up:
            self.at = node.up

    def handle_data(self, data):
        self.at.parts.append(data)


def _first(values) -> str | None:
    return next((v for v in values if v), None)


def _search(dom: _Node, url: str) -> list[dict]:
    found: dict[str, dict] = {}
    for card in dom.all():
        asin = card.attrs.get("data-asin", "").strip().upper()
        if card.tag != "div" or not re.fullmatch(ASIN, asin) or asin in found:
            continue
        links = [n for n in card.all() if n.tag == "a" and n.attrs.get("href")]
        inside = [n for n in links if n.up.tag == "h2" or any(x.tag == "h2" for x in (n.up, n.up.up) if x)]
        href = _first([n.attrs["href"] for n in [*inside, *links] if "/dp/" in n.attrs["href"] or "/gp/product/" in n.attrs["href"]])
        if href:
            found[asin] = {"asin": asin, "link": urljoin(url, href), "title": _first(n.text() for n in card.all() if n.tag == "h2")}
    return list(found.values())


def _product(dom: _Node, url: str) -> dict:
    nodes = list(dom.all())
    values = [n.attrs.get("value") for n in nodes if n.tag == "input" and "ASIN" in (n.attrs.get("id"), n.attrs.get("name"))] + [n.attrs.get("data-asin") for n in nodes] + [url]
    asin = _first(m[1].upper() for v in values if v and (m := re.search(rf"(?<![A-Za-z0-9])({ASIN})(?![A-Za-z0-9])", v)))
    by_id = lambda key: _first(n.text() for n in nodes if n.attrs.get("id") == key)
    title = by_id("productTitle") or _first(n.attrs.get("content") for n in nodes if n.tag == "meta" and n.attrs.get("name") == "title")
    brand = re.sub(r"(?i)^\s*(?:visit the|brand\s*:)\s*|\s+store\s*$", "", by_id("bylineInfo") or "").strip() or None
    link = next((n for n in nodes if n.tag == "a" and n.attrs.get("href") and (n.attrs.get("id") == "sellerProfileTriggerId" or re.search(r"[?&]seller=", n.attrs["href"]))), None)
    sold = re.search(r"(?i)\b(?:sold by|seller)\s*:?\s*([^|,]+)", by_id("merchant-info") or "")
    category = _first(n.text() for n in nodes if n.tag == "a" and (n.under("wayfinding-breadcrumbs_feature_div") or n.under("nav-subnav")))
    seller = (link.text() if link else None) or (" ".join(sold[1].split()) if sold else None)
    return {"asin": asin, "title": title, "brand": brand, "seller": seller, "seller_link": urljoin(url, link.attrs["href"]) if link else None, "category": category}


def _labelled(text: str, labels: list[str]) -> str | None:
    stop = "|".join(STOP_LABELS)
    for label in labels:
        m = re.search(rf"(?i)\b{label}\s*:\s*(.+?)(?=\s+(?:{stop})\s*:|$)", text)
        if m:
            return m[1].strip() or None
    return None


#: Sites that are no company's own.
_OTHERS = re.compile(r"https://([^/?#]*[.@])?(" + "|".join(map(re.escape, SOCIAL + MARKETPLACES)) + r")([:/?#]|$)", re.I)


def _seller(dom: _Node, url: str) -> dict:
    nodes = list(dom.all())
    detail = " ".join(n.text() for n in nodes if n.attrs.get("id") in ("page-section-detail-seller-info", "seller-profile-container"))
    name = _first(n.text() for n in nodes if n.attrs.get("id") == "sellerName") or _first(n.text() for n in nodes if n.tag == "h1")
    links = [(urljoin(url, n.attrs["href"]), n.text().lower()) for n in nodes if n.tag == "a" and n.attrs.get("href")]
    store = _first(h for h, _ in links if re.search(r"/stores/|/s\?me=|marketplaceID=", h))
    site = _first(h for h, label in links if any(x in label for x in WEBSITE_LABELS) and h.startswith("https://") and not _OTHERS.match(h))
    return {"name": name, "business_name": _labelled(detail, NAME_LABELS), "location": _labelled(detail, ["Business Address"]), "store_link": store, "site_link": site, "detail": detail}


_S = StringType()
_struct = lambda *names: StructType([StructField(n, _S) for n in names])


def _parser(read, kind):
    def values(pages, urls):
        return [read(_Dom(p).root, u or "") for p, u in zip(pages, urls, strict=True)]

    def many(pages: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series(values(pages, urls))

    def one(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(values(pages, urls), columns=kind.names)

    return F.pandas_udf(many if isinstance(kind, ArrayType) else one, kind)


_search_udf = _parser(_search, ArrayType(_struct("asin", "link", "title")))
_product_udf = _parser(_product, _struct("asin", "title", "brand", "seller", "seller_link", "category"))
_seller_udf = _parser(_seller, _struct("name", "business_name", "location", "store_link", "site_link", "detail"))


def search_results(pages: DataFrame, per_page: int | None = None) -> DataFrame:
    """page_id, position, asin, product_url, title: each product once for a page, the first per_page if asked."""
    rows = pages.select("page_id", F.posexplode(_search_udf("html", "url")).alias("position", "r"))
    rows = rows.select("page_id", F.col("position").cast("long").alias("position"), "r.asin", product_url(F.col("r.link")).alias("product_url"), "r.title").filter("product_url IS NOT NULL")
    return rows if per_page is None else rows.filter(F.col("position") < per_page)


def products(pages: DataFrame) -> DataFrame:
    """page_id, asin, product_url, title, brand, seller, merchant_token, seller_profile_url, category; pages without an ASIN have none."""
    p = once(pages.select("page_id", "url", _product_udf("html", "url").alias("r")), r=F.col("r")).filter("r.asin IS NOT NULL")
    link = F.col("r.seller_link")
    return p.select("page_id", "r.asin", F.coalesce(product_url(F.col("url")), F.col("url")).alias("product_url"), "r.title", "r.brand", "r.seller", token(link).alias("merchant_token"), seller_url(link).alias("seller_profile_url"), "r.category")


def location_country(location: Column) -> Column:
    """Code of the first known country name, of the longest, in a location."""
    return F.coalesce(*[F.when(location.rlike(rf"(?i)(?:^|[,\s]){name}(?:$|[,\s])"), T.country_code(F.lit(name))) for name in sorted(PLACES, key=len, reverse=True)])


def keyword_score(text: Column, terms: list[str]) -> Column:
    return F.least(F.lit(100), sum((F.when(F.contains(F.lower(text), F.lit(t)), 15).otherwise(0) for t in terms), F.lit(0)))


def sellers(pages: DataFrame) -> DataFrame:
    """page_id, marketplace, merchant_token, names, location, country_code, storefront and official site, business scores."""
    p = pages.select("page_id", "url", _seller_udf("html", "url").alias("r"))
    site = _host(F.col("r.site_link"))
    return p.select(
        "page_id",
        marketplace(F.col("url")).alias("marketplace"),
        token(F.col("url")).alias("merchant_token"),
        F.col("r.name").alias("display_name"),
        F.left("r.business_name", F.lit(240)).alias("business_name"),
        F.left("r.location", F.lit(300)).alias("public_location"),
        location_country(F.coalesce("r.location", "r.detail")).alias("country_code"),
        F.col("r.store_link").alias("storefront_url"),
        F.concat(F.lit("https://"), site, F.lit("/")).alias("official_website_url"),
        keyword_score(F.col("r.detail"), MANUFACTURER).alias("manufacturer_score"),
        keyword_score(F.col("r.detail"), TRADER).alias("trader_score"),
    )


def quality_score() -> Column:
    """25, and more for what a seller record has."""
    has = lambda c, points: F.when(F.col(c).isNotNull(), points).otherwise(0)
    return F.least(F.lit(100), F.lit(25) + has("merchant_token", 20) + has("business_name", 15) + has("public_location", 15) + has("official_website_url", 25))


def product_filter(category: str | None = None, brand: str | None = None, seller: str | None = None) -> Column:
    """Products whose normalized category (or title), brand and seller name contain what is asked for."""
    inside = lambda c, what: F.lit(True) if what is None else F.contains(T.search_text(c), T.sought_text(what))
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    return inside(F.coalesce(F.col("category"), F.col("title"), F.lit("")), category) & inside(none("brand"), brand) & inside(none("seller"), seller)


def seller_filter(countries: list[str] | None = None, location: bool = False, website: bool = False, name: str | None = None, business: str | None = None) -> Column:
    """Sellers of the countries, with a location or website if required, of a business type (its score at least 30)."""
    out = F.lit(True)
    if countries:
        out = out & F.coalesce(F.col("country_code").isin(countries), F.lit(False))
    if location:
        out = out & F.col("public_location").isNotNull()
    if website:
        out = out & F.col("official_website_url").isNotNull()
    if name:
        out = out & F.contains(T.search_text(F.coalesce("business_name", "display_name", F.lit(""))), T.search_text(F.lit(name)))
    return out & (F.col(f"{business}_score") >= 30) if business else out


def seller_records(found: DataFrame, observed_at: Column) -> DataFrame:
    """Seller rows of the ingest contract, with ids made from marketplace and token."""
    key = F.concat_ws(":", "marketplace", F.coalesce("merchant_token", F.lower("display_name")))
    name = F.coalesce("business_name", "display_name")
    return found.select(ids.uuid7("seller", key).alias("id"), name.alias("canonical_name"), T.company_name(name)["normalized"].alias("normalized_name"), "country_code", _host(F.col("official_website_url")).alias("official_domain"), F.lit("active").alias("status"), quality_score().alias("quality_score"), observed_at.alias("first_seen_at"), observed_at.alias("last_seen_at"))


def cooldowns(responses: DataFrame, site_seconds: int = 86_400, market_seconds: int = 604_800) -> DataFrame:
    """adapter, blocked_until, reason for each blocked response (url, status, body, retry_after, at): a 429 waits as it says, others a day, marketplaces a week."""
    hit = responses.filter(blocked(F.col("status"), F.col("body")))
    market = marketplace(F.col("url"))
    wait = F.when(F.col("status") == 429, retry_after(F.col("retry_after"), F.col("at"))).when(market.isNotNull(), market_seconds).otherwise(site_seconds)
    name = F.coalesce(F.concat(F.lit("amazon:"), market), F.concat(F.lit("official_site:"), _host(F.col("url"))))
    return hit.select(name.alias("adapter"), F.timestamp_seconds(F.unix_timestamp("at") + wait).alias("blocked_until"), F.when(F.col("status") == 429, "rate_limited").otherwise("blocked").alias("reason"))


PRIVATE = r"^(localhost|.*[.](local|internal|localhost)|127[.].*|10[.].*|192[.]168[.].*|169[.]254[.].*|172[.](1[6-9]|2[0-9]|3[01])[.].*|(22[4-9]|23[0-9])[.].*|0[.].*|\[.*\]?)$"


def public_url(url: Column) -> Column:
    """http(s), no credentials, a host that is neither private, link-local, multicast nor an IPv6 literal."""
    rest = F.regexp_extract(url, r"^(?i:https?)://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(rest, r":\d*$", ""))
    return (rest != "") & ~F.contains(rest, F.lit("@")) & ~host.rlike(PRIVATE) & ~F.startswith(rest, F.lit("["))


def declared_source(url: Column, domain: Column) -> Column:
    """Whether a source's URL stands on its declared domain."""
    return F.coalesce(_host(url) == T.domain(domain, ascii_only=True), F.lit(False))


def url_policy(url: Column, robots: Column, terms: Column) -> Column:
    """Why a source must not be fetched, or null: its URL, then robots, then terms."""
    rest = F.regexp_extract(url, r"^(?i:https?)://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r":\d*$", ""))
    return (
        F.when(~F.coalesce(url.rlike(r"(?i)^https?:"), F.lit(False)), "scheme")
        .when(F.contains(rest, F.lit("@")), "credentials")
        .when(host == "", "host")
        .when(host.rlike(r"^\[?(localhost|127[.][0-9.]+|0[.]0[.]0[.]0|::1?)\]?$"), "private")
        .when(F.lower(robots) == "deny", "robots")
        .when(F.lower(terms) == "restricted", "terms")
    )


def source_policy(sources: DataFrame, allowed: DataFrame) -> DataFrame:
    """sources (run_id, source_url, canonical_url, source_domain) with errors: URLs that must not be sources, a domain that isn't the URL's, or a host that is not on its run's list.

    allowed: run_id, domain; a null run_id holds for all runs. A run without any list may
    use any host. The list meets the sources by run and host in one equi join.
    """
    every = allowed.filter("run_id IS NULL").select(F.col("domain").alias("__any")).distinct()
    own = allowed.filter("run_id IS NOT NULL").select(F.col("run_id").alias("__run"), F.col("domain").alias("__domain")).distinct()
    runs = own.select(F.col("__run").alias("__listed")).distinct()
    open_ = allowed.filter("run_id IS NULL").limit(1).count() == 0
    url, canon = F.col("source_url"), F.col("canonical_url")
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    s = sources.withColumn("__host", host)
    s = s.join(own, (F.col("run_id") == F.col("__run")) & (F.col("__host") == F.col("__domain")), "left")
    s = s.join(every, F.col("__host") == F.col("__any"), "left").join(runs, F.col("run_id") == F.col("__listed"), "left")
    bound = F.lit(True) if not open_ else F.col("__listed").isNotNull()
    listed = F.col("__domain").isNotNull() | F.col("__any").isNotNull()
    http = lambda u: F.coalesce(u.rlike(r"(?i)^https?://"), F.lit(False))
    secret = lambda u: F.coalesce(u.rlike(r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*@"), F.lit(False))
    rules = {
        "source_url": ~http(url),
        "canonical_url": ~http(canon),
        "credentials": secret(url) | secret(canon),
        "private": F.col("__host").rlike(r"^(localhost|127[.][0-9.]+|0[.]0[.]0[.]0)$"),
        "domain": ~F.coalesce(F.lower("source_domain") == F.col("__host"), F.lit(False)),
        "allow_list": bound & ~listed,
    }
    errors = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda e: e.isNotNull())
    return s.withColumn("errors", errors).drop("__host", "__run", "__domain", "__any", "__listed")


def frontier(seeds: DataFrame, links: DataFrame, depth: int = 3, budget: int = 25, same_domain: bool = False) -> DataFrame:
    """seed, url, depth over a link table (source, target): breadth first, each URL of a seed once, budget at most for each seed; with same_domain those of the seed's domain only.

    Each level joins the new URLs with the links and is cut at once to what is left of each
    seed's budget, first by URL, so no level is larger than the result; levels are stored.
    """
    from pyspark.sql import Window

    seen = edge = seeds.select("seed").distinct().select("seed", F.col("seed").alias("url"), F.lit(0).alias("depth"))
    w = Window.partitionBy("seed").orderBy("url")
    for level in range(1, depth + 1):
        new = edge.join(links, F.col("url") == F.col("source")).select("seed", F.col("target").alias("url"))
        if same_domain:
            new = new.filter(T.domain(F.col("url")) == T.domain(F.col("seed")))
        new = new.distinct().join(seen.select("seed", "url"), ["seed", "url"], "left_anti").withColumn("__k", F.row_number().over(w))
        left = seen.groupBy(F.col("seed").alias("__seed")).agg((F.lit(budget) - F.count("*")).alias("__left"))
        new = new.join(left, F.col("seed") == F.col("__seed")).filter(F.col("__k") <= F.col("__left"))
        edge = cut(new.select("seed", "url", F.lit(level).alias("depth")))
        seen = seen.unionByName(edge)
    return seen
