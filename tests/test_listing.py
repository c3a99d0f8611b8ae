"""Listings, records, registered functions, exports and decisions on small tables."""

from datetime import datetime

from pyspark.sql import functions as F

from heddle.functions import register, text as T
from heddle.operators import extraction as E
from heddle.operators import listing as L
from heddle.operators import records as Rec
from heddle.operators import resolution as X
from heddle.operators import search as S
from heddle.sources import batches, export


def relations(spark):
    sellers = spark.createDataFrame(
        [(1, "Café One", "active", "CN", "one.com", 90, 60, 30, "2024-01-05"), (2, "two", "merged", "CN", None, 80, 0, 0, "2024-01-01"), (3, "Three", "active", "US", None, 10, 0, 90, "2024-01-09")],
        "id long, name string, status string, country string, domain string, confidence int, manufacturer_score int, trader_score int, updated_at string",
    ).withColumns({"updated_at": F.col("updated_at").cast("date"), "first_seen_at": F.lit("2023-01-01").cast("date"), "last_seen_at": F.lit("2024-01-01").cast("date")})
    return {
        "sellers": sellers,
        "accounts": spark.createDataFrame([(1, 1, "m", "T1", 5, "Shop"), (2, 1, "n", "T2", 5, "Shöp 100%"), (3, 3, "m", "T3", 1, None)], "id long, seller_id long, marketplace string, token string, last_seen int, display_name string"),
        "products": spark.createDataFrame([(1, "Acme", "Tools"), (3, None, "toys")], "seller_id long, brand string, category string"),
        "decisions": spark.createDataFrame([(1, 1, 2, 95, "merged", 1), (2, 3, 1, 70, "pending", 2)], "id long, candidate_id long, matched_id long, score int, status string, created_at int"),
        "contacts": spark.createDataFrame([(1, 1, "email", 80, 9, None, "h1", "active", 1), (2, 1, "phone", 60, 8, 7, "h2", "active", 2), (3, 3, "email", 50, 7, None, "h3", "active", 1), (4, 3, "email", 50, 9, None, "h4", "off", 1)],
                                          "id long, seller_id long, contact_type string, confidence int, last_seen int, verified_at int, hash string, status string, source_id long"),
        "suppressions": spark.createDataFrame([(None, "h2", None), (3, None, datetime(2020, 1, 1))], "seller_id long, hash string, expires_at timestamp"),
        "sources": spark.createDataFrame([(1, 1, "official_site"), (2, 3, "directory")], "id long, seller_id long, source_type string"),
        "run_sellers": spark.createDataFrame([(7, 1), (8, 3)], "run_id long, seller_id long"),
        "index": S.index(spark.createDataFrame([(1, "Café One", "Acme"), (3, "Three", None)], "seller_id long, a string, b string"), "seller_id", ["a", "b"]),
    }


def test_seller_facets(spark):
    rel = relations(spark)
    found = lambda **f: sorted(r.id for r in L.seller_facets(rel, L.Facets(**f)).collect())
    assert found() == [1, 3]
    for facet, want in (
        ({"query": "CAFE acm"}, [1]), ({"query": "!!"}, [1, 3]), ({"status": "active"}, [1, 3]), ({"country": "us"}, [3]), ({"website": True}, [1]), ({"website": False}, [3]), ({"marketplace": "m"}, [1, 3]),
        ({"account": "100%"}, [1]), ({"account": "t3"}, [3]), ({"account": "_"}, []), ({"category": "TO"}, [1, 3]), ({"brand": "acme"}, [1]), ({"manufacturer": 60}, [1]), ({"trader": 60}, [3]), ({"duplicate_status": "pending"}, [1, 3]),
        ({"duplicate_status": "merged"}, [1]), ({"updated_since": "2024-01-06"}, [3]), ({"contact_type": "phone"}, [1]), ({"source_type": "directory"}, [3]), ({"run": 7}, [1]), ({"run": 7, "country": "US"}, []),
    ):
        assert found(**facet) == want, facet


def test_pages(spark):
    rel = relations(spark)
    rows = L.list_sellers(rel, L.Facets(sort="most_contacts", limit=1)).collect()
    assert [(r.id, r.marketplace, r.duplicate_status, r.contact_count, r.contact_types, r.total) for r in rows] == [(1, "n", "pending", 2, "email,phone", 2)]
    order = lambda sort: [r.id for r in L.list_sellers(rel, L.Facets(sort=sort)).orderBy(*L.SORTS[sort](), "id").collect()] if sort != "most_contacts" else None
    assert order("seller_name") == [1, 3] and order("recently_updated") == [3, 1] and order("highest_confidence") == [1, 3]
    got = L.list_contacts(rel, L.Facets(), F.lit("2024-01-01").cast("timestamp")).collect()
    assert sorted((r.id, r.seller_name, r.source_type, r.total) for r in got) == [(1, "Café One", "official_site", 2), (3, "Three", "official_site", 2)]
    assert [r.id for r in L.list_contacts(rel, L.Facets(query="thr"), F.lit("2024-01-01").cast("timestamp")).collect()] == [3]
    pending = L.api_shape(L.list_duplicates(rel, "pending")).collect()
    assert [(r.candidateName, r.matchedName, r.total) for r in pending] == [("Three", "Café One", 1)]
    assert "CartesianProduct" not in L.list_sellers(rel, L.Facets())._jdf.queryExecution().executedPlan().toString()


def test_records_and_titles(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    title = lambda t: one(E.company_from_title(F.lit(t), F.lit("acme-export.com")))
    assert [title(t) for t in ("Acme Ltd | Home", "Home | Acme - x", "Contact", "Untitled page", "")] == ["Acme Ltd", "Home | Acme", "Contact", "Acme Export", "Acme Export"]
    assert one(E.evidence_line({"a": F.lit("1"), "b": F.lit(None).cast("string"), "c": F.lit("3")})) == "a=1|c=3"
    assert one(Rec.identity_confidence(F.lit("search"), F.lit(None).cast("string"), F.lit("x"))) == 60
    at = F.lit("2024")
    aliases = Rec.alias_records(spark.createDataFrame([("s", "Acme LTD"), ("s", "ACME ltd"), ("t", None)], "seller_id string, alias string"), at).collect()
    assert [(r.alias, r.normalized_alias) for r in aliases] == [("ACME ltd", "acme")] and len(aliases[0].id) == 36
    found = spark.createDataFrame([("s", "q", "email", "a@b.co", "a***@b.co", "c", 80)], "seller_id string, source_id string, contact_type string, value string, masked string, classification string, confidence int")
    record = Rec.contact_records(found, F.lit(b"0" * 32), F.lit(b"1" * 12), at).first()
    assert set(batches.ARRAYS["contacts"]) >= set(record.asDict()) and "a@b.co" not in str(record)
    assert [r.name for r in Rec.first_names(spark.createDataFrame([("d", "b", 1), ("d", "a", 2)], "domain string, name string, n int"), ["n"]).collect()] == ["b"]
    totals = Rec.run_totals(spark.createDataFrame([(1, 1, 5), (1, 1, 5), (1, 2, 3)], "run_id int, batch_number int, contacts_found int"))
    assert [r.total_found for r in totals.orderBy("batch_number").collect()] == [5, 8]
    assert str(one(T.iso_time(F.lit("2024-01-01T10:00:00")))) == str(one(T.iso_time(F.lit("2024-01-01T12:00:00+02:00")))) and one(T.iso_time(F.lit("soon"))) is None


def test_parser_and_masks(spark):
    text, links = E.page_document("<!-- a@b.co --><p title='T &amp; t'>x<b>y</b></p><script>s@s.co</script><script type='application/ld+json'>{\"e\":1}</script><noscript><a href=n></noscript><a HREF=\"/u?a=1&amp;b\">l</a> 1 < 2<style>z")
    assert (text, links) == ("T & t x y {\"e\":1} /u?a=1&b l 1 < 2", ["/u?a=1&b"]) and E.page_document(None) == ("", [])
    page = spark.createDataFrame([(1, "https://acme.com/contact", '<a href="mailto:Sales@Acme.com">SALES@ACME.COM</a> call (415) 555-0101 or big at acme dot co dot uk')], "page_id long, url string, html string")
    got = {r.value: r for r in E.contacts(page, region="US", least=0).collect()}
    assert set(got) == {"sales@acme.com", "+14155550101", "big@acme.co.uk"}
    assert "acme.com" not in got["sales@acme.com"].evidence.lower().replace("sa***@acme.com", "")
    plan = E.contacts(page)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") + plan.count("ArrowEvalPython(") <= 1 or plan.count("ArrowEvalPython") <= 2
    assert E.in_order(E.contacts(page, least=0)).first().contacts[0].contact_type == "email"


def test_registered_functions(spark):
    names = register.register(spark)
    assert "heddle_links" in names
    assert spark.sql("SELECT heddle_masked_email('sales@x.com') AS m, heddle_nfkc('ﬁ') AS n, heddle_review_status(60) AS r").first() == ("sa***@x.com", "fi", "manual_review")
    rows = spark.sql("SELECT t.* FROM (SELECT '<a href=\"mailto:a@b.co\">x</a><a href=\"/y\">y</a>' AS html) p, LATERAL heddle_links(p.html) t").collect()
    assert [tuple(r) for r in rows] == [("email", "mailto:a@b.co"), ("relative", "/y")]


def test_decisions_and_merges(spark):
    d = spark.createDataFrame([(1, "pending"), (2, "merged"), (3, "separate")], "id long, status string")
    asked = spark.createDataFrame([(1, "merge"), (2, "merge"), (3, "merge"), (4, "merge"), (5, "huh")], "id long, request string")
    after, receipts = X.decide(d, asked)
    assert {r.id: r.receipt for r in receipts.collect()} == {1: "applied", 2: "duplicate", 3: "conflict", 4: "not_found", 5: "invalid"}
    assert {r.id: r.status for r in after.collect()} == {1: "merged", 2: "merged", 3: "separate"}
    sellers = spark.createDataFrame([(1, "active"), (2, "active")], "id long, status string")
    rows = spark.createDataFrame([(10, 1), (11, 2)], "id long, seller_id long")
    s, children, made = X.auto_merge(sellers, {"accounts": rows}, spark.createDataFrame([(1, 2, 95), (2, 1, 80)], "candidate_id long, existing_id long, score int"))
    assert {(r.id, r.status, r.merged_into) for r in s.collect()} == {(1, "merged", 2), (2, "active", None)}
    assert {tuple(r) for r in children["accounts"].collect()} == {(10, 2), (11, 2)} and {r.action for r in made.collect()} == {"auto_merge", "review_queue"}
    errors = lambda *a: spark.range(1).select(X.decision_errors(*[F.lit(x) for x in a]).alias("e")).first().e
    assert errors("auto_merge", 95, 1, 2) == [] and errors("x", 101, 1, 1) == ["action", "score", "self"]


def test_best_name_over_aliases(spark):
    s = "id long, name string, domain string, country string, city string, aliases array<string>"
    new = spark.createDataFrame([(1, "zzz", "d.com", None, None, ["Precision Tools", None])], s)
    old = spark.createDataFrame([(2, "precision tool", "d.com", None, None, None)], s)
    parts = {c.code for c in X.score(X.candidates(new, old), new, old, "sequence").first().components}
    assert parts == {"official_domain_match", "name_fuzzy"}


def test_csv_files_have_bom_and_head(spark, tmp_path):
    export.write_csv(spark.createDataFrame([("=1", "é")], "a string, b string").coalesce(1), str(tmp_path / "csv"), ["b", "a"])
    (part,) = [p for p in (tmp_path / "csv").iterdir() if p.name.startswith("part")]
    assert part.read_bytes().decode() == '﻿"b","a"\r\n"é","\'=1"\r\n'
    assert set(export.SELLER_COLUMNS) <= set(batches.ARRAYS["sellers"])
    export.write_jsonl(spark.range(2), str(tmp_path / "jsonl"))
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 2
    batches.write(spark.createDataFrame([(2, None, 1)], "b int, c int, a int"), str(tmp_path / "gz"))
    assert [r.body for r in batches.read(spark, str(tmp_path / "gz")).collect()] == ['{"a":1,"b":2}']


def test_index_is_refreshed(spark):
    before = spark.createDataFrame([(1, "old name"), (2, "other"), (3, "gone")], "k long, a string")
    after = spark.createDataFrame([(1, "new name"), (2, "changed but not looked at")], "k long, a string")
    changed = spark.createDataFrame([(1,), (3,)], "k long")
    got = S.refresh(S.index(before, "k", ["a"]), after, changed, "k", ["a"])
    assert {tuple(r) for r in got.collect()} == {(1, "new"), (1, "name"), (2, "other")}
