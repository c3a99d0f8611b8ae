"""Functions, extraction, upserts, resolution, streaming and export on small fixtures."""

import hashlib
import hmac
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from heddle.functions import ids, text as T
from heddle.operators import extraction as E
from heddle.operators import relational as R
from heddle.operators import resolution as X
from heddle.operators import search as S
from heddle.operators import upsert as U
from heddle.sources import batches, export
from heddle.streaming import ingest


def one(spark, expr, *values, schema=None):
    cols = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], schema or cols).select(expr.alias("x")).first().x


def test_text_functions(spark):
    v = F.col("c0")
    assert one(spark, T.company_name(v), "ACME Industrial Co., Ltd.").normalized == "acme industrial"
    assert one(spark, T.company_name(v), "深圳实业有限公司").normalized == "深圳"
    assert one(spark, T.domain(v), "HTTPS://www.Example.COM:443/contact") == "example.com"
    assert one(spark, T.domain(v), "localhost") is None and one(spark, T.domain(v), "bücher.de") == "xn--bcher-kva.de"
    assert one(spark, T.country_code(v), "People's Republic of China") == "CN"
    assert one(spark, T.country_code(v), "uk") == "UK" and one(spark, T.country_code(v), "United Kingdom") == "GB" and one(spark, T.country_code(v), "Narnia") is None
    assert one(spark, T.masked_address(v), "Building 5, 88 Longhua Road, Shenzhen, Guangdong, China") == "***, Shenzhen, Guangdong, China"
    assert one(spark, T.search_text(v), "  Ｆｕｌｌ—Width  STRASSE ß ") == "full width strasse ss"
    assert one(spark, T.without_accents(v), "Éclair Ñ") == "eclair n"
    assert one(spark, T.bigram_dice(F.col("c0"), F.col("c1")), "night", "nacht") == 0.25
    assert one(spark, T.bigram_dice(F.col("c0"), F.col("c1")), "a", "b") == 0.0
    assert one(spark, T.context_window(F.col("c0"), F.col("c1"), 3), "abcdefghij", "EF") == "bcdefghi"


def test_ids(spark):
    v = F.col("c0")
    assert one(spark, ids.masked_phone(v), "+14155552671") == "+*******2671"
    assert one(spark, ids.masked_email(v), "sales@x.com") == "sa***@x.com"
    assert one(spark, ids.is_uuid7(ids.uuid7("seller", v)), "x") is True
    assert one(spark, ids.hmac_sha256(b"k", v), "message") == hmac.new(b"k", b"message", hashlib.sha256).hexdigest()
    key, nonce = F.lit(b"0123456789abcdef0123456789abcdef"), F.lit(b"012345678901")
    sealed = ids.seal(v, key, nonce, F.lit("a"))
    assert one(spark, sealed, "secret").startswith("si-aesgcm:v1:1:")
    assert one(spark, ids.open_sealed(sealed, key, F.lit("a")), "secret") == "secret"
    assert one(spark, ids.open_sealed(sealed, key, F.lit("b")), "secret") is None


def test_sealed_values_are_aes_256_gcm(spark):
    """The published test vector of AES-256-GCM with 96 bits of nonce and additional data."""
    import base64

    raw = lambda b: base64.urlsafe_b64encode(bytes.fromhex(b)).rstrip(b"=").decode()
    key, nonce, aad = "feffe9928665731c6d6a8f9467308308" * 2, "cafebabefacedbaddecaf888", "feedfacedeadbeeffeedfacedeadbeefabaddad2"
    plain = "d9313225f88406e5a55909c5aff5269a86a7a9531534f7da2e4c303d8a318a721c3c0c95956809532fcf0e2449a6b525b16aedf5aa0de657ba637b39"
    sealed = "522dc1f099567d07f47f37a32a84427d643a8cdcbfe5c0c97598a2bd2555d1aa8cb08e48590dbb3da7b08b1056828838c5f61e6393ba7a0abcc9f662" + "76fc6ece0f4e1768cddf8853bb2d551b"
    hexed = lambda x: F.unhex(F.lit(x))
    assert one(spark, ids.seal(F.unhex("c0"), hexed(key), hexed(nonce), hexed(aad)), plain) == f"si-aesgcm:v1:1:{raw(nonce)}:{raw(sealed)}"


PAGE = """<html><head><title>Acme <b>Export</b></title><style>x</style><script>hidden@evil.com</script></head><body>
<a href="mailto:sales@acme-export.com">Email our sales team</a> support [at] acme-export [dot] com
<a href="tel:+14155552671">Call phone</a> <a href="https://wa.me/14155552672">WhatsApp</a> WhatsApp +1 415 555 2672
WeChat ID: AcmeExport_88 wholesale supplier noreply@acme-export.com name@example.com</body></html>"""


def test_contacts(spark):
    df = spark.createDataFrame([(1, "https://acme-export.com/contact-us", PAGE), (2, "https://x.com/", None)], "page_id long, url string, html string")
    got = {(r.contact_type, r.value): r for r in E.contacts(df).collect()}
    assert set(got) >= {("email", "sales@acme-export.com"), ("email", "support@acme-export.com"), ("phone", "+14155552671"), ("whatsapp", "+14155552672"), ("wechat", "acmeexport_88")}
    assert not [v for _, v in got if "noreply" in v or "example.com" in v or "evil" in v]
    assert all(r.review_status == "accepted" for r in got.values() if r.contact_type in ("email", "wechat"))
    assert "sales@acme-export.com" not in got["email", "sales@acme-export.com"].evidence
    assert one(spark, E.page_title(F.col("c0")), PAGE) == "Acme Export" and one(spark, E.page_title(F.col("c0")), "x") == "Untitled page"


def test_urls(spark):
    assert one(spark, E.canonical_url(F.col("c0"), F.col("c1")), "../about/?q=1#x", "HTTP://WWW.Acme.com:80/a/b") == "http://acme.com/about"
    assert one(spark, E.canonical_url(F.col("c0"), F.col("c1")), "javascript:x", "http://acme.com") is None
    assert one(spark, E.allowed_url(F.col("c0")), "https://a.com/About") and not one(spark, E.allowed_url(F.col("c0")), "https://a.com/login/about")
    assert one(spark, E.sitemap_urls(F.col("c0")), "<loc> http://a/ </loc><loc>http://b</loc>") == ["http://a/", "http://b"]
    wait = lambda h: one(spark, E.retry_after(F.col("c0"), F.lit("2024-01-01 00:00:00").cast("timestamp")), h)
    assert (wait("120"), wait("0"), wait("Mon, 01 Jan 2024 00:10:00 GMT"), wait("soon"), wait(None)) == (120, 1, 600, 3600, 3600)
    df = spark.createDataFrame([(1, "https://a.com/x", '<a href="/contact">c</a><a href="/login">l</a><a href="https://b.com/about">b</a>')], "page_id long, url string, html string")
    plan = [r.url for r in E.crawl_plan(df, 4).orderBy("position").collect()]
    assert plan == ["https://a.com/x", "https://a.com/", "https://a.com/about", "https://a.com/about-us"]


def test_resolution(spark):
    ident = "id long, name string, domain string, country string, city string, hashes array<string>, aliases array<string>, tokens array<string>"
    new = spark.createDataFrame([(1, "acme tools", "acme.com", "CN", "sz", ["h"], [], ["t"]), (2, "other things", None, "US", None, None, None, None)], ident)
    old = spark.createDataFrame([(10, "acme tools", "acme.com", "CN", "sz", [], ["x"], ["t"]), (11, "acme tool", "zzz.com", "US", None, ["h"], ["acme tools"], None), (12, "no", None, None, None, None, None, None)], ident)
    pairs = X.candidates(new, old)
    assert {tuple(r) for r in pairs.collect()} == {(1, 10), (1, 11)}
    got = {r.existing_id: r for r in X.score(pairs, new, old).collect()}
    assert got[10].score == 100 and {c.code for c in got[10].components} == {"official_domain_match", "normalized_name_exact", "country_match", "city_match"}
    assert got[11].score == max(0, -30 + 25 + 35 - 18)
    seq = {r.existing_id: {c.code: c.points for c in r.components} for r in X.score(pairs, new, old, "sequence").collect()}
    assert seq[10]["marketplace_token_match"] == 100 and seq[11]["alias_name_exact"] == 35
    tie = spark.createDataFrame([(1, 5, 80), (1, 3, 80), (1, 9, 70)], "candidate_id long, existing_id long, score int")
    assert tuple(X.best(tie).first()) == (1, 3, 80)


def test_blocks_stay_bounded(spark):
    same = spark.createDataFrame([(i, "one very common name", "d.com") for i in range(300)], "id long, name string, domain string")
    got = X.candidates(same, same)
    assert got.count() == 300 * 25 and {r.existing_id for r in got.filter("candidate_id = 3").collect()} == set(range(26)) - {3}


@pytest.mark.parametrize("scorer", ["dice", "sequence"])
def test_pairs_are_not_broadcast(spark, tmp_path, scorer):
    """A small file of identities makes many times as many pairs, which Spark can't foresee: none of them, nor the identities, go to the driver."""
    rows = [(i, f"blue bolt {i % 5}", f"d{i % 3}", "US", "x", [f"h{i % 3}"]) for i in range(60)]
    spark.createDataFrame(rows, "id long, name string, domain string, country string, city string, hashes array<string>").write.parquet(str(tmp_path / "i"))
    i = spark.read.parquet(str(tmp_path / "i"))
    scored = X.score(X.candidates(i, i), i, i, scorer)
    assert "Broadcast" not in scored._jdf.queryExecution().executedPlan().toString()
    assert scored.count() == 60 * 25
    assert "Broadcast" not in scored._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("together", "meeting"), [(64, 2048), (2, 5)])
def test_all_pairs_are_scored(spark, monkeypatch, together, meeting):
    """score_all gives what score gives without a limit, each pair once, also where groups and blocks are dealt out."""
    monkeypatch.setattr(X, "TOGETHER", together)
    monkeypatch.setattr(X, "MEETING", meeting)
    names, domains = ["blue bolt", "blue bolts", "Blue bolt ", "nut", "nut", "blue boxes", "", None], ["a.com", "b.com", "A.com", "", None]
    rows = [(i, names[i % 8], domains[i % 5], [None, "US", "us", "CN"][i % 4], ["x", "y", None][i % 3], [f"h{i % 6}"] if i % 7 else None, "active" if i % 9 else "merged") for i in range(130)]
    known = spark.createDataFrame(rows, "id long, name string, domain string, country string, city string, hashes array<string>, status string")
    for new in (known, known.withColumn("id", F.col("id") + 1000).filter("id % 3 = 0")):
        got = [str(r) for r in X.score_all(new, known).collect()]
        want = {str(r) for r in X.score(X.candidates(new, known, 10**6), new, known).collect()}
        assert set(got) == want and len(got) == len(want) > 500


def test_er_scored_is_whole(spark, tmp_path):
    from heddle.plans import registry

    spark.range(60).selectExpr("id AS p_partkey", "concat('part number ', id % 4) AS p_name", "'B' AS p_brand", "'T' AS p_type", "CAST(id % 5 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.queries()["er_scored"](spark, str(tmp_path))
    assert got.count() == got.select("candidate_id", "existing_id").distinct().count() == 60 * 59
    assert registry.queries()["er_decisions"](spark, str(tmp_path)).count() == 60 * 25  # its SQL has the limit


def test_search(spark):
    df = spark.createDataFrame([(1, "Acme Precision Tools", None), (2, "Acme", "Fixtures")], "id long, name string, brand string")
    idx = S.index(df, "id", ["name", "brand"])
    ids_ = lambda *a, **k: sorted(r.id for r in S.match(idx, "id", *a, **k).collect())
    assert ids_("acm") == [1, 2] and ids_("acme tool") == [1] and ids_("acme zzz") == [] and ids_("precision fixt", every=False) == [1, 2] and ids_("!!") == [1, 2]
    assert S.parse("a b c d e f g h i j") == list("abcdefgh")


def test_upsert_policies(spark):
    s = "id long, a string, b string, n int"
    old = spark.createDataFrame([(1, "x", None, 1), (2, "keep", "b", 2)], s)
    new = spark.createDataFrame([(1, None, "new", 5, 2), (1, "mid", "late", 6, 1), (3, "z", "z", 9, 1)], s + ", at int")
    got = {r.id: tuple(r)[1:] for r in U.upsert(old, new, ["id"], {"b": "keep", "n": "sum"}, order="at").collect()}
    assert got == {1: (None, "late", 12), 2: ("keep", "b", 2), 3: ("z", "z", 9)}
    held = U.upsert(old, new.drop("at"), ["id"], {"b": "first", "n": "first"}, sticky={"a": F.col("a") == "x"})
    assert {r.id: (r.a, r.b, r.n) for r in held.collect()}[1] == ("x", None, 1)


def test_relational(spark):
    c = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, 30, "c"), (4, None, "d")], "id long, s long, h string")
    held = spark.createDataFrame([(10, None), (None, "b")], "s long, h string")
    assert sorted(r.id for r in R.anti_any(c, held, {"s": "s", "h": "h"}).collect()) == [3, 4]
    ends = spark.createDataFrame([(1, 3), (9, 1)], "x long, y long")
    assert sorted(r.id for r in R.semi_any(c, ends, "id", ["x", "y"]).collect()) == [1, 3]
    rows = R.page(c, [F.asc("id")], 2, 3).collect()
    assert [(r.id, r.total) for r in rows] == [(4, 4)] and R.clamp_page(999, -1) == (100, 0) and R.clamp_page(None, None) == (50, 0)
    assert "NestedLoop" not in R.semi_any(c, ends, "id", ["x", "y"])._jdf.queryExecution().executedPlan().toString()


uid = lambda n: f"01890000-0000-7000-8000-{n:012d}"
RUN = uid(1)
SEEN = {"first_seen_at": "2024", "last_seen_at": "2024"}
SEALED = "si-aesgcm:v1:1:abc:def"


def seller(i, name="n", first="2024", **more):
    return {"schema_version": 1, "parser_version": "p", "id": uid(i), "canonical_name": name, "normalized_name": name, "first_seen_at": first, "last_seen_at": "2024", "created_at": first, "updated_at": "2024", **more}


def contact(i, **more):
    return {"schema_version": 1, "parser_version": "p", "id": uid(i), "seller_id": uid(1), "contact_type": "email", "contact_value_ciphertext": SEALED, "normalized_hash": "h", "classification": "c", "confidence": 80, "source_id": uid(9), **SEEN, **more}


def batch(number, run=RUN, **arrays):
    return {"schema_version": 1, "parser_version": "p", "crawl_run_id": run, "batch_number": number, "generated_at": "2024-01-01T00:00:00Z", **arrays}


def requests(spark, *docs, **columns):
    rows = [(d if isinstance(d, str) else json.dumps(d), datetime(2024, 1, 1, 0, 0, i)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "body string, arrived timestamp")


def test_batch_contract(spark):
    alias = {"id": uid(3), "seller_id": uid(1), "alias": "a", "normalized_alias": "a", "alias_type": "t", **SEEN}
    flag = {"flag_name": "f", "updated_at": "2024"}
    docs = {
        "good": (batch(0, sellers=[seller(1, china_confidence=5, city=None)], seller_aliases=[alias], contacts=[contact(2)], feature_flags=[flag]), []),
        "null arrays": (batch(1, sellers=None), []),
        "broken": ("{broken", ["body must be valid JSON"]),
        "no object": ("[1]", ["body must be a JSON object"]),
        "large": (json.dumps(batch(0, sellers=[seller(1, city="x" * (1 << 20))])), ["body is too large"]),
        "unknown": (batch(0, extra=1, sellers=[seller(1, nick="x")]), ["$.extra is not allowed", "$.sellers[0].nick is not allowed"]),
        "missing": ({"schema_version": 1, "sellers": [{}]}, ["$.batch_number is required", "$.sellers[0].id is required", "$.sellers[0].canonical_name is required"]),
        "empty": (batch(0, seller_aliases=[alias | {"alias": ""}]), ["$.seller_aliases[0].alias is required"]),
        "types": (batch(-1, sellers=[seller(1, city=5, quality_score=1.5)], feature_flags=[flag | {"enabled": "yes"}]), ["$.batch_number must be a non-negative integer", "$.sellers[0].city must be a string", "$.sellers[0].quality_score must be a non-negative integer", "$.feature_flags[0].enabled must be a boolean"]),
        "run": (batch(0, run="bad"), ["$.crawl_run_id must be a version 7 UUID"]),
        "version": (batch(0) | {"schema_version": 2}, ["$.schema_version must be 1"]),
        "plain": (batch(0, contacts=[contact(2, contact_value_ciphertext="plain", confidence=101)]), ["$.contacts[0].contact_value_ciphertext must be a sealed value", "$.contacts[0].confidence must be an integer between 0 and 100"]),
        "no array": (batch(0, sources={}), ["$.sources must be an array"]),
        "no record": (batch(0, crawl_runs=[5]), ["$.crawl_runs[0] must be an object"]),
        "many sellers": (batch(0, sellers=[seller(i) for i in range(26)]), ["$.sellers exceeds maximum 25", "batch write count exceeds maximum 20"]),
        "many": (batch(0, sellers=[seller(i) for i in range(10)], feature_flags=[flag | {"flag_name": str(i)} for i in range(11)]), ["batch write count exceeds maximum 20"]),
    }
    got = [r.errors for r in batches.checked(requests(spark, *[d for d, _ in docs.values()])).orderBy("arrived").collect()]
    for (name, (_, want)), errors in zip(docs.items(), got, strict=True):
        assert (set(want) <= set(errors) and bool(want) == bool(errors)) and (name == "missing" or len(want) == len(errors)), (name, errors)
    accepted, rejected = batches.validated(requests(spark, docs["good"][0]))
    r = accepted.first()
    assert (r.writes, r.idempotency_key, r.sellers[0].china_confidence, r.contacts[0].confidence, r.feature_flags[0].flag_name) == (4, f"{RUN}:0", 5, 80, "f") and not rejected.count()
    assert set(batches.FIELDS) == set(ingest.TARGETS) and len(batches.FIELDS) == 17


def test_conflicts_inside_a_micro_batch(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "store"))
    one, two = batch(1, sellers=[seller(1, "one")]), batch(1, sellers=[seller(1, "two")])
    ingest.apply_batch(store, requests(spark, one, two, one), 0)
    assert sorted(r.receipt for r in store.read("receipts").collect()) == ["conflict", "duplicate", "new"]
    assert [r.canonical_name for r in store.read("sellers").collect()] == ["one"]
    ingest.apply_batch(store, requests(spark, one), 1)
    assert [r.receipt for r in store.read("receipts").collect()] == ["duplicate"]
    ingest.apply_batch(store, requests(spark, batch(1, sellers=[seller(1, "one")], feature_flags=[{"flag_name": "f", "updated_at": "2024"}])), 2)
    assert [r.receipt for r in store.read("receipts").collect()] == ["conflict"] and store.read("feature_flags") is None


def test_targets_and_their_policies(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "store"))
    review = {"id": uid(5), "review_type": "t", "entity_id": "e", "payload_json": "{}", "reason": "r", "created_at": "2024"}
    score = {"id": uid(6), "seller_id": uid(1), "score_type": "s", "rule_code": "r", "points": 5, "explanation": "e", "observed_at": "2024", "parser_version": "p"}
    diff = {"id": uid(7), "entity_type": "t", "entity_id": "e", "last_observed_at": "1", "schema_version": 1, "updated_at": "1"}
    quota = {"quota_name": "q", "window_start": "w", "soft_limit": 1, "hard_limit": 2, "updated_at": "1"}
    ingest.apply_batch(store, requests(spark, batch(1, review_queue_items=[review | {"status": "approved"}], score_components=[score], recent_diff_metadata=[diff], quota_states=[quota]), batch(2, score_components=[score | {"points": 7}], quota_states=[quota | {"used": 3}])), 0)
    ingest.apply_batch(store, requests(spark, batch(3, review_queue_items=[review | {"status": "rejected", "reason": "new", "reviewed_by": "me"}], recent_diff_metadata=[diff | {"id": uid(8), "diff_count_30d": 4}])), 1)
    row = lambda name: store.read(name).collect()
    assert [(r.status, r.reason, r.reviewed_by) for r in row("review_queue_items")] == [("approved", "new", "me")]
    assert [r.points for r in row("score_components")] == [5] and [r.used for r in row("quota_states")] == [3]
    assert [(r.id, r.diff_count_30d) for r in row("recent_diff_metadata")] == [(uid(7), 4)]


def test_a_micro_batch_rewrites_only_its_buckets(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "store"), buckets=8)
    many = [batch(n, sellers=[seller(100 + 15 * n + i, f"s{n}") for i in range(15)]) for n in range(4)]
    ingest.apply_batch(store, requests(spark, *many), 0)
    assert store.read("sellers").count() == 60
    for version in range(1, 7):
        ingest.apply_batch(store, requests(spark, batch(10 + version, sellers=[seller(100, f"new {version}")])), version)
    folder = tmp_path / "store" / "sellers"
    assert len(list((folder / "v0").glob("__bucket=*"))) == 7 and all(len(list((folder / f"v{v}").glob("__bucket=*"))) <= 1 for v in range(1, 7))
    got = {r.id: r.canonical_name for r in store.read("sellers").collect()}
    assert len(got) == 60 and got[uid(100)] == "new 6" and got[uid(159)] == "s3"
    assert store.log("keys").count() == 10
    ingest.apply_batch(store, requests(spark, batch(16, sellers=[seller(100, "new 6")])), 6)  # again
    assert store.read("sellers").count() == 60 and store.log("keys").count() == 10


def test_new_sellers_are_resolved(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "store"), buckets=4)
    known = seller(1, "acme tools", official_domain="acme.com", country_code="CN", city="sz")
    ingest.apply_batch(store, requests(spark, batch(1, sellers=[known])), 0, resolve=True)
    same, other = seller(2, "acme tools", official_domain="acme.com", country_code="CN", city="sz"), seller(3, "acme tools", country_code="US")
    ingest.apply_batch(store, requests(spark, batch(2, sellers=[same, other], contacts=[contact(8, seller_id=uid(2)), contact(9, seller_id=uid(3))])), 1, resolve=True)
    assert {(r.id, r.status) for r in store.read("sellers").collect()} == {(uid(1), None), (uid(2), "merged"), (uid(3), None)}
    assert {(r.id, r.seller_id) for r in store.read("contacts").collect()} == {(uid(8), uid(1)), (uid(9), uid(3))}
    assert {(r.source_id, r.target_id, r.action) for r in store.log("decisions").collect()} == {(uid(2), uid(1), "auto_merge"), (uid(3), uid(1), "no_merge")}


def test_merges_at_ingest_by_contacts_can_be_rolled_back(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "store"), buckets=4)
    shared_ = [contact(20 + i, seller_id=uid(1), normalized_hash=f"h{i}") for i in range(3)]
    ingest.apply_batch(store, requests(spark, batch(1, sellers=[seller(1, "acme tools", country_code="CN")], contacts=shared_)), 0, resolve=True)
    again = [contact(30 + i, seller_id=uid(2), normalized_hash=f"h{i}") for i in range(3)]
    ingest.apply_batch(store, requests(spark, batch(2, sellers=[seller(2, "acme tools", country_code="CN"), seller(3, "acme tools", country_code="CN")], contacts=[*again, contact(40, seller_id=uid(3), normalized_hash="other")])), 1, resolve=True)
    made = {r.source_id: (r.target_id, r.score, r.action) for r in store.log("decisions").collect()}
    assert made == {uid(2): (uid(1), 91, "review_queue"), uid(3): (uid(1), 46, "no_merge")}  # 40 + 45 + 6, without a domain no more
    same = seller(4, "acme tools", country_code="CN", city="sz")
    ingest.apply_batch(store, requests(spark, batch(3, sellers=[seller(1, "acme tools", country_code="CN", city="sz")])), 2, resolve=True)
    ingest.apply_batch(store, requests(spark, batch(4, sellers=[same], contacts=[contact(50 + i, seller_id=uid(4), normalized_hash=f"h{i}") for i in range(3)])), 3, resolve=True)
    merged = {r.source_id: r.target_id for r in store.log("redirects").collect()}
    assert merged == {uid(4): uid(1)}
    links = store.log("merge_links")
    assert sorted(r.row_id for r in links.collect()) == [uid(50), uid(51), uid(52)]
    contacts = store.read("contacts")
    assert {r.seller_id for r in contacts.filter(F.col("id").isin(uid(50), uid(51))).collect()} == {uid(1)}
    back = X.rollback(contacts, links, "contacts")
    assert {r.id: r.seller_id for r in back.collect()}[uid(50)] == uid(4) and back.count() == contacts.count()


def test_signed_requests(spark, tmp_path):
    import hashlib
    import hmac

    secret = b"s"
    body = json.dumps(batch(1, sellers=[seller(1)]))
    sign = lambda at, nonce, text: hmac.new(secret, f"{at}.{nonce}.{hashlib.sha256(text.encode()).hexdigest()}".encode(), "sha256").hexdigest()
    now, late = "2024-01-01T00:00:00Z", "2024-01-01T00:10:00Z"
    rows = [(now, "a", sign(now, "a", body), body), (now, "a", sign(now, "a", body), body), (now, "b", sign(now, "c", body), body), (late, "d", sign(late, "d", body), body), (now, None, "x", body)]
    df = spark.createDataFrame([(*r, datetime(2024, 1, 1, 0, 0, i)) for i, r in enumerate(rows)], "timestamp string, nonce string, signature string, body string, arrived timestamp")
    store = ingest.Store(spark, str(tmp_path / "store"))
    ingest.apply_batch(store, df, 0, secret)
    assert sorted(r.refused for r in store.read("refused").collect()) == ["expired_timestamp", "invalid_signature", "missing_ingestion_header", "replayed_nonce"]
    assert [r.receipt for r in store.read("receipts").collect()] == ["new"] and [r.nonce for r in store.log("nonces").collect()] == ["a"]
    ingest.apply_batch(store, df.limit(1), 1, secret)
    assert [r.refused for r in store.read("refused").collect()] == ["replayed_nonce"] and store.read("receipts").count() == 0


def test_streaming_ingest_is_idempotent(spark, one_task, tmp_path):
    src, dst, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()

    def send(name, *docs):
        (tmp_path / "in" / name).write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs))
        q = ingest.ingest(spark, src, dst, cp)
        q.awaitTermination(120)
        assert q.exception() is None

    first = batch(1, sellers=[seller(1, "one"), seller(2, "two")])
    send("1.json", first, "{broken", batch(2, contacts=[contact(1, confidence=500)]), batch(3, run="bad"))
    send("2.json", first, batch(5, sellers=[seller(1, "renamed", "2025")]))
    send("3.json", batch(1, sellers=[seller(1, "conflicting", "1999")]))
    store = ingest.Store(spark, dst)
    assert {(r.id, r.canonical_name, r.first_seen_at) for r in store.read("sellers").collect()} == {(uid(1), "renamed", "2024"), (uid(2), "two", "2024")}
    assert [r.receipt for r in store.read("receipts").collect()] == ["conflict"]
    assert {r.receipt for r in spark.read.parquet(f"{dst}/receipts/v1").collect()} == {"new", "duplicate"}
    assert spark.read.parquet(f"{dst}/rejects/v0").count() == 3
    ingest.apply_batch(store, batches.read(spark, f"{src}/2.json"), 1)  # run again after a failure
    assert {r.receipt for r in spark.read.parquet(f"{dst}/receipts/v1").collect()} == {"new", "duplicate"}


def test_signed_stream_survives_restarts(spark, one_task, tmp_path):
    """Nonces and keys are state of the stream: three runs on one checkpoint, without any log of them."""
    import hashlib
    import hmac
    import time

    secret, source, target, cp = b"s", tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()
    src = {"schema_version": 1, "parser_version": "p", "source_url": "https://ok.example/a", "canonical_url": "https://ok.example/a", "source_domain": "ok.example", "source_type": "web", "first_seen_at": "2024"}

    def line(nonce, doc, key=secret, at=None):
        body = doc if isinstance(doc, str) else json.dumps(doc)
        at = at or datetime.fromtimestamp(time.time()).astimezone().isoformat(timespec="seconds")
        sign = hmac.new(key, f"{at}.{nonce}.{hashlib.sha256(body.encode()).hexdigest()}".encode(), "sha256").hexdigest()
        return json.dumps({"timestamp": at, "nonce": nonce, "signature": sign, "body": body})

    def send(name, *lines, **more):
        (source / name).write_text("\n".join(lines))
        q = ingest.ingest(spark, str(source), target, cp, secret=secret, resolve=True, allowed=["ok.example"], **more)
        q.awaitTermination(120)
        assert q.exception() is None
        store = ingest.Store(spark, target)
        return {r.nonce: r.refused for r in store.read("refused").collect()}, sorted(r.receipt for r in store.read("receipts").collect()), store

    one = batch(1, sellers=[seller(1, "acme tools", official_domain="acme.com", country_code="CN", city="sz")])
    bad_host = batch(9, sources=[src | {"id": uid(90), "source_url": "http://localhost/x", "source_domain": "other.example"}])
    refused, receipts, store = send("1.json", line("a", one), line("a", one), line("b", one, b"forged"), line("c", "{broken"), line("d", bad_host), line("e", one, at="2001-01-01T00:00:00Z"))
    assert refused == {"a": "replayed_nonce", "b": "invalid_signature", "e": "expired_timestamp"} and receipts == ["new"]
    assert {len(r.errors) for r in store.read("rejects").collect()} == {1, 3}
    # another run: the nonce of a refused body is used up, its key is not; the key of the first run is known
    refused, receipts, store = send("2.json", line("c", batch(2, sellers=[seller(3, "other")])), line("f", one), line("g", batch(1, sellers=[seller(1, "renamed")])), line("h", batch(2, sellers=[seller(2, "acme tools", official_domain="acme.com", country_code="CN", city="sz")], contacts=[contact(8, seller_id=uid(2))])))
    assert refused == {"c": "replayed_nonce"} and receipts == ["conflict", "duplicate", "new"]
    assert {(r.id, r.status) for r in store.read("sellers").collect()} == {(uid(1), None), (uid(2), "merged")} and [r.seller_id for r in store.read("contacts").collect()] == [uid(1)]
    assert store.log("nonces") is None
    refused, receipts, _ = send("3.json", line("h", one), line("i", one))
    assert refused == {"h": "replayed_nonce"} and receipts == ["duplicate"]


def test_state_expires(spark, one_task, tmp_path):
    """A key is known as long as its time to live, and no longer."""
    import time

    for ttl, want in ((86400, "duplicate"), (1, "new")):
        source, target, cp = tmp_path / f"in{ttl}", str(tmp_path / f"out{ttl}"), str(tmp_path / f"cp{ttl}")
        source.mkdir()
        for name, receipt in (("1.json", "new"), ("2.json", want)):
            (source / name).write_text(json.dumps(batch(1, sellers=[seller(1)])))
            q = ingest.ingest(spark, str(source), target, cp, key_ttl=ttl)
            q.awaitTermination(300)
            assert q.exception() is None and [r.receipt for r in ingest.Store(spark, target).read("receipts").collect()] == [receipt]
            time.sleep(2)


def test_nonces_and_days_stream(spark, tmp_path):
    at = lambda d, m: datetime(2024, 1, d, 0, m)
    rows = [("n1", at(1, 0), "view"), ("n1", at(1, 1), "view"), ("n2", at(1, 2), "error"), ("n3", at(9, 0), "view")]
    spark.createDataFrame(rows, "nonce string, at timestamp, state string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("nonce string, at timestamp, state string").parquet(str(tmp_path / "in"))
    for name, df in (("nonces", ingest.first_nonces(stream(), "nonce", "at")), ("days", ingest.daily(stream(), "at"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert sorted(r.nonce for r in spark.table("nonces").collect()) == ["n1", "n2", "n3"]
    assert [(r.n, r.errors) for r in spark.table("days").collect()] == [(3, 1)]


def test_spool_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    batches.write_spool(rows, str(tmp_path / "spool"))
    bad = spark.createDataFrame([("f", "aGk=", "0" * 64, 1)], batches.SPOOL)
    bad.write.mode("append").json(str(tmp_path / "spool"))
    assert sorted(r.ok for r in batches.read_spool(spark, str(tmp_path / "spool")).collect()) == [False, True, True]
    spool = batches.read_spool(spark, str(tmp_path / "spool"))
    done = spool.filter("ok").limit(1).select("body_sha256", F.lit("duplicate").alias("receipt"))
    send, taken, broken = batches.replay(spool, spark.createDataFrame(done.collect(), done.schema))
    assert (send.count(), taken.count(), broken.count()) == (1, 1, 1) and send.first().attempts == 1 and send.first().body.startswith('{"x":')
    man = export.snapshot({"t": rows}, str(tmp_path / "snap"))
    kept = spark.createDataFrame(man.collect(), man.schema)
    assert export.restore(spark, str(tmp_path / "snap"), kept, ["t"])["t"].count() == 2
    rows.limit(1).write.mode("append").parquet(str(tmp_path / "snap/t"))
    with pytest.raises(ValueError):
        export.restore(spark, str(tmp_path / "snap"), kept, ["t"])
    doc = export.csv_document(spark.createDataFrame([('=HYPERLINK("bad")', None)], "a string, b string"), ["a", "b"])
    assert doc == '﻿"a","b"\r\n"\'=HYPERLINK(""bad"")",""\r\n'


def test_a_filter_does_not_compute_columns_anew(spark):
    """Each body is read as JSON once, also where only accepted bodies are asked for."""
    requests = spark.createDataFrame([("{}",)], "body string")
    accepted, rejected = batches.validated(requests)
    for rows in (accepted, rejected):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("parse_json") == 1 or plan.count("parseJson") == 1
    assert rejected.count() == 1 and accepted.count() == 0


def test_scores_are_computed_once(spark):
    """A filter on the score doesn't compare names again for each threshold, and name_dice is bigram_dice."""
    rows = [(i, f"blue bolt {i % 5}", "d", "US", "x") for i in range(20)]
    known = spark.createDataFrame(rows, "id long, name string, domain string, country string, city string")
    scored = X.score(X.candidates(known, known), known, known).filter(X.action(F.col("score")) == "review_queue")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bigram") + plan.count("name_dice") + plan.count("array_intersect") <= 2
    pairs = spark.createDataFrame([("night", "nacht"), ("a", "b"), ("", "ab"), ("aaaa", "aab"), ("a  b", "a b"), ("é\u00a0x", "éx"), ("", "")], "a string, b string")
    assert all(r.x == r.y for r in pairs.select(T.bigram_dice(F.col("a"), F.col("b")).alias("x"), T.name_dice("a", "b").alias("y")).collect())


def test_contacts_and_plans_compute_each_part_once(spark):
    pages = spark.createDataFrame([(i, "https://a.com/contact", "<p>Email: x@a.com</p>") for i in range(130)], "page_id long, url string, html string")
    plan = E.contacts(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("wechat_business_label") == 1  # the rules, for all that mentions the confidence
    assert E.contacts(pages).count() == 130
    crawl = E.crawl_plan(pages)._jdf.queryExecution().executedPlan().toString()
    assert crawl.count("Exchange hashpartitioning") <= 1 and crawl.count("canonical_url") <= 2


def test_pages_are_parsed_some_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    seen = []
    monkeypatch.setattr(E, "page_document", lambda x: (seen.append(x), (x or "", []))[1])
    got = E.parse_html.func(pa.array([None, *map(str, range(E.PAGES_AT_ONCE * 2))]))
    assert len(seen) == len(got) == 2 * E.PAGES_AT_ONCE + 1 and len(E.parse_html.func(pa.array([], pa.string()))) == 0
