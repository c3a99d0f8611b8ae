"""The index that is kept: pruning by prefix, refresh by ranges; listings that read each relation once."""

import os
import re

from pyspark.sql import functions as F

from heddle.operators import search as S
from heddle.plans import catalogue, registry

DATA = "/root/testdata/sf0.001"


def documents(spark, rows):
    return spark.createDataFrame(rows, "id long, body string")


def stamps(path):
    return {(d, f): os.stat(os.path.join(path, d, f)).st_mtime_ns for d in os.listdir(path) if "=" in d for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")}


def test_refresh_rewrites_only_its_ranges(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(i, f"common word{i:03d} {chr(97 + i % 26)}x") for i in range(300)] + [(900, None), (901, "")]
    docs = documents(spark, rows)
    S.build(docs, "id", ["body"], path, ranges=12)
    want = lambda d: sorted(map(tuple, S.index(d, "id", ["body"]).collect()))
    got = lambda: sorted((r.id, r.token) for r in S.stored_index(spark, path).collect())
    assert got() == want(docs)
    assert len({r.range for r in S.stored_index(spark, path).filter("token = 'common'").collect()}) > 1  # a hot token has several ranges
    before = stamps(f"{path}/postings")
    after = documents(spark, [(i, t) if i != 7 else (7, "common word007 zz") for i, t in rows if i != 8])
    ranges, buckets = S.refresh_stored(spark, path, after, spark.createDataFrame([(7,), (8,), (5,), (None,)], "id long"), "id", ["body"])
    assert got() == want(after)
    kept = {k: v for k, v in stamps(f"{path}/postings").items() if before.get(k) == v}
    assert len({d for d, _ in before}) - len(ranges) == len({d for d, _ in kept}) > 0 and len(buckets) <= 4
    assert S.refresh_stored(spark, path, after, spark.createDataFrame([(5,)], "id long"), "id", ["body"])[0] == []
    S.refresh_stored(spark, path, documents(spark, [*rows, (1000, "aaa new zzzz")]), spark.createDataFrame([(7,), (8,), (1000,)], "id long"), "id", ["body"])
    assert got() == want(documents(spark, [*rows, (1000, "aaa new zzzz")]))
    S.build(docs.limit(0), "id", ["body"], str(tmp_path / "empty"))
    assert S.stored_index(spark, str(tmp_path / "empty")).count() == 0
    S.refresh_stored(spark, str(tmp_path / "empty"), docs, docs.select("id"), "id", ["body"])
    assert sorted((r.id, r.token) for r in S.stored_index(spark, str(tmp_path / "empty")).collect()) == want(docs)
    assert S.is_built(spark, str(tmp_path / "empty")) and not S.is_built(spark, str(tmp_path / "none"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_reads_the_stored_index(spark):
    found = registry.queries()["search_stored"](spark, DATA)
    plan = plan_of(found)
    assert "StringStartsWith" in plan and "lineitem" not in plan and "orders" not in plan
    assert catalogue.kept_index(spark, DATA) == catalogue.kept_index(spark, DATA)


def test_listings_read_each_relation_once(spark):
    plan = plan_of(registry.queries()["sellers_listing"](spark, DATA))
    scans = re.findall(r"Location: InMemoryFileIndex.*?/(\w+)\.parquet", plan.split("== Initial Plan ==")[0])
    assert scans and max(scans.count(s) for s in ("customer", "events")) == 1 and "lineitem" not in scans


def test_prefix_prunes_files(spark, tmp_path):
    path = str(tmp_path / "index")
    S.build(documents(spark, [(i, f"w{i:05d}") for i in range(5000)]), "id", ["body"], path, ranges=8)
    hits = S.match(S.stored_index(spark, path), "id", "w0001")
    assert sorted(r.id for r in hits.collect()) == list(range(10, 20))
    folders = {os.path.basename(os.path.dirname(r.f)) for r in spark.read.parquet(f"{path}/postings").filter(F.startswith("token", F.lit("w0001"))).select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(folders) == 1
