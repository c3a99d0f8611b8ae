"""Components, chains and set similarity against brute force."""

import random

import pytest

from heddle.operators import linking as L
from heddle.operators import resolution as X
from heddle.plans import catalogue


def classes(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in range(n)}


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 180)]
    rng.shuffle(chain)
    edges = chain + [(b, a) for a, b in chain[:20]] + [(0, i) for i in range(1, 40)] + [(50, 50)] + [(rng.randrange(40, 100), rng.randrange(40, 100)) for _ in range(30)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "u long, v long")
    want = classes(200, edges)
    linked = {i for a, b in edges if a != b for i in (a, b)}
    assert {r.id: r.component for r in L.components(df).collect()} == {i: want[i] for i in linked}
    assert L.components(df.limit(0)).count() == 0


def test_link_by_keys(spark):
    rows = [(1, "domain", "a.com"), (2, "domain", "a.com"), (2, "phone", "p1"), (3, "phone", "p1"), (4, "phone", None), (5, "reg", "R5")]
    rows += [(10, "reg", "R1"), (11, "reg", "R1"), (12, "reg", "R2"), (13, "phone", "p9"), (10, "phone", "p9"), (12, "phone", "p9")]  # R1 and R2 meet over a phone
    rows += [(20, "reg", "R1x"), (20, "domain", "d"), (21, "domain", "d"), (1, "domain", "a.com")]
    df = spark.createDataFrame(rows, "id long, kind string, value string")
    got = {r.id: (r.entity, r.conflict) for r in L.link_by_keys(df, ["reg"]).collect()}
    assert got == {1: (1, False), 2: (1, False), 3: (1, False), 4: (4, False), 5: (5, False), 10: (10, True), 11: (10, True), 12: (12, True), 13: (13, True), 20: (20, False), 21: (20, False)}
    assert {r.entity for r in L.link_by_keys(df, []).filter("id in (10, 11, 12, 13)").collect()} == {10}


def test_last_targets(spark):
    rows = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (103, 101), (104, 103), (200, 200), (300, 5)]
    got = {r.source_id: (r.last_id, r.hops, r.cycle) for r in L.last_targets(spark.createDataFrame(rows, "source_id long, target_id long")).collect()}
    assert all(got[i] == (60, 60 - i, False) for i in range(1, 60)) and got[300] == (60, 56, False)
    assert {i: got[i] for i in (100, 101, 102, 103, 104, 200)} == {100: (100, None, True), 101: (100, None, True), 102: (100, None, True), 103: (100, None, True), 104: (100, None, True), 200: (200, None, True)}
    assert L.last_targets(spark.createDataFrame([], "source_id long, target_id long")).count() == 0


def test_chains_move_rows_and_roll_back(spark):
    decisions = spark.createDataFrame([(1, 10, 20, 1), (2, 20, 30, 2), (3, 10, 25, 0)], "id long, source_id long, target_id long, created_at int")
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 99), (5, None)], "id long, seller_id long")
    seen = lambda df: {r.id: r.seller_id for r in df.collect()}
    assert seen(X.repoint(rows, decisions)) == {1: 20, 2: 30, 3: 30, 4: 99, 5: None}  # one step, the later merge of 10 holds, no row twice
    assert seen(X.repoint(rows, decisions, follow=True)) == {1: 30, 2: 30, 3: 30, 4: 99, 5: None}
    # a rollback in the middle of the chain: 20 is itself again, and so is what came from 10
    links = X.merge_links({"rows": rows}, decisions.filter("id = 1"))
    first = X.repoint(rows, decisions.filter("id = 1"))
    more = X.merge_links({"rows": first}, decisions.filter("id = 2"))
    second = X.repoint(first, decisions.filter("id = 2"))
    assert seen(second) == {1: 30, 2: 30, 3: 30, 4: 99, 5: None}
    back = X.rollback(second, more.union(more), "rows")  # links told twice move a row once
    assert seen(back) == {1: 20, 2: 20, 3: 30, 4: 99, 5: None}
    assert seen(X.rollback(back, links, "rows")) == {1: 10, 2: 20, 3: 30, 4: 99, 5: None}


def test_merge_links_sort_no_rows(spark):
    decisions = spark.createDataFrame([(1, 10, 20), (2, 20, 30), (3, 10, 25)], "id long, source_id long, target_id long")
    tables = {"a": [(1, 10), (2, 30), (3, None)], "b": [(1, 20), (4, 10)], "none": []}
    links = X.merge_links({name: spark.createDataFrame(rows, "id long, seller_id long") for name, rows in tables.items()}, decisions)
    assert links.columns == ["decision_id", "table_name", "row_id", "source_id", "target_id"]
    assert sorted(map(tuple, links.collect())) == [(1, "a", 1, 10, 20), (1, "b", 4, 10, 20), (2, "b", 1, 20, 30), (3, "a", 1, 10, 25), (3, "b", 4, 10, 25)]
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables
    try:
        plan = catalogue.er_merge_links(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert "Sort" not in plan and plan.count("ShuffledHashJoin") == 2  # lines with their orders, all rows with the merges


@pytest.mark.parametrize("block", [3, 2048])
def test_similar_sets(spark, block):
    rng = random.Random(block)
    words = [f"t{i}" for i in range(14)]
    rows = [(i, [rng.choice(words[: 4 + i % 11]) for _ in range(rng.randrange(9))]) for i in range(160)] + [(900, None), (901, []), (902, [None]), (903, ["t1", None, "t1"]), (904, ["t1"])]
    rows += [(1000 + i, ["hot", f"h{i % 7}", "x"]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    pairs, members = L.similar_sets(df, block=block)
    sets = {}
    for i, t in rows:
        s = frozenset(x for x in t or [] if x)
        if s:
            sets.setdefault(s, []).append(i)
    assert {r.id: r.set_id for r in members.collect()} == {i: min(own) for own in sets.values() for i in own}
    names = sorted((min(own), s) for s, own in sets.items())
    want = {(i, j, len(a), len(b), len(a & b)) for i, a in names for j, b in names if i < j and 5 * len(a & b) >= 3 * len(a | b)}
    got = [tuple(r) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want) > 50


@pytest.mark.parametrize("block", [3, 2048])
def test_similar_sets_below_and_above_small(spark, block):
    """Sets of up to SMALL tokens and larger ones, with each other too."""
    rng = random.Random(block)
    words = [f"t{i}" for i in range(34)]
    base = [rng.sample(words, rng.randrange(9, 30)) for _ in range(12)]
    rows = [(i, [t for t in rng.choice(base) if rng.random() < 0.85]) for i in range(220)]
    names = {}
    for i, t in rows:
        names.setdefault(frozenset(t), i)
    known = sorted((i, s) for s, i in names.items())
    want = {(i, j, len(a), len(b), len(a & b)) for i, a in known for j, b in known if i < j and 5 * len(a & b) >= 3 * len(a | b)}
    got = [tuple(r) for r in L.similar_sets(spark.createDataFrame(rows, "id long, tokens array<string>"), block=block)[0].collect()]
    assert set(got) == want and len(got) == len(want)
    assert len({(n > L.SMALL, m > L.SMALL) for _, _, n, m, _ in want}) == 4


def test_what_meets_is_mostly_similar():
    """All sets of five of 14 tokens: few pairs meet that aren't similar. On one token of a prefix, 31 times as many as are similar meet."""
    from itertools import combinations

    met, similar = {}, set()
    places = [p for n, m, _, p in L._places(3, 5) if n == m == 5]
    for s in combinations(range(14), 5):
        for p in places:
            met.setdefault(tuple(s[i] for i in p), []).append(s)
    for own in met.values():
        similar |= set(combinations(own, 2))
    assert all(5 * len({*a} & {*b}) >= 3 * len({*a} | {*b}) for a, b in similar)
    assert len(similar) == 2002 * 5 * 9 // 2 == sum(len(own) * (len(own) - 1) // 2 for own in met.values())


def test_similar_sets_settle_pairs_where_they_meet(spark):
    """Candidates, quadratic in a hot token's sets, are neither stored nor shuffled: nothing but a projection stands above the join of the blocks."""
    df = spark.createDataFrame([(i, [f"t{i % 5}", f"t{i % 7}", f"u{i % 3}"]) for i in range(60)], "id long, tokens array<string>")
    plan = L.similar_sets(df)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("RepartitionByExpression")[0]


def test_numbering_plans(spark):
    from pyspark.sql import functions as F

    from heddle.operators import extraction as E

    cases = [
        ("+1 (415) 555-2671", None, "+14155552671"), ("1-415-555-2671", "US", "+14155552671"), ("(415) 555-2671", "US", "+14155552671"), ("011 44 20 7946 0958", "US", "+442079460958"), ("555-2671", "US", None),
        ("+44 (0)20 7946 0958", None, "+442079460958"), ("020 7946 0958", "GB", "+442079460958"), ("0044 20 7946 0958", "DE", "+442079460958"), ("06 698 81", "IT", "+390669881"), ("8 (495) 123-45-67", "RU", "+74951234567"),
        ("+852 2123 4567", None, "+85221234567"), ("+85 221", None, None), ("+999 1234567", None, None), ("030 12345", "DE", "+493012345"), ("12345", "XX", None), (None, "US", None), ("", "US", None), ("12+34", "US", None), ("+8613800138000", "CN", "+8613800138000"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "raw string, region string")
    got = [r.x for r in df.select(E.planned_phone(F.col("raw"), F.col("region")).alias("x")).collect()]
    assert got == [c[2] for c in cases]
    assert set(E.REGIONS.values()) <= set(E.NUMBERING)


def test_best_ratio_filters_and_verifies(spark):
    """Bounds leave few pairs of names, and none that matters is lost."""
    from difflib import SequenceMatcher

    from pyspark.sql import functions as F

    from heddle.functions import text as T

    rng = random.Random(2)
    make = lambda: "".join(rng.choice("abcdef ") for _ in range(rng.randrange(0, 14)))
    base = [make() for _ in range(30)]
    near = lambda s: s[: rng.randrange(len(s) + 1)] + rng.choice("abz") + s[rng.randrange(len(s) + 1) :]
    rows = [(i, 1000 + i, [rng.choice(base), ""], [near(rng.choice(base)), rng.choice(base)]) for i in range(600)]
    df = spark.createDataFrame(rows, "candidate_id long, existing_id long, __x array<string>, __y array<string>")
    got = {r.candidate_id: r["__sim"] for r in X._best_ratio(df, 0.78).collect()}
    want = {i: max((SequenceMatcher(None, a, b).ratio() for a in x if a for b in y if b), default=0.0) for i, _, x, y in rows}
    assert len(got) == 600 and all(abs(got[i] - w) < 1e-12 if w >= 0.78 else got[i] <= w + 1e-12 for i, w in want.items()) and sum(w >= 0.78 for w in want.values()) > 20
    pairs = spark.createDataFrame([(a, b) for _, _, x, y in rows for a in x for b in y], "a string, b string").select("a", "b", T.similarity_bound(F.col("a"), F.col("b")).alias("m")).collect()
    assert all(p.m >= SequenceMatcher(None, p.a, p.b).ratio() - 1e-12 for p in pairs if p.a or p.b)
    assert sum(p.m >= 0.78 for p in pairs) < 0.5 * len(pairs)
