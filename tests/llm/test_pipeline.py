"""The pipeline on a small corpus against brute force, stage by stage."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from heddle.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH = " ".join(f"bench{i}" for i in range(30))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(2)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    rows = []
    add = lambda t, s="a": rows.append((len(rows), t, "en", s, len(t or "")))
    for i in range(120):
        add(fresh(rng.randrange(40, 200)), rng.choice("ab"))
    add(None), add(""), add("too short"), add("again " * 60)  # rejected: 120..123
    base = max((r[1] for r in rows[:120]), key=len)  # long enough for one edit to leave a similarity of 0.8
    add(base), add(base)  # exact copies: 124, 125
    w = base.split()
    w[7] = "edited"
    add(" ".join(w))  # a near copy: 126
    passage = fresh(40)
    add(fresh(60) + " " + passage + " " + fresh(60)), add(fresh(50) + " " + passage + " " + fresh(90))  # 127 keeps it, 128 loses it
    add(fresh(30) + " " + BENCH + " " + fresh(40)), add(fresh(3000) + " " + BENCH)  # contaminated 129; 130 has too little of it
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows


def test_stages(spark, sf_dir):
    path, rows = sf_dir
    texts = {r[0]: r[1] for r in rows}
    docs = P.table(spark, path, "documents")
    names = [n for n, _ in P.STAGES]
    kept = []
    for _, stage in P.STAGES[:-1]:
        before = docs
        docs = P.stored(stage(spark, docs, path), "test")
        assert docs.columns == before.columns
        kept.append({r.doc_id: r for r in docs.collect()})
    clean = set(texts) - {120, 121, 122, 123}
    assert set(kept[0]) == clean
    assert set(kept[1]) == clean - {124, 125, 126}
    assert set(kept[2]) == set(kept[1])
    first, second = kept[2][127].text, kept[2][128].text
    assert first == texts[127] and len(second) < len(texts[128]) - 200 and kept[2][128].n_chars == len(second)
    whole = [i for i in kept[2] if kept[2][i].text == texts[i]]
    assert set(kept[2]) - set(whole) == {128, 130}  # 130 loses its benchmark passage to 129, which has it first
    assert set(kept[3]) == set(kept[2]) - {129}
    mixed = P.stored(P.STAGES[-1][1](spark, docs, path), "test").collect()
    tokens = {i: len(WORD.findall(kept[3][i].text)) for i in kept[3]}
    assert {r.doc_id for r in mixed} <= set(kept[3]) and all(r.n_tokens == tokens[r.doc_id] for r in mixed)
    assert abs(sum(r.n_tokens for r in mixed) - sum(tokens.values())) < 2 * max(tokens.values())
    assert len(names) == 5


def test_stages_take_odd_rows(spark, sf_dir):
    """Nulls in every column, empty texts, repeated rows, a very long text, columns that clash with results, empty tables."""
    path, _ = sf_dir
    schema = P.table(spark, path, "documents").schema
    long_ = " ".join(f"v{i}" for i in range(300_000))
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "a b " * 40, None, "s", 160), (2, "a b " * 40, None, "s", 160), (3, long_, "en", "s", len(long_))]
    clash = ["kept", "n_words", "contaminated", "fp", "component_id", "n_bytes", "kept_sha256", "key", "block"]
    odd = spark.createDataFrame(rows, schema).withColumns({c: F.lit(f"own {c}") for c in clash})
    quality_, near, suffix, clean, mixed = (stage(spark, odd, path) for _, stage in P.STAGES)
    for out in (quality_, near, suffix, clean):
        assert out.columns == odd.columns
        assert {tuple(r) for r in out.select(*clash).collect()} == {tuple(f"own {c}" for c in clash)}
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    assert ids(quality_) == [3]  # the others have too few words or nothing but repeats
    assert ids(near) in ([1, 2, 3], [2, 3, None])  # one of those without words, one of the copies
    got = suffix.collect()
    assert len(got) == 6 and [r.text for r in got if r.doc_id is None] == [None] and all(r.text == long_ and r.n_chars == len(long_) for r in got if r.doc_id == 3)
    assert all(len(r.text) < 160 for r in got if r.doc_id == 2)  # each repeats itself
    assert ids(clean) == [1, 1, 2, 2, 3, None]
    assert sorted(set(ids(mixed))) == [2, 3]
    for _, stage in P.STAGES:
        assert stage(spark, odd.limit(0), path).count() == 0


def test_keeps_all_good_documents_without_labels(spark, sf_dir):
    path, _ = sf_dir
    docs = P.table(spark, path, "documents")
    none = P.table(spark, path, "labels").limit(0)
    assert quality.quality_rules(quality.features(docs), none).filter("kept").count() == docs.count() - 4


def test_run(spark, sf_dir):
    """run() gives the rows of its stages one after the other, and leaves one table behind."""
    path, _ = sf_dir
    folder = P.scratch_folder(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = P.run(spark, path)
    assert got.columns == ["doc_id", "source", "n_tokens", "epoch", "position"]
    assert set(os.listdir(folder)) - before == {os.path.basename(got.stored_at)}
    docs = P.table(spark, path, "documents")
    for _, stage in P.STAGES:
        docs = P.stored(stage(spark, docs, path), "test")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


def test_run_against_brute_force(spark, tmp_path):
    """Each decision from the whole texts in plain Python; budgets and their order by the mixing test's own rule."""
    rng = random.Random(8)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    passage = fresh(40)
    texts = [fresh(60) for _ in range(20)] + [fresh(30) + " " + passage + " " + fresh(9), passage + " " + fresh(90), fresh(30) + " " + BENCH, "few words", "same " * 50]
    texts += [texts[0], texts[1] + " tail", " ".join(texts[2].split()[1:])]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = {i: WORD.findall(t) for i, t in enumerate(texts)}
    windows = {i: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] for i, w in words.items()}
    docs = [i for i, w in words.items() if len(w) >= 10 and not any(windows[i].count(x) > 1 for x in windows[i])]
    kept = []
    for i in docs:
        sets = set(windows[i])
        if not any(len(sets & set(windows[j])) >= 0.8 * len(sets | set(windows[j])) for j in kept):
            kept.append(i)
    seen, left = set(), {}
    for i in kept:
        b = texts[i].encode()
        gone = set()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone.update(range(k, k + 100))
            seen.add(b[k : k + 100])
        left[i] = bytes(c for k, c in enumerate(b) if k not in gone).decode("utf-8", "ignore")
    bench = {tuple(BENCH.split()[k : k + 13]) for k in range(18)}
    clean = {}
    for i, t in left.items():
        w = re.findall(r"[a-z0-9]+", t.lower())
        hit = {k + j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in bench for j in range(13)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean[i] = len(WORD.findall(t))
    got = P.run(spark, str(tmp_path)).collect()
    assert clean.keys() < set(docs) and {r.doc_id: r.n_tokens for r in got} == clean  # two sources of like size: all is taken, of the smaller one some twice
    assert all(r.epoch in (0, 1) and 0 <= r.position < 1 for r in got)
