"""Operators 3, 7 and 10 against brute force."""

import re
from collections import Counter

from pyspark.sql import functions as F

from heddle.llm import chat, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")

TEXTS = [
    None,
    "",
    " \t\n",
    "a",
    "a b c d e f g h i j a b c d e f g h i j",
    "one two three four five six seven eight nine ten eleven",
    "x x x x x x x x",
    "l1 a\nl1 a\n\n \nl2\nl2\nl2",
    "#*$%&|<> é ü ok \x0b\x0c\r end #",
    "A B C\x1fD e\U0001f600f g h i j k l",
    " ".join(f"w{i % 40}" for i in range(3000)),
    " ".join(f"v{i}" for i in range(500)) + " a b c d e " + " ".join(f"u{i}" for i in range(100)) + " a b c d e f",
]


def counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), failed)


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int")


def test_counts(spark):
    got = {r[0]: tuple(r)[1:] for r in quality.features(docs_of(spark, TEXTS)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {i: counts(t) for i, t in enumerate(TEXTS)}


def test_binomial_cdf(spark):
    from math import comb

    cases = [(k, n, p) for n in (1, 7, 50, 400) for k in (0, 1, 3, 30, 400) for p in (0.01, 0.05)]
    for p in (0.01, 0.05):
        rows = [(k, n) for k, n, q in cases if q == p]
        df = spark.createDataFrame(rows, "k long, n long")
        for r in df.select("k", "n", quality.binomial_cdf(F.col("k"), F.col("n"), p).alias("c")).collect():
            true = sum(comb(r.n, j) * p**j * (1 - p) ** (r.n - j) for j in range(min(r.k, r.n) + 1))
            assert abs(r.c - true) < 1e-9


def exact_cdf(k, n, p):
    """Summed from the first term on, with 40 digits."""
    from decimal import Decimal, localcontext

    with localcontext() as c:
        c.prec = 40
        q = Decimal(p)
        term = total = (1 - q) ** n
        odds = q / (1 - q)
        for j in range(min(k, n)):
            term = term * (n - j) / (j + 1) * odds
            total += term
        return float(total)


def test_binomial_cdf_of_many(spark):
    rows = [(k, n) for n, ks in ((70_000, (0, 1, 19, 20, 21, 600, 650, 700)), (1_000_000, (5000, 9728, 9729, 10_000)), (100_000_000, (990_000, 998_000, 1_000_000))) for k in ks]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", quality.binomial_cdf(F.col("k"), F.col("n"), 0.01).alias("c")).collect()
    for r in got:
        true = exact_cdf(r.k, r.n, "0.01")
        assert abs(r.c - true) <= 1e-9 * true + 1e-300, (r, true)


def test_cutoffs_and_verdicts_against_brute_force(spark):
    """Every cutoff by its own binomial sum, every document by the cutoffs of its stratum; labels twice, with nulls, and columns that clash."""
    import random

    rng = random.Random(2)
    shape = lambda i: " ".join(rng.choice(["#$%", "ABC", "abc"]) if rng.random() < rng.choice([0.0, 0.0, 0.1, 0.7]) else f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(8, 40)))
    rows = [(i, shape(i), ["en", "de", None][i % 3], 9.0, "x") for i in range(1500)]
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, symbol_ratio double, kept string")
    good = {i for i in range(1500) if i % 5 and rows[i][2] != "de" or i % 40 == 0}
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(1500)] + [(3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    good.add(3)
    alpha, delta = 0.1, 0.05
    found = quality.features(docs).drop("kept")
    of = [r.asDict() for r in found.collect()]
    strata = {r["lang"] for r in of if r["doc_id"] in good}
    cuts = {}
    for lang in strata:
        own = [r for r in of if r["lang"] == lang and r["doc_id"] in good]
        for rule, tries in quality.RULES.items():
            for cut in tries:
                if exact_cdf(sum(r[rule] > cut for r in own), len(own), str(alpha)) > delta / len(quality.RULES) / len(strata):
                    break
                cuts[lang, rule] = cut
    want = Counter((r["doc_id"], not r["base_failed"] and not any(r[rule] > cuts.get((r["lang"], rule), 9) for rule in quality.RULES)) for r in of)
    got = Counter((r.doc_id, r.kept) for r in quality.quality_rules(found, labels, alpha=alpha, delta=delta).collect())
    assert got == want
    assert 0 < sum(kept for _, kept in want) < len(want) and len(set(cuts.values())) > 2


def test_cutoffs_of_many_labels(spark):
    # 929 is the most that an exact test of four rules at 0.05 certifies
    docs = spark.range(100_000).select(F.lit("en").alias("lang"), *[F.when(F.col("id") < n, 1.0).otherwise(0.0).alias(rule) for rule, n in zip(quality.RULES, (900, 929, 930, 5000), strict=True)])
    cuts = quality.thresholds(docs, "lang").first().cuts
    assert cuts == {"symbol_ratio": 0.1, "upper_ratio": 0.4, "dup_line_ratio": None, "repeat_ratio": None}


def test_quality_keeps_good_and_drops_junk(spark):
    good = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(900)]
    junk = [" ".join(f"w{i}x{j}$$$" for j in range(60)) for i in range(40)]
    docs = docs_of(spark, good + junk)
    labels = spark.createDataFrame([(i, int(i < 900)) for i in range(940)] + [(None, 1), (5, None)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.quality_rules(quality.features(docs), labels).filter("kept").collect()}
    assert kept == set(range(900))
    none = quality.quality_rules(quality.features(docs), labels.limit(0))
    assert none.filter("kept").count() == 940  # no labels, no cutoffs
    assert quality.quality_rules(quality.features(docs.limit(0)), labels).count() == 0


def test_mix_spends_the_budgets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), ["big", "big", "big", "mid", None][i % 5] if i % 50 else "small") for i in range(1000)], "doc_id long, text string, source string")
    out = mixing.mix(docs, max_epochs=2.0).collect()
    tokens = Counter()
    for i in range(1000):
        tokens[["big", "big", "big", "mid", None][i % 5] if i % 50 else "small"] += 1 + i % 7
    taken = Counter()
    for r in out:
        taken[r.source] += r.n_tokens
    assert all(taken[s] <= 2.01 * tokens[s] + 7 for s in tokens) and taken["small"] > tokens["small"]
    assert abs(sum(taken.values()) - sum(tokens.values())) <= 8 * len(tokens)
    assert len({(r.doc_id, r.epoch) for r in out}) == len(out)
    assert mixing.mix(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, "a"), (2, "", None), (None, "x y", None)], "doc_id long, text string, source string")
    assert [(r.doc_id, r.n_tokens) for r in mixing.mix(odd).collect()] == [(None, 2)]


def test_exponent_for_entropy(spark):
    sources = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    a = mixing.find_exponent(sources, 1000, None, min_entropy=1.0)
    import math

    def entropy(x):
        p = [t**x for t in (900, 90, 10)]
        return -sum(q / sum(p) * math.log(q / sum(p)) for q in p)

    assert entropy(a) >= 1.0 > entropy(a + 2e-6)


def test_chat_collapse(spark):
    def brute(rows):
        convs = {}
        for c, t, r, x in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
            convs.setdefault(c, []).append((r or "", x or ""))
        whole = {}
        for c in sorted(convs):
            whole.setdefault(tuple(convs[c]), c)
        text = lambda k: "\n".join(f"<|{r}|>\n{x}\n<|end|>" for r, x in k)
        return {c: (len(k), text(k)) for k, c in whole.items() if not any(len(o) > len(k) and o[: len(k)] == k for o in whole)}

    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "yo"), (5, 0, "assistant", "hi"),
            (6, 0, None, None), (7, 0, None, None), (7, 1, "user", ""), (None, 0, "user", "hi"), (8, None, "user", "a"), (8, 1, "user", "b"), (9, 0, "user", "b"), (9, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("clash"))
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.chat_format(df).collect()}
    assert got == brute(rows)
    assert chat.chat_format(df.limit(0)).count() == 0
    text = chat.chat_format(df).filter("conv_id = 2").first()
    assert text.rendered == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>" and text.n_copies == 2


def test_mix_odd_rows(spark):
    """Repeated rows, columns that clash, and more epochs than there may be."""
    import pytest

    rows = [(1, "a b", "x", 9.0, 1)] * 3 + [(2, "c d e", "y", 9.0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, position double, epoch int")
    got = Counter(r.doc_id for r in mixing.mix(docs, max_epochs=1.0).collect())
    assert got == {1: 3, 2: 1}
    lopsided = spark.createDataFrame([(0, "w", "tiny")] + [(i, "w " * 20_000, "big") for i in range(1, 121)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="taken"):
        mixing.mix(lopsided, max_epochs=None, min_entropy=0.69)
