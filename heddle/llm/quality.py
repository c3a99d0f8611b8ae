"""Quality rules (operator 10): risk-controlled thresholds, native Spark expressions only.

Every document gets base counts and four ratios. For each stratum and rule the cutoff is
chosen on labelled documents: cutoffs are tried from the most lenient on, and each is
accepted while an exact binomial test shows that at most ``alpha`` of the good documents
are rejected by it. Within a rule and stratum this is fixed-sequence testing (the first
failure ends it), across rules and strata the level is divided by their number
(Bonferroni), so with probability 1 - ``delta`` no chosen cutoff exceeds ``alpha``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.shared import SPACES, WORD

SYMBOLS = "#*$%&|<>"
#: Rule name -> cutoffs from the most lenient to the strictest; a value above the cutoff rejects.
RULES = {
    "symbol_ratio": (0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "upper_ratio": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeat_ratio": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2),
}
#: Most strata whose cutoffs are broadcast; beyond that they are joined by shuffling.
BROADCAST_STRATA = 4096


def _repeated(words: Column) -> Column:
    """Words inside 5-word windows that the array holds twice or more."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        at = lambda i, k: F.get(h, i + F.lit(k))
        return F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2), at(i, 3), at(i, 4)))

    def covered(win: Column) -> Column:
        order = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twin(s: Column) -> Column:
            same = lambda i, x: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
            found = F.transform(s, lambda x, i: F.when(same(i - 1, x) | same(i + 1, x), x["i"]))
            return F.array_sort(F.filter(found, lambda p: p.isNotNull()))

        def union(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)

        return _let(_let(order, twin), union)

    def some(win: Column) -> Column:
        return F.when(F.size(F.array_distinct(win)) < F.size(win), covered(win)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(_let(_let(hashed, windows), some))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the four ratios.

    A null text has no words; its counts are zero and it fails the base rules. Columns of
    these names in docs are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD))
    docs = docs.withColumn("__words", words).withColumn("__lines", lines)
    long = lambda c: c.cast("long")
    docs = docs.withColumns(
        {
            "n_words": long(F.size("__words")),
            "word_chars": long(F.char_length(F.translate(t, SPACES, ""))),
            "n_symbols": long(F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))),
            "n_dup_lines": long(F.size("__lines") - F.size(F.array_distinct("__lines"))),
            "n_repeat_words": _repeated(F.col("__words")),
            "__n_lines": F.size("__lines"),
            "__n_upper": F.char_length(t) - F.char_length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
        }
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return docs.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "symbol_ratio": ratio("n_symbols", "word_chars"),
            "upper_ratio": ratio("__n_upper", "word_chars"),
            "dup_line_ratio": ratio("n_dup_lines", "__n_lines"),
            "repeat_ratio": ratio("n_repeat_words", "n_words"),
        }
    ).drop("__words", "__lines", "__n_lines", "__n_upper")


def _stirling_rest(x: Column) -> Column:
    """log x! less Stirling's formula, for whole x > 0."""
    y = 1 / (x * x)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - y / 1188) * y) * y) * y) / x
    small = F.least(x, F.lit(20)).cast("int")
    return F.when(x > 20, series).otherwise(F.log(F.factorial(small).cast("double")) - (x + 0.5) * F.log(x) + x - F.lit(0.5 * math.log(2 * math.pi)))


def _deviance(x: Column, mean: Column) -> Column:
    """x log(x / mean) + mean - x without cancellation where x is near mean."""
    v = (x - mean) / (x + mean)
    tail = F.lit(0.0)
    for j in range(10, 0, -1):
        tail = (tail + 1 / (2 * j + 1)) * v * v
    return F.when(F.abs(v) < 0.1, (x - mean) * v + 2 * x * v * tail).otherwise(x * F.log(x / mean) + mean - x)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact to ten digits at every n, for k up to about the mean.

    The largest term, that of k, is taken by its logarithm (saddle point form); the others
    follow from it downwards by their ratios, which fall. Nine standard deviations below k
    they are less than 1e-17 of the sum, so no more are taken.
    """
    x, m = k.cast("double"), n.cast("double")
    log = _stirling_rest(m) - _stirling_rest(x) - _stirling_rest(m - x) - _deviance(x, m * p) - _deviance(m - x, m * (1 - p)) + 0.5 * F.log(m / (x * (m - x) * (2 * math.pi)))
    odds = (1 - p) / p
    terms = F.least(k, F.ceil(9 * F.sqrt(m * p) + 40 + F.greatest(F.lit(0.0), x - m * p))).cast("long")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (x - i) / (m - x + i + 1) * odds
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(0).cast("long"), terms - 1), start, step, lambda a: a["total"])
    return F.when(k >= n, F.lit(1.0)).when(k < 0, F.lit(0.0)).when(k == 0, F.exp(m * math.log1p(-p))).otherwise(F.exp(log) * total)


def thresholds(labelled: DataFrame, stratum: str, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """(stratum, cuts map<rule, cutoff>) from labelled good documents' features.

    labelled: one row for each good document, with the ratios and the stratum. Strata or
    rules without a certified cutoff have none in the map. One aggregation to a row for
    each stratum; all else works on those.
    """
    counts = [F.count_if(F.col(rule) > cut).alias(f"{rule}_{i}") for rule, cuts in RULES.items() for i, cut in enumerate(cuts)]
    by = labelled.groupBy(F.col(stratum).alias("__stratum")).agg(F.count("*").alias("n"), *counts)
    by = by.join(F.broadcast(by.agg(F.count("*").alias("n_strata"))))  # one row
    tries = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(cut).alias("cut"), F.col(f"{rule}_{i}").alias("k")) for rule, cuts in RULES.items() for i, cut in enumerate(cuts)])
    rows = by.select("__stratum", "n", "n_strata", F.explode(tries).alias("t")).select("__stratum", "n", "n_strata", "t.*")
    # from the mean on the probability is about a half or more and certifies nothing
    p = binomial_cdf(F.least("k", F.ceil(F.col("n") * alpha)), F.col("n"), alpha)
    rows = rows.withColumn("ok", p <= F.lit(delta) / (F.lit(float(len(RULES))) * F.col("n_strata")))
    # fixed sequence: the last cutoff before the first failure
    per = rows.groupBy("__stratum", "n", "rule").agg(F.min(F.when(~F.col("ok"), F.col("i"))).alias("bad"), F.collect_list(F.struct("i", "cut")).alias("cuts"))
    best = F.array_max(F.filter("cuts", lambda x: F.col("bad").isNull() | (x["i"] < F.col("bad"))))["cut"]
    return per.groupBy("__stratum", "n").agg(F.map_from_entries(F.collect_list(F.struct("rule", best.alias("cut")))).alias("cuts"))


def judge(features_df: DataFrame, cuts: DataFrame, stratum: str, n_strata: int) -> DataFrame:
    """features_df with kept: not base_failed, and no ratio above its stratum's certified cutoff."""
    side = F.broadcast(cuts) if n_strata <= BROADCAST_STRATA else cuts
    joined = features_df.join(side.select("__stratum", F.col("cuts").alias("__cuts")), F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    over = F.lit(False)
    for rule in RULES:
        over = over | F.coalesce(F.col(rule) > F.col("__cuts")[rule], F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("__cuts", "__stratum")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """docs with counts, ratios, base_failed and kept.

    docs should be stored: they are read twice. labels: doc_id, quality; good is quality = 1.
    Rows of labels with nulls and unlabelled documents set no cutoff; without any labels
    only the base rules reject. A null stratum is a stratum. Repeated rows count as often
    as they occur and are judged alike.
    """
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("__good")).filter(F.col("__good").isNotNull()).distinct()
    labelled = docs.join(good, docs["doc_id"] == F.col("__good"), "left_semi")
    cuts = thresholds(labelled, stratum, alpha, delta)
    rows = [tuple(r) for r in cuts.limit(BROADCAST_STRATA + 1).collect()]
    if len(rows) <= BROADCAST_STRATA:
        cuts = docs.sparkSession.createDataFrame(rows, cuts.schema)
    return judge(docs, cuts, stratum, len(rows))
