import random
import re
from collections import Counter, defaultdict

import pytest

from heddle.llm import divergence


def brute(rows, least, ranks):
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang, source].update(w)
        df[lang].update(set(w))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        own = {s: c for (g, s), c in groups.items() if g == lang}
        whole = sum(own.values(), Counter())

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        shares, q = {s: p(c) for s, c in own.items()}, p(whole)
        for s in own:
            pair = sorted(((-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode(), o) for o in own if o != s))
            term = sorted((q[t] - shares[s][t], t.encode(), t) for t in kept if own[s][t] and shares[s][t] > q[t])[:ranks]
            out += [(lang, s, part, x, -v, k + 1) for part, found in (("pair", pair), ("term", term)) for k, (v, _, x) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("light", "tile", "cells", "held"), [(8, 256, 1 << 17, 1 << 17), (2, 3, 20, 5), (1, 2, 7, 50), (1000, 4, 100, 3)])
def test_against_brute_force(spark, monkeypatch, light, tile, cells, held):
    for name, v in (("LIGHT", light), ("TILE", tile), ("CELLS", cells), ("HELD", held)):
        monkeypatch.setattr(divergence, name, v)
    rng = random.Random(7)
    words = ["The", "the", "of", "Ärger", "ärger", "naïve", "x1y", "don't", "中文"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(None, None, None), (None, "en", "empty"), ("", "en", ""), ("123 !", "xx", "a"), ("lonely lonely", "yy", "b"), ("same same", "en", "s1"), ("same same", "en", "s1")]
    for k in range(260):
        s = "hot" if k % 3 == 0 else f"s{rng.randrange(9)}"
        rows.append((" ".join(rng.choice(words[: rng.randrange(3, len(words))]) for _ in range(rng.randrange(30))), rng.choice(["en", "de", "en", None]), s))
    df = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int").repartition(4)
    got = [tuple(r) for r in divergence.divergence(df, least_docs=6, ranks=7).select("lang", "source", "part", "item", "value", "rank").collect()]
    want = brute(rows, 6, 7)
    assert sorted(got) == want
    assert {r[2] for r in want} == {"pair", "term"}
    assert divergence.divergence(df.limit(0)).count() == 0


def test_terms_are_whole_across_slices(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 4)
    text = "abcdefghij kl MNO-pq ééé\n" * 3
    assert divergence._terms(text.encode()) == Counter({b"abcdefghij": 3, b"kl": 3, b"mno": 3, b"pq": 3, "ééé".encode(): 3})
