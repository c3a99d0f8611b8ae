import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from heddle.llm import lm


def brute(rows, kappa):
    toks = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    grams, hist = [Counter(), Counter(), Counter()], [Counter(), Counter(), Counter()]
    for t, h in zip(toks, held, strict=True):
        if not h:
            past = ["<s>", *t]
            for k, w in enumerate(t):
                for n in range(min(3, k + 2)):
                    grams[n][*past[k + 1 - n : k + 1], w] += 1
                    hist[n][*past[k + 1 - n : k + 1]] += 1
    total, v = sum(grams[0].values()), len(grams[0])

    def p(history, w):
        n = len(history)
        if not n:
            return (grams[0][w,] + 1) / (total + v + 1)
        k = kappa[n - 1]
        return (grams[n][*history, w] + k * p(history[1:], w)) / (hist[n][*history] + k)

    out = []
    for (i, _), t, h in zip(rows, toks, held, strict=True):
        base = sum(math.log10(p((), w)) for w in t)
        past = ["<s>", *t]
        score = sum(math.log10(p(tuple(past[max(0, k - 1) : k + 1]), w)) for k, w in enumerate(t))
        out.append((i, h, len(t), sum(grams[0][w,] > 0 for w in t), total, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(None, None), (None, "A b"), (3, ""), (4, " \n"), (5, "one"), (5, "one")] + [(i, " ".join(rng.choice(["A", "b", "é", "C" + str(rng.randrange(40))]) for _ in range(rng.randrange(90)))) for i in range(6, 150)]
    rows.append((150, " ".join(rng.choice("ab") for _ in range(2000))))
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    for kappa, block in (((3.0, 0.5), 1 << 10), ((3.0, 0.5), lm.BLOCK_BYTES), (lm.KAPPA, 1 << 12)):
        monkeypatch.setattr(lm, "BLOCK_BYTES", block)
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(df, kappa=kappa).collect()), key=str)
        assert got == brute(rows, kappa)
    assert any(r[1] for r in got)
    assert lm.score(df.limit(0)).count() == 0


def test_only_held_out(spark):
    only = next(i for i in range(100) if lm.held_out(i))
    r = lm.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 0, 0, 0.0, 0.0)


def model(texts, kappa=(3.0, 0.5)):
    ids = [i for i in range(1000) if not lm.held_out(i)][: len(texts)]
    g = lm.Grams(pa.table({"doc_id": ids, "text": texts}), "text", "doc_id")
    c = [o.n.astype(float) for o in g.orders]
    own = np.arange(len(c[0])) != g.start
    return g, lm.build(g, c, c[0][own].sum(), float((c[0][own] > 0).sum()), kappa)


def test_arcs_of_a_state_sum_to_one():
    """Arcs, and failure arcs followed by the arcs of lower states that the state itself lacks, are a distribution over the known words and one unknown."""
    g, a = model(["a b a c", "a b b", "c a b a", ""])
    words = [i for i in range(len(g.orders[0].key)) if i != g.start]
    arcs = {(s, t): w for s, t, w in zip(a.source.tolist(), a.token.tolist(), a.weight.tolist(), strict=True)}
    assert len(arcs) == len(a.source)
    for state in range(len(a.fail)):
        total = 0.0
        for w in words:
            here, log = state, 0.0
            while (here, w) not in arcs:
                log, here = log + a.fail_weight[here], a.fail[here]
            total += 10 ** (log + arcs[here, w])
        unknown, here = 0.0, state
        while here:
            unknown, here = unknown + a.fail_weight[here], a.fail[here]
        total += 10**unknown / (sum(o for k, o in enumerate(g.orders[0].n) if k != g.start) + len(words) + 1)
        assert abs(total - 1) < 1e-9
    assert a.fail.max() > 0  # failure arcs chain


def test_lanes_carry_the_state():
    rng = random.Random(8)
    g, a = model([" ".join(rng.choice("abcd") for _ in range(n)) for n in (0, 1, 2, 3, 50, 333)])
    whole = lm.traverse(a, g.off, 1000)
    for lane in (2, 3, 7, 64):
        assert np.allclose(lm.traverse(a, g.off, lane), whole)
    # by the arcs alone, token by token
    arcs = {(s, t): (w, to) for s, t, w, to in zip(a.source.tolist(), a.token.tolist(), a.weight.tolist(), a.target.tolist(), strict=True)}
    at = 0
    for begin, stop in zip(g.off[:-1], g.off[1:], strict=True):
        state = a.start
        for t in g.orders[0].of[begin:stop].tolist():
            log = 0.0
            while (state, t) not in arcs:
                log, state = log + a.fail_weight[state], int(a.fail[state])
            weight, state = arcs[state, t]
            assert abs(whole[at] - log - weight) < 1e-9
            at += 1
