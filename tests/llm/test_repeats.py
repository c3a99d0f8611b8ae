"""Operators 4 and 9 against brute force: the kernels over many small blocks, then through Spark."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from heddle.llm import repeats as R
from heddle.llm import substrings as S
from heddle.llm import suffixes as X


def in_memory(plan, rows, per_block):
    """Symbols and coverage of each row, by the plan's kernels and reducers without Spark."""
    tables = [pa.table({"doc_id": pa.array([r[0] for r in rows[i : i + per_block]], pa.int64()), "text": pa.array([r[1] for r in rows[i : i + per_block]], pa.string())}) for i in range(0, len(rows), per_block)]
    plan.parts = [3, 4, 5]
    replies = [[] for _ in tables]
    for send, reducer in ((plan.send_one, plan.count), (plan.send_two, plan.contexts), (plan.send_three, plan.extensions)):
        sent = pa.Table.from_batches([b for i, t in enumerate(tables) for b in send(i, t, replies[i])])
        new = [{} for _ in tables]
        for kind, number in set(zip(sent["kind"].to_pylist(), sent["part"].to_pylist(), strict=True)):
            part = sent.filter(pa.compute.and_(pa.compute.equal(sent["kind"], kind), pa.compute.equal(sent["part"], number))).combine_chunks()
            for block, reply in zip(part["block"].to_pylist(), reducer(part), strict=True):
                new[block][kind, number] = reply
        for mine, n in zip(replies, new, strict=True):
            mine.append(n)
    out = []
    for t, mine in zip(tables, replies, strict=True):
        sym, gone = plan.covered(t, mine)
        out += [(sym, gone[a:b]) for a, b in zip(sym.off[:-1], sym.off[1:], strict=True)]
    return out


def brute_any(seqs, length):
    seen = Counter(tuple(s[i : i + length]) for s in seqs for i in range(len(s) - length + 1))
    return [cover(s, [i for i in range(len(s) - length + 1) if seen[tuple(s[i : i + length])] > 1], length) for s in seqs]


def brute_earlier(ids, seqs, length):
    least = {}
    at = lambda d, i: (d is not None, d or 0, i)
    for d, s in zip(ids, seqs, strict=True):
        for i in range(len(s) - length + 1):
            w = bytes(s[i : i + length])
            least[w] = min(least.get(w, at(d, i)), at(d, i))
    return [cover(s, [i for i in range(len(s) - length + 1) if least[bytes(s[i : i + length])] < at(d, i)], length) for d, s in zip(ids, seqs, strict=True)]


def cover(s, starts, length):
    hit = [False] * len(s)
    for i in starts:
        hit[i : i + length] = [True] * length
    return hit


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("aé b cc ddd x y zz").strip() or "o"
    fresh = lambda k: " ".join(f"{word()}{rng.randrange(10**6)}" for _ in range(k))
    passage, common = fresh(50), "the of " * 40
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "same " * 200), (None, passage)]
    for i in range(4, n):
        parts = [fresh(rng.randrange(80))]
        kind = rng.randrange(7)
        if kind < 2:
            parts.insert(rng.randrange(2), passage)
        elif kind == 2:
            parts += [common, passage[: rng.randrange(300)]]
        elif kind == 3 and len(rows) > 8:
            parts = [rng.choice(rows)[1] or ""]
        elif kind == 4 and len(rows) > 8:
            old = (rng.choice(rows)[1] or "q").split(" ")
            old[rng.randrange(len(old))] = "edit"
            parts = [" ".join(old)]
        elif kind == 5:
            p = fresh(45)
            parts += [p, fresh(3), p]
        rows.append((i, "\t".join(parts)))
    rng.shuffle(rows)
    return [*rows, rows[7], (rows[9][0], rows[9][1])]


@pytest.mark.parametrize("crowd", [0, 2, R.CROWD])
@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("per_block", [1, 7, 1000])
def test_words_in_memory(seed, per_block, crowd):
    rows = corpus(seed)
    seqs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for length, k in ((35, 8), (6, 2)):
        got = in_memory(R.Plan(S.WordSymbols, length, k, "any", crowd=crowd), rows, per_block)
        assert [list(g) for _, g in got] == brute_any(seqs, length)


@pytest.mark.parametrize("crowd", [0, 2, R.CROWD])
@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("per_block", [1, 7, 1000])
def test_bytes_in_memory(seed, per_block, crowd):
    rows = corpus(seed)
    seqs = [(t or "").encode() for _, t in rows]
    for length, k in ((100, 28), (13, 5)):
        got = in_memory(R.Plan(X.ByteSymbols, length, k, "earlier", crowd=crowd), rows, per_block)
        assert [list(g) for _, g in got] == brute_earlier([d for d, _ in rows], seqs, length)


def test_segments(monkeypatch):
    monkeypatch.setattr(R, "SEGMENT", 64)
    rows = corpus(11)
    seqs = [(t or "").encode() for _, t in rows]
    got = in_memory(R.Plan(X.ByteSymbols, 100, 28, "earlier"), rows, 9)
    assert [list(g) for _, g in got] == brute_earlier([d for d, _ in rows], seqs, 100)


def test_the_suffix_order_decides(monkeypatch):
    rows = corpus(5)
    seqs = [(t or "").encode() for _, t in rows]
    want = brute_earlier([d for d, _ in rows], seqs, 100)
    plan = lambda: R.Plan(X.ByteSymbols, 100, 28, "earlier")
    assert [list(g) for _, g in in_memory(plan(), rows, 9)] == want

    def shuffled(symbols, starts, length):
        order = np.random.default_rng(1).permutation(len(starts))
        own = [symbols[i : i + length].tobytes() for i in starts[order]]
        return order, np.array([False] + [a == b for a, b in zip(own, own[1:], strict=False)])

    monkeypatch.setattr(R, "suffix_runs", shuffled)
    assert [list(g) for _, g in in_memory(plan(), rows, 9)] != want


def test_equal_hashes_of_different_symbols(monkeypatch):
    """Where all anchors have one key, contents still tell the windows apart."""
    rows = corpus(6, 30)
    seqs = [(t or "").encode() for _, t in rows]
    real = R.anchors

    def one_key(sym, length, k):
        a = real(sym, length, k)
        return R.Anchors(a.key & np.uint64(1 << 63), a.at, a.lo, a.hi)

    monkeypatch.setattr(R, "anchors", one_key)
    assert [list(g) for _, g in in_memory(R.Plan(X.ByteSymbols, 100, 28, "earlier"), rows, 9)] == brute_earlier([d for d, _ in rows], seqs, 100)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_through_spark(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_removed int").repartition(3)
    seqs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    want = defaultdict(list)
    for (d, _), s, g in zip(rows, seqs, brute_any(seqs, 35), strict=True):
        want[d].append((len(s), sum(g), sha(" ".join(w for w, x in zip(s, g, strict=True) if not x).encode())))
    got = defaultdict(list)
    for r in S.substring_dedup(df, keep=["doc_id"]).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}

    seqs = [(t or "").encode() for _, t in rows]
    want = defaultdict(list)
    for (d, _), s, g in zip(rows, seqs, brute_earlier([d for d, _ in rows], seqs, 100), strict=True):
        spans = sum(x and not y for x, y in zip(g, [False, *g[:-1]], strict=True)) if g else 0
        want[d].append((len(s), sum(g), spans, sha(bytes(b for b, x in zip(s, g, strict=True) if not x))))
    got = defaultdict(list)
    for r in X.suffix_dedup(df, replace=True).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert S.substring_dedup(df.limit(0)).count() == 0 and X.suffix_dedup(df.limit(0)).count() == 0
