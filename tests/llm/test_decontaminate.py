import hashlib
import random
import re

import numpy as np

from heddle.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    wins = []
    for name, text in items:
        w = words(text)
        m = min(13, len(w))
        wins += [("" if name is None else str(name), w[i : i + m]) for i in range(len(w) - m + 1 if m else 0)]
    out = {}
    for doc, text in docs:
        w = words(text)
        hit, names = set(), set()
        for name, win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    names.add(name)
        out[doc] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def cases():
    rng = random.Random(5)
    vocab = ["a", "b", "C", "d9", "É", "ß", "straße", "x"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 5, 12, 13, 14, 40])))) for i in range(30)] + [(None, "a b c d9 x x x x"), (7, None), (7, "É.É,É")]
    docs = [(0, None), (1, ""), (2, "--- !!"), (3, items[5][1].upper())]
    for i in range(4, 60):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(60)))]
        if i % 2:
            parts.insert(rng.randrange(2), rng.choice(items)[1] or "")
        docs.append((i, ", ".join(parts)))
    docs.append((60, " ".join(rng.choice(vocab) for _ in range(5000))))
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for limit in (D.PASS_BYTES, 100 * D.WORD_BYTES):  # one pass, several passes
        assert (len(list(D.passes(b, limit))) > 2) == (limit < D.PASS_BYTES)
        got = {r[0]: tuple(r)[1:] for r in D.decontaminate(d, b, keep=["doc_id"], pass_bytes=limit).collect()}
        assert got == brute(docs, items)


def occurrences(items, texts):
    return D.Pass([(n, D.words_of(t)) for n, t in items]).search([D.words_of(t) for t in texts])


def test_long_windows_skip():
    item = b" ".join(b"w%d" % i for i in range(13))
    found = D.Pass([("i", D.words_of(item))])
    text = b"z " * 40 + item + b" z" * 400
    assert found.search([D.words_of(text)]) == [([(40, 53)], {"i"})]
    group = found.groups[0]
    looked = []
    real = D.Words.grams
    try:
        D.Words.grams = lambda self, at, n: (looked.append(len(at)) if n == D.BLOCK else None) or real(self, at, n)
        group.candidates(D.Words([D.words_of(text)]))
    finally:
        D.Words.grams = real
    assert sum(looked) < 453 / 11 + 14  # shifts of up to eleven words


def test_lanes_and_long_items():
    """A text longer than a lane; an item longer than a pass, whose windows are cut between passes."""
    rng = random.Random(3)
    word = lambda: b"%d" % rng.randrange(10**6)
    item = [word() for _ in range(500)]
    text = [word() for _ in range(3 * D.LANE)]
    text[D.LANE - 5 : D.LANE + 35] = item[100:140]
    assert sorted(occurrences([("x", b" ".join(item))], [b" ".join(text)])[0][0]) == [(D.LANE - 5 + i, D.LANE + 8 + i) for i in range(28)]

    class Frame:
        def select(self, *_):
            return self

        def toLocalIterator(self):
            return iter([{"item_id": "x", "text": b" ".join(item).decode()}, {"item_id": "y", "text": "a b"}])

    parts = list(D.passes(Frame(), 64 * D.WORD_BYTES))
    windows = [tuple(w[i : i + 13]) for p in parts for n, w in p if n == "x" for i in range(len(w) - 12)]
    assert windows == [tuple(item[i : i + 13]) for i in range(488)] and parts[-1][-1] == ("y", [b"a", b"b"])


def test_compiled_size_is_bounded():
    rng = random.Random(4)
    items = [(str(i), [b"w%d" % rng.randrange(10**7) for _ in range(200)]) for i in range(200)]
    assert D.Pass(items).nbytes() <= D.WORD_BYTES * 200 * 200


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(D.B, "word_hashes", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    found = occurrences([("i", b"a b c d")], [b"x a b c d y e f g h"])
    assert found == [([(1, 5)], {"i"})]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.decontaminate(d.limit(0), b).count() == 0
    row = D.decontaminate(d, b.limit(0)).first()
    assert (row.n_words, row.n_hit, row.contaminated, row.text) == (2, 0, False, "a b")


def test_windows_that_all_items_share_are_compared_once():
    """One instruction before every item: a text that has it meets one window, and gets all items."""
    words = lambda t: t.split()
    template = [f"t{i}".encode() for i in range(15)]
    items = [(str(k), [*template, *[f"i{k}w{j}".encode() for j in range(4)]]) for k in range(3000)]
    found = D.Pass(items)
    count = 0
    plain = D.Words.content

    def counted(self, at, n):
        nonlocal count
        count += 1
        return plain(self, at, n)

    D.Words.content = counted
    try:
        texts = [[b"before", *template, b"after"], [*template[:13]], [*template[:12]], [*template, *[f"i7w{j}".encode() for j in range(4)]]]
        got = found.search(texts)
    finally:
        D.Words.content = plain
    assert count < 100
    assert [len(names) for _, names in got] == [3000, 3000, 0, 3000] and sorted(D.merged(got[0][0])) == [(1, 16)] and D.merged(got[3][0]) == [(0, 19)]
