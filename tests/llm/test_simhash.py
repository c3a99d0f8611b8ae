import random
import re

import numpy as np
import xxhash

from heddle.llm import simhash as H


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def points(rng, n):
    out = []
    while len(out) < n:
        p = rng.getrandbits(64)
        out.append(p)
        while rng.random() < 0.6:  # chains of small steps
            for _ in range(rng.randrange(1, 4)):
                p ^= 1 << rng.randrange(64)
            out.append(p)
    return sorted(set(out))


def test_stars_are_exact():
    rng = random.Random(3)
    for n in (1, 2, 50, 900):
        pts = points(rng, n)
        want = brute_components(pts)
        for small in (4, 64, 512):
            own, root = H.stars(np.array(pts, np.uint64), 2, small)
            got = dict(zip(own.tolist(), root.tolist(), strict=True))
            assert [got.get(p, p) for p in pts] == [pts[w] for w in want]


def test_fingerprint():
    for t in (None, "", " \n", "One", "one two", "a b c", "A b C d e É É", " ".join(f"w{i % 50}" for i in range(400))):
        assert H.fingerprint(t.encode() if t else None) == brute_fp(t)


def test_through_spark(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 40, 300]))) for _ in range(60)]
    texts = [None, "", "  "] + base
    for _ in range(150):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = [(1000 - i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], "clash"), (1000, texts[0], "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    fps = [brute_fp(t) for _, t, _ in rows]
    comp = brute_components(fps)
    least = {}
    for (i, _, _), c in zip(rows, comp, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted(((i, f"{fp:016x}", least.get(c)) for (i, _, _), fp, c in zip(rows, fps, comp, strict=True)), key=str)
    got = H.near_dedup(df, leaf=16).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert H.near_dedup(df.limit(0)).count() == 0


def test_similar_texts(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 200, 800]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            w = list(base)
            for _ in range(rng.choice([1, len(w) // 80, len(w) // 50, len(w) // 6])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string").repartition(3)
    sets = [set(H.shingles(t.encode(), 5).tolist()) for t in texts]
    like = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = {r.doc_id: r.component_id for r in H.near_dedup(df, shingle=5, similarity=0.8).collect()}
    assert sum(got[i] == got[j] for i, j in like) >= 0.97 * len(like) and len(like) > 40
    root = list(range(len(texts)))
    for _ in range(9):
        for i, j in like:
            root[i] = root[j] = min(root[i], root[j])
    wrong = sum(got[i] == got[j] and root[i] != root[j] for i in range(len(texts)) for j in range(i))
    assert wrong <= 2  # fingerprints within two bits


def test_similar_texts_edited_independently(spark):
    """Groups of copies near the limit, some without their original: all candidates are linked as brute force links them."""
    rng = random.Random(5)
    texts = []
    for g in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(base)] * (g % 2)
        for _ in range(60):
            w = list(base)
            for _ in range(5):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    hashes = [H.shingles(t.encode(), 5) for t in texts]
    sets, subs = [set(h.tolist()) for h in hashes], [set(H.subfingerprints(h).tolist()) for h in hashes]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if subs[i] & subs[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in H.near_dedup(df, radius=0, shingle=5, similarity=0.8).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_dense_leaves_are_split(spark):
    """Points of one small ball, which no vantage point parts well: blocks of a leaf meet in pairs, and no link is lost."""
    rng = np.random.default_rng(3)
    fps = {0}
    while len(fps) < 1500:
        fps.add(sum(1 << int(b) for b in set(rng.integers(0, 14, rng.integers(0, 7)).tolist())) << 20)
    points = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    for radius in (0, 1):
        found = [(r.fp, r.root) for r in H.links(df, radius, leaf=8).collect()]
        number = {int(x): i for i, x in enumerate(points.view(np.int64))}
        a, b = (np.array([number[p[k]] for p in found], np.int64) for k in (0, 1))
        label = H.least_labels(len(points), a, b) if len(a) else np.arange(len(points))
        near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
        x, y = np.nonzero(near)
        assert np.array_equal(label, H.least_labels(len(points), x, y))


def test_leaf_size_is_bounded():
    assert [H.leaf_size(n) for n in (0, 10**6, 4 * 10**6, 10**9)] == [H.LEAF, H.LEAF, 15625, H.LEAF_MOST]


def test_candidates_by_length_of_text():
    """Of made-up pairs of similarity 0.8 or more, whatever their length, nearly all share a sub-fingerprint."""
    rng = random.Random(1)
    for n in (8, 10, 12, 16, 20, 30, 50, 100, 400):
        hit = total = 0
        while total < 300:
            one = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            two = list(one)
            for _ in range(rng.randrange(1, max(2, n // 25 + 2))):
                i = rng.choice([0, len(two) - 1, rng.randrange(len(two))])
                two[i : i + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(2)
            a, b = (np.unique(H.shingles(" ".join(x).encode(), 5)) for x in (one, two))
            common = len(np.intersect1d(a, b))
            if len(a) + len(b) > 2 * common and common >= 0.8 * (len(a) + len(b) - common):
                total += 1
                hit += bool(np.intersect1d(H.subfingerprints(a), H.subfingerprints(b)).size)
        assert hit / total > 0.99, (n, hit / total)


def test_equal_fingerprints_are_not_one_text(spark, monkeypatch):
    """Of texts with one fingerprint each is compared, whatever their ids: x and y have one, only y is like z."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    shing = lambda t: set(H.shingles(t.encode(), 5).tolist())
    like = lambda a, b: len(shing(a) & shing(b)) >= 0.8 * len(shing(a) | shing(b))
    y, z = " ".join(base), " ".join(base[:-5])
    x = " ".join([f"x{rng.randrange(9)}" for _ in range(3)] + base[3:] + ["q", "r", "s"])
    assert like(y, z) and not like(x, z)
    monkeypatch.setattr(H, "simhash", lambda h: 5 if len(h) != len(base) - 9 else 1 << 63)  # x, y: one fingerprint, z: far from it
    for order in ([x, y, z], [y, x, z], [z, y, x], [z, x, y]):
        df = spark.createDataFrame(list(enumerate(order)), "doc_id long, text string")
        fps = spark.createDataFrame(H_rows(order), "doc_id long, fp long, subs array<long>, size long, sketch binary, node long")
        monkeypatch.setattr(H, "fingerprints", lambda *a, f=fps, **k: f)
        assert {r.component_id for r in H.near_dedup(df, radius=0, shingle=5, similarity=0.8).collect()} == {0}


def H_rows(texts):
    out = []
    for i, t in enumerate(texts):
        h = H.shingles(t.encode(), 5)
        size, counts = H.sketch(h)
        out.append((i, int(np.uint64(H.simhash(h)).view(np.int64)), H.subfingerprints(h).view(np.int64).tolist(), size, bytearray(counts), int(np.array([H.xxhash.xxh64_intdigest(np.unique(h).tobytes())], np.uint64).view(np.int64)[0])))
    return out


def test_one_set_with_several_fingerprints(spark):
    """Repeats change a fingerprint, not the set: such texts are one component."""
    a = " ".join(f"w{i}" for i in range(12))
    texts = [a, a + " " + a + " " + a, " ".join([a] * 9), "other words " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in H.near_dedup(df, radius=0, shingle=5, similarity=0.8).collect()}
    sets = [set(H.shingles(t.encode(), 5).tolist()) for t in texts]
    assert sets[1] == sets[2] and got[1] == got[2] and got[3] == 3
