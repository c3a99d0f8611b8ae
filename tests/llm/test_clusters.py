import hashlib
import math
import random

import numpy as np
import pytest

from heddle.llm import blocks, clusters


def brute(rows, k, rounds, dims, seed=3):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], np.int32).tobytes()))[:k]
    c = [list(v) for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out = [(i, *nearest(v)) for i, v in kept]
    sums = {j: sum(d for _, d, o in out if o == j) for j in range(len(c))}
    return sorted([(i, o, d, sums[o], sum(sums.values()), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, d, o in out], key=str)


def rows_of(rng, n, dims):
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [round(x + rng.gauss(0, 0.2), 2) for x in rng.choice(centres)]) for i in range(n)]
    odd = [(None, rows[0][1]), (None, rows[1][1]), (3, rows[3][1]), (3, rows[4][1]), (n, None), (n + 1, []), (n + 2, [0.5] * (dims + 1)), (n + 3, [None] * dims), (n + 4, [math.nan] * dims), (n + 5, [math.inf, *[0.0] * (dims - 1)]), (n + 6, [0.0] * dims)]
    return rows + odd + [(i + 1000, rows[9][1]) for i in range(60)]


@pytest.mark.parametrize(("k", "dims", "block"), [(8, 6, 1 << 10), (3, 2, 1 << 20), (20, 1, 200), (400, 6, 1 << 12)])
def test_against_brute_force(spark, monkeypatch, k, dims, block):
    plain = blocks.pack
    monkeypatch.setattr(blocks, "pack", lambda df, text: plain(df, text, block))
    rows = rows_of(random.Random(k), 220, dims)
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, label string").repartition(3)
    got = clusters.ball_kmeans(df, k=k, rounds=4, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, 4, dims)
    assert clusters.ball_kmeans(df.limit(0), k=k, dims=dims).count() == 0
    assert clusters.ball_kmeans(df, k=k, rounds=1, dims=dims, keep=["label", "vec_id"]).columns[:2] == ["label", "vec_id"]


def test_few_comparisons_and_ties():
    rng = np.random.default_rng(1)
    c = rng.integers(-4000, 4000, (30, 16))
    own = rng.integers(0, 30, 3000)
    x = c[own] + rng.integers(-300, 300, (3000, 16))
    every = np.stack([clusters.squared(x, y) for y in c])
    for start in (own, np.zeros(3000, np.int64), rng.integers(0, 30, 3000)):
        count = []
        got, d = clusters.assign(x, start, c, clusters.gaps_of(c), np.ones(30, bool), count)
        assert (got == every.argmin(axis=0)).all()
        assert (d == every.min(axis=0)).all()
        if start is own:
            assert sum(count) < 0.2 * every.size  # most lie in the stable core
    # ties: on a line, midpoints and equal centroids
    c = np.array([[4], [0], [2], [2], [8]])
    x = np.arange(-3, 12)[:, None]
    every = np.stack([clusters.squared(x, y) for y in c])
    for start in range(5):
        assert (clusters.assign(x, np.full(len(x), start), c, clusters.gaps_of(c), np.ones(5, bool))[0] == every.argmin(axis=0)).all()


def test_too_large_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 2)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit a long"):
        clusters.ball_kmeans(df, dims=2).collect()
