"""Centroid clustering (operator 11): Ball k-means on whole numbers.

A cluster is a ball around its centroid that holds its members. For a member at distance d
of its centroid a, another centroid c can only be as near if |a - c| <= 2 d. So the balls of
a block need only their neighbour centroids, those within twice the radius; members within
half the distance of the nearest neighbour are the stable core and are not compared; the
others lie in annuli, and those between half the distances of the m-th and the next
neighbour are compared with the first m exactly. A pair of centroids that did not move since
the last round needs no comparison: its members' choice stands.

Components are floor(SCALE x), so distances, sums and centroids are exact and ties go to the
smaller number whatever the partitions. Vectors are packed into blocks in the shared folder
once and never shuffled; a round reads them where they are, sends each block's sums (one row)
and keeps a block's assignment as bytes. Centroids, k rows, go to all tasks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm import blocks as B
from heddle.llm.shared import drop, stored

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Most clusters: k centroids, k * k distances and k sums are held by each task.
MOST_CLUSTERS = 4096
STATE = "block long, kind int, part int, reply binary, sums array<long>"
RESULT = [("cluster", T.IntegerType()), ("distance", T.LongType())]


def whole_vectors(df: DataFrame, vector: str, keep: list[str], dims: int, scale: int) -> DataFrame:
    """keep (as __keep) and __vector, dims components floor(scale x) as int32, of the rows that have dims finite components."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__keep"), F.col(f"`{vector}`").cast("array<double>").alias("__vector"))
    limit = math.isqrt((1 << 61) // dims) // 4

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            right = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
            column, kept = column.filter(right), batch.column(0).filter(right)
            x = np.floor(scale * pc.fill_null(column.flatten(), math.nan).to_numpy(zero_copy_only=False).reshape(-1, dims))
            finite = np.isfinite(x).all(axis=1)
            x = x[finite]
            if len(x) and np.abs(x).max() > limit:
                raise ValueError(f"a component is over {limit / scale}: squared distances would not fit a long")
            own = np.ascontiguousarray(x.astype(np.int32)).view(f"V{4 * dims}").ravel().tolist()
            yield pa.RecordBatch.from_arrays([kept.filter(pa.array(finite)), pa.array(own, pa.binary())], names=["__keep", "__vector"])

    return rows.mapInArrow(run, T.StructType([T.StructField("__keep", rows.schema["__keep"].dataType), T.StructField("__vector", T.BinaryType())]))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, exact."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def gaps_of(centroids: np.ndarray) -> np.ndarray:
    return np.stack([squared(centroids, c) for c in centroids])


def assign(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, gaps: np.ndarray, moved: np.ndarray, count: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (of equal ones the smaller number) and its squared distance, given the one of the round before.

    moved: centroids that changed since own was right. count gets the numbers of exact comparisons with neighbours.
    """
    out, best = own.copy(), np.empty(len(x), np.int64)
    for i in np.unique(own):
        members = np.flatnonzero(own == i)
        d = squared(x[members], centroids[i])
        order = np.argsort(-d, kind="stable")  # from the rim of the ball to its core
        members, d = members[order], d[order]
        near, which = d.copy(), np.full(len(d), i, own.dtype)
        ball = 4 * d[0]
        neighbours = np.flatnonzero((gaps[i] <= ball) & (moved | moved[i]))
        for j in neighbours[np.argsort(gaps[i, neighbours], kind="stable")]:
            if j == i:
                continue
            # members outside half the distance of this neighbour; at half, only a smaller number can win
            n = int(np.searchsorted(-4 * d, -gaps[i, j], "right" if j < i else "left"))
            if n:
                e = squared(x[members[:n]], centroids[j])
                nearer = (e < near[:n]) | ((e == near[:n]) & (j < which[:n]))
                near[:n][nearer] = e[nearer]
                which[:n][nearer] = j
                if count is not None:
                    count.append(n)
        out[members], best[members] = which, near
    return out, best


def _block(table: pa.Table, dims: int) -> np.ndarray:
    column = table["__vector"].combine_chunks().cast(pa.large_binary())
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)


def _before(replies: list[dict], n: int) -> np.ndarray:
    return np.frombuffer(replies[0][0, 0], np.int32).copy() if replies else np.zeros(n, np.int32)


def ball_kmeans(df: DataFrame, vector: str = "embedding", key: str = "vec_id", keep: list[str] | None = None, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """The rows of df with exactly dims finite components: keep (key if not given), cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Centroids start as the k vectors with the least SHA-256 of seed and key; of equal keys the
    vector that sorts first, null keys last. With fewer rows there are fewer clusters. Rows
    with null, non-finite, missing or more components give no row. Repeated rows count as
    often as they occur. Columns of a result's name are replaced. A component that is so large
    that a squared distance would not fit a long is an error. An empty table gives no rows.
    """
    if not 0 < k <= MOST_CLUSTERS:
        raise ValueError(f"from 1 to {MOST_CLUSTERS} clusters")
    names = [*(n for n, _ in RESULT), "cluster_inertia", "inertia", "centroid_sha256"]
    kept = [c for c in (keep or [key]) if c not in names]
    rows = whole_vectors(df, vector, list(dict.fromkeys([*kept, key])), dims, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"__keep.`{key}`").cast("string")), 256)
    first = rows.select("__vector", order.alias("h")).orderBy(F.asc_nulls_last("h"), "__vector").limit(k).collect()
    centroids = np.array([np.frombuffer(r[0], np.int32) for r in first], np.int64).reshape(-1, dims)
    index = B.pack(rows, text="__vector")
    k, moved, state = len(centroids), np.ones(len(centroids), bool), None
    for _ in range(rounds if k else 0):

        def step(block, table, replies, c=centroids, gaps=gaps_of(centroids), moved=moved):
            x = _block(table, dims)
            own, _ = assign(x, _before(replies, len(x)), c, gaps, moved)
            sums = np.zeros((k, dims + 1), np.int64)
            for i in np.unique(own):
                mine = x[own == i]
                sums[i, :dims], sums[i, dims] = mine.sum(axis=0), len(mine)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))], names=["block", "kind", "part", "reply", "sums"])

        found = stored(B.kernel(index, step, STATE, *([state.drop("sums")] if state is not None else [])), "kmeans-round")
        if state is not None:
            drop(state)
        state = found
        total = found.select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)"))).collect()
        sums = np.zeros(k * (dims + 1), object)
        for at, n in total:
            sums[at] = int(n)
        sums = sums.reshape(k, dims + 1)
        after = np.array([[int(s // row[dims]) for s in row[:dims]] if row[dims] else old for row, old in zip(sums, centroids.tolist(), strict=True)], np.int64)
        moved, centroids = (after != centroids).any(axis=1), after
        if not moved.any():  # the same for ever
            break

    inner = T.StructType([rows.schema["__keep"], *[T.StructField(n, t) for n, t in RESULT]])

    def last(block, table, replies, c=centroids, gaps=gaps_of(centroids) if k else None, moved=moved):
        x = _block(table, dims)
        own, d = assign(x, _before(replies, len(x)), c, gaps, moved)
        yield pa.RecordBatch.from_arrays([table["__keep"].combine_chunks(), pa.array(own, pa.int32()), pa.array(d, pa.int64())], names=["__keep", *(n for n, _ in RESULT)])

    out = stored(B.kernel(index, last, inner, *([state.drop("sums")] if state is not None else [])), "kmeans")
    B.drop_blocks(index)
    if state is not None:
        drop(state)
    inertia = {r[0]: int(r[1]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    told = [(i, n, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, n in inertia.items()]
    told = df.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # at most k rows
    return out.join(F.broadcast(told), "cluster").select(*[F.col(f"__keep.`{c}`").alias(c) for c in kept], *names)
