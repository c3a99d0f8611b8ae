"""SimHash near-dedup (operator 6): exact pairs within a Hamming distance by vantage-point trees.

Equal fingerprints are collapsed first, so a group of copies is one point whatever its size.
A vantage-point tree, fitted on a bounded sample, parts the distinct fingerprints by their
distance to its vantage points: near (d <= mu) and far (d > mu). By the triangle inequality
two points within r differ by at most r in their distance to any vantage point, so a far
point with d <= mu + r also goes to the near side, and every pair within r meets in a leaf.
A leaf does the same with a tree of its own down to small sets, which are compared whole.
It returns its connected points as stars; the stars of all leaves are joined by propagating
the least label with pointer jumping, one stored table for each round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.blocks import mix
from heddle.llm.shared import discard, drop, scratch, stored

SHINGLE, BITS, SEED = 3, 2, 42
#: Points a leaf should have, at least and at most (more points, fewer levels and fewer points on both sides); most points of the sample the tree is fitted on; points compared whole inside a leaf.
LEAF, LEAF_MOST, SAMPLE, SMALL = 4096, 1 << 16, 1 << 20, 512
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
U64 = np.uint64


def shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; of the whole sequence where it is shorter, none without words."""
    words = (text or b"").translate(_LOWER).split()
    norm = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(norm, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((digest(norm[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1)


def simhash(hashes: np.ndarray) -> int:
    """Unsigned; a bit is one if it is in over half the hashes, so zero without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes())


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    return simhash(shingles(text, shingle))


#: Sub-fingerprints: of 2 ** level classes of the shingles by their hash, the first CLASSES; PER_CLASS shingles in one at the coarser level, half as many at the finer.
CLASSES, PER_CLASS = 16, 3
#: Below so many shingles a coarser and a finer level are taken as well.
FEW = 16
#: Counters of a sketch; most members of a sub-fingerprint's block; rounds in which leaders are compared before all remaining candidates are.
BINS, BLOCK, ROUNDS = 256, 1024, 2


def subfingerprints(hashes: np.ndarray) -> np.ndarray:
    """XORs of small classes of the distinct shingles, at two sizes: documents of similarity 0.8 have one in common with a probability of over 0.99 (measured by length of text in the tests)."""
    own = np.unique(hashes)
    out = []
    level = max(0, int(np.log2(len(own) / PER_CLASS))) if len(own) else 0
    few = len(own) < FEW  # in which one edit changes many of them
    for lv in range(max(0, level - few), level + 2 + few) if len(own) else ():
        kind = own >> U64(64 - lv) if lv else np.zeros(len(own), np.uint64)
        kind = kind[kind < CLASSES]
        if len(kind):
            first = np.flatnonzero(np.diff(kind, prepend=U64(CLASSES)))
            out.append(np.bitwise_xor.reduceat(mix(own[: len(kind)]), first) ^ mix(kind[first] + U64(lv << 8)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(hashes: np.ndarray) -> tuple[int, bytes]:
    """Number of distinct shingles, and how many fall into each of BINS bins by their hash; without the latter where a count needs over a byte."""
    own = np.unique(hashes)
    counts = np.bincount((own % U64(BINS)).astype(np.int64), minlength=BINS)
    return len(own), counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def sketches(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One row of counters for each sketch, and whether it has any."""
    parts = [s if s else b"" for s in column.to_pylist()]
    known = np.array([len(s) == BINS for s in parts], bool)
    return np.frombuffer(b"".join(s if k else bytes(BINS) for s, k in zip(parts, known, strict=True)), np.uint8).reshape(-1, BINS), known


def reach(most: np.ndarray, both: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets with at most most shingles in common, of both in all, can be similar; exact if most is what they have in common."""
    return most >= similarity * (both - most)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, subs: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long), and subs, size, sketch and node (XXH64) of the set of shingles, empty unless asked for."""

    def run(batches):
        for batch in batches:
            fps, parts, sizes, bins, nodes = [], [], [], [], []
            for t in batch.column(1).cast(pa.large_binary()):
                h = shingles(t.as_py(), shingle)
                fps.append(simhash(h))
                parts.append(subfingerprints(h).view(np.int64) if subs else [])
                size, counts = sketch(h) if subs else (None, None)
                sizes.append(size)
                bins.append(counts)
                nodes.append(xxhash.xxh64_intdigest(np.unique(h).tobytes(), SEED) if subs else 0)
            own = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(parts, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(bins, pa.binary()), pa.array(np.array(nodes, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own], names=["doc_id", "fp", "subs", "size", "sketch", "node"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"doc_id {kind}, fp long, subs array<long>, size long, sketch binary, node long")


@dataclass
class Tree:
    """Inner nodes: vantage point, mu, and the children; a child c < 0 is leaf -c - 1."""

    vantage: np.ndarray
    mu: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def route(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, index of point) for each leaf that a point's ball may share with another's."""
        if not len(self.mu):
            return np.zeros(len(points), np.int64), np.arange(len(points))
        node, at = np.zeros(len(points), np.int64), np.arange(len(points))
        leaves, found = [], []
        while len(node):
            d = np.bitwise_count(points[at] ^ self.vantage[node]).astype(np.int64)
            near, far = d <= self.mu[node] + radius, d > self.mu[node]
            node, at = np.concatenate([self.near[node[near]], self.far[node[far]]]), np.concatenate([at[near], at[far]])
            done = node < 0
            leaves.append(-node[done] - 1)
            found.append(at[done])
            node, at = node[~done], at[~done]
        return np.concatenate(leaves), np.concatenate(found)


def build(points: np.ndarray, leaf: int, radius: int, depth: int = 16) -> Tree:
    """A tree over points whose leaves have at most leaf of them, where that many can be told apart."""
    rng = np.random.default_rng(len(points))
    nodes: list[list[int]] = []
    n_leaves = 0
    work = [(points, None, 0, 0)]  # points, parent, side, depth
    while work:
        own, parent, side, level = work.pop()
        best = None
        if len(own) > leaf and level < depth:
            sample = own if len(own) <= 2048 else rng.choice(own, 2048, replace=False)
            for v in rng.choice(own, min(8, len(own)), replace=False):
                d = np.sort(np.bitwise_count(sample ^ v).astype(np.int64))
                mid = int(d[len(d) // 2])
                for mu in (mid - 1, mid):
                    near, both = int((d <= mu).sum()), int(((d > mu) & (d <= mu + radius)).sum())
                    if 0 < near < len(d):
                        cost = max(near + both, len(d) - near)
                        if best is None or cost < best[0]:
                            best = (cost, v, mu)
        if best is None:
            n_leaves += 1
            here = -n_leaves
        else:
            here = len(nodes)
            d = np.bitwise_count(own ^ best[1]).astype(np.int64)
            nodes.append([int(best[1]), best[2], 0, 0])
            work.append((own[d <= best[2]], here, 2, level + 1))
            work.append((own[d > best[2]], here, 3, level + 1))
        if parent is not None:
            nodes[parent][side] = here
    cols = list(zip(*nodes, strict=True)) if nodes else [(), (), (), ()]
    return Tree(np.array(cols[0], np.uint64), *(np.array(c, np.int64) for c in cols[1:]))


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index connected to each of n points by the edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def stars(points: np.ndarray, radius: int, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Distinct points -> (point, least point connected to it within this set), for those not the least."""
    points = np.sort(points)
    leaf, at = build(points, small, radius, depth=24).route(points, radius)
    order = np.argsort(leaf, kind="stable")
    leaf, at = leaf[order], at[order]
    cut = np.append(np.flatnonzero(np.diff(leaf, prepend=-1)), len(leaf))
    label = np.arange(len(points))
    held_a, held_b, held = [], [], 0
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        ids = at[lo:hi]
        for i in range(0, len(ids), 1024):
            x = ids[i : i + 1024]
            for j in range(i, len(ids), 1024):
                y = ids[j : j + 1024]
                p, q = np.nonzero(np.bitwise_count(points[x][:, None] ^ points[y][None, :]) <= radius)
                a, b = x[p], y[q]
                own = a < b
                a, b = a[own], b[own]
                held_a.append(a)
                held_b.append(b)
                held += len(a)
                if held > 1 << 20:  # what is known is a star for each point
                    label = least_labels(len(points), np.concatenate([*held_a, np.arange(len(points))]), np.concatenate([*held_b, label]))
                    held_a, held_b, held = [], [], 0
    label = least_labels(len(points), np.concatenate([*held_a, np.arange(len(points))]), np.concatenate([*held_b, label]))
    own = np.flatnonzero(label != np.arange(len(points)))
    return points[own], points[label[own]]


def leaf_size(n: int) -> int:
    """A leaf for each of some hundred tasks, within bounds."""
    return max(LEAF, min(LEAF_MOST, n // 256))


def links(points: DataFrame, radius: int = BITS, leaf: int | None = None) -> DataFrame:
    """Stars (fp, root) that connect the distinct fingerprints fp as their pairs within radius do.

    A leaf that the tree can't part further, of many times the wanted size, is dealt into
    blocks; each two of its blocks meet in a task of their own, so no task is larger.
    """
    spark = points.sparkSession
    n = points.count()
    leaf = leaf or leaf_size(n)
    wanted = max(1, n // leaf)
    size = min(n, SAMPLE, 16 * wanted)
    sample = [r[0] for r in points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(size).collect()] if wanted > 1 else []
    tree = build(np.array(sample, np.int64).view(np.uint64), max(1, len(sample) // wanted), radius)
    shipped = spark.sparkContext.broadcast(tree)  # at most 2 * SAMPLE / 16 nodes of 32 bytes

    def route(batches):
        for batch in batches:
            p = batch.column(0).to_numpy(zero_copy_only=False)
            where, at = shipped.value.route(p.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(p[at])], names=["leaf", "fp"])

    def connect(table: pa.Table) -> pa.Table:
        own, root = stars(np.unique(table["fp"].to_numpy()).view(np.uint64), radius)
        return pa.table({"fp": own.view(np.int64), "root": root.view(np.int64)})

    routed = points.select("fp").mapInArrow(route, "leaf long, fp long")
    sizes = routed.groupBy(F.col("leaf").alias("__leaf")).agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.count("*") / F.lit(8 * leaf)).cast("long")).alias("k"))
    rows = routed.join(sizes, F.col("leaf") == F.col("__leaf")).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("k")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    rows = rows.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")
    return rows.groupBy("leaf", "i", "j").applyInArrow(connect, "fp long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) edges -> (fp, label), the least fp (as a signed long) of its component, for every fp that has an edge; stored."""
    pairs = edges.select(F.col("fp").alias("a"), F.col("root").alias("b"))
    both = stored(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "simhash-edges")
    held = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "simhash-labels")
    while True:
        labels = held.select("a", "label")
        heard = both.join(labels.withColumnsRenamed({"a": "n", "label": "heard"}), F.col("b") == F.col("n")).groupBy("a").agg(F.min("heard").alias("heard"))
        step = labels.join(heard, "a").select("a", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.withColumnsRenamed({"a": "n", "label": "far"})
        step = stored(step.join(jump, F.col("label") == F.col("n")).select("a", "old", F.least("label", "far").alias("label")), "simhash-labels")
        drop(held)
        held = step
        if not step.filter("label != old").limit(1).count():
            drop(both)
            out = step.select(F.col("a").alias("fp"), "label")
            out.stored_at = step.stored_at
            return out


def similar_links(docs: DataFrame, text: str, key: str, fps: DataFrame, shingle: int, similarity: float, temporary: list[DataFrame]) -> DataFrame:
    """(fp, root) that connect fingerprints as the candidates of at least similarity (Jaccard, whole texts) do.

    What is compared are distinct sets of shingles (nodes, known by 64 bits of hash): one
    text for each, the one of the least doc_id, stands for all with its set, whatever their
    fingerprints; sets of one fingerprint are connected from the start. Candidates share a
    sub-fingerprint, and all are settled: a pair is compared, or its bound by the sketches
    is below similarity, or other pairs have connected it. First each sub-fingerprint's
    leader (the member that shares most of its own, as the original of edited copies does;
    then another one) is compared with the members that aren't connected to it, so that a
    group of copies is mostly one component after n - 1 pairs. Then the members of each
    sub-fingerprint that still has several components meet in blocks by their sketches, and
    what can be similar across components is compared. Only texts in a pair that the bound
    leaves are moved. What is stored on the way is put into temporary. Below, fp is a node.
    """
    def keep(df: DataFrame, what: str) -> DataFrame:
        temporary.append(stored(df, what))
        return temporary[-1]

    members = fps.groupBy("node", "fp").agg(F.min("doc_id").alias("least"), F.any_value(F.struct("size", "sketch")).alias("s"))
    members = keep(members, "simhash-members")
    points = members.groupBy(F.col("node").alias("fp")).agg(F.min("least").alias("least"), F.min("fp").alias("own"), F.any_value("s").alias("s"))
    points = keep(points, "simhash-sets")
    rows = fps.select(F.col("node").alias("fp"), F.explode("subs").alias("sub")).distinct()
    often = rows.groupBy("sub").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keep(rows.join(often, "sub"), "simhash-shared")
    degree = shared.groupBy("fp").agg(F.count("*").alias("degree"))
    nodes = keep(points.join(degree, "fp").select("fp", "degree", "s.size", "s.sketch"), "simhash-nodes")
    first = points.groupBy("own").agg(F.min("fp").alias("root"))
    edges = keep(points.join(first, "own").filter("fp <> root").select("fp", "root"), "simhash-equal")
    done = None
    left = _unsettled(shared, edges, keep)
    for k in range(ROUNDS):
        order = F.struct("degree", "fp") if not k else F.struct(F.xxhash64("fp", "sub", F.lit(k)), "fp")
        lead = left.join(nodes.select("fp", "degree"), "fp").groupBy("sub").agg(F.max_by(F.struct("fp", "label"), order).alias("lead"))
        pairs = left.join(lead, "sub").filter("label <> lead.label").select(F.greatest("fp", "lead.fp").alias("fp"), F.least("fp", "lead.fp").alias("leader")).distinct()
        pairs = keep(_bounded(pairs, nodes, done, similarity), "simhash-pairs")
        edges, done = _add(edges, _alike(pairs, docs, text, key, points, shingle, similarity, keep)), _add(done, pairs)
        left = _unsettled(shared, edges, keep)
    # a sub-fingerprint of two members has been settled by its leader
    pairs = keep(_bounded(_blocks(left.filter("n > 2"), nodes, similarity), None, done, similarity), "simhash-pairs")
    edges = _add(edges, _alike(pairs, docs, text, key, points, shingle, similarity, keep))
    # back to fingerprints: those of the two sets, and all of one set
    own = points.select("fp", "own")
    across = edges.join(own, "fp").join(own.select(F.col("fp").alias("root"), F.col("own").alias("other")), "root").select(F.col("own").alias("fp"), F.col("other").alias("root"))
    same = members.join(own.select(F.col("fp").alias("node"), F.col("own").alias("root")), "node").select("fp", "root")
    return across.union(same).filter("fp <> root").distinct()


def _add(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.union(b)


def _unsettled(shared: DataFrame, edges: DataFrame, keep) -> DataFrame:
    """shared with each fingerprint's component (label), where a sub-fingerprint has several."""
    found = components(edges)
    rows = keep(shared.join(found.withColumnsRenamed({"fp": "__fp"}), F.col("fp") == F.col("__fp"), "left").select("fp", "sub", "n", F.coalesce("label", "fp").alias("label")), "simhash-members")
    drop(found)
    several = rows.groupBy("sub").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("sub")
    return rows.join(several, "sub", "left_semi")


def _bounded(pairs: DataFrame, nodes: DataFrame | None, done: DataFrame | None, similarity: float) -> DataFrame:
    """pairs without those that are done and, given nodes, those whose sketches show that they aren't similar."""
    if done is not None:
        pairs = pairs.join(done, ["fp", "leader"], "left_anti")
    if nodes is None:
        return pairs
    a = nodes.select("fp", F.col("size").alias("n"), F.col("sketch").alias("s"))
    b = nodes.select(F.col("fp").alias("leader"), F.col("size").alias("m"), F.col("sketch").alias("t"))

    def bound(batches):
        for batch in batches:
            n, m = (np.array(batch.column(i).to_pylist(), np.float64) for i in (2, 4))  # null, of a null doc_id: nan
            (x, kx), (y, ky) = sketches(batch.column(3)), sketches(batch.column(5))
            most = np.where(kx & ky, np.minimum(x, y).sum(axis=1, dtype=np.int64), np.minimum(n, m))
            keep = reach(most, n + m, similarity) | np.isnan(n + m)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["fp", "leader"])

    return pairs.join(a, "fp").join(b, "leader").select("fp", "leader", "n", "s", "m", "t").mapInArrow(bound, "fp long, leader long")


def _blocks(left: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (fp, leader) of different components that share a sub-fingerprint and can be similar by their sketches.

    The members of a sub-fingerprint are dealt into blocks of about BLOCK, and each two blocks meet once.
    """
    k = F.ceil(F.col("n") / BLOCK)
    rows = left.join(nodes, "fp").withColumn("block", F.pmod(F.xxhash64("fp", "sub"), k)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), k - 1)))
    rows = rows.select("sub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "label", "size", "sketch")

    def meet(table: pa.Table) -> pa.Table:
        block, fp, label = (table[c].to_numpy() for c in ("block", "fp", "label"))
        size = np.array(table["size"].to_pylist(), np.float64)
        counts, known = sketches(table["sketch"])
        cross = table["i"][0].as_py() != table["j"][0].as_py()
        one, two = [], []
        for x in range(len(fp) - 1):
            y = x + 1 + np.flatnonzero((label[x + 1 :] != label[x]) & ((block[x + 1 :] != block[x]) if cross else True))
            y = y[reach(np.minimum(size[x], size[y]), size[x] + size[y], similarity) | np.isnan(size[x] + size[y])]
            if known[x] and len(y):
                most = np.minimum(counts[x], counts[y]).sum(axis=1, dtype=np.int64)
                y = y[~known[y] | reach(most, size[x] + size[y], similarity)]
            one.append(np.full(len(y), fp[x]))
            two.append(fp[y])
        a, b = (np.concatenate([np.zeros(0, np.int64), *p]) for p in (one, two))
        return pa.table({"fp": np.maximum(a, b), "leader": np.minimum(a, b)})

    return rows.groupBy("sub", "i", "j").applyInArrow(meet, "fp long, leader long").distinct()


def _alike(pairs: DataFrame, docs: DataFrame, text: str, key: str, points: DataFrame, shingle: int, similarity: float, keep) -> DataFrame:
    """(fp, root) of the pairs whose whole texts are similar, stored."""
    spark = docs.sparkSession
    nodes = pairs.select("fp").union(pairs.select(F.col("leader").alias("fp"))).distinct()
    wanted = points.join(nodes, "fp").select("fp", F.col("least").alias("__least"))
    path = scratch(spark, "simhash-texts")
    docs.select(F.col(key).alias("__key"), F.col(text).alias("t")).join(wanted, F.col("__key").eqNullSafe(F.col("__least"))).select("fp", "t").dropDuplicates(["fp"]).write.parquet(path)
    texts = spark.read.parquet(path)
    a, b = texts.withColumnRenamed("t", "a"), texts.select(F.col("fp").alias("leader"), F.col("t").alias("b"))
    both = pairs.join(a, "fp").join(b, "leader").select("fp", "leader", "a", "b")

    def check(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            fp, leader = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            one, two = (batch.column(i).cast(pa.large_binary()) for i in (2, 3))
            keep = np.zeros(len(fp), bool)
            for i in range(len(fp)):
                if leader[i] not in held:
                    held = {leader[i]: np.unique(shingles(two[i].as_py(), shingle))}  # rows mostly come sorted by leader
                x, y = np.unique(shingles(one[i].as_py(), shingle)), held[leader[i]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = reach(common, len(x) + len(y), similarity)
            yield pa.RecordBatch.from_arrays([pa.array(fp[keep]), pa.array(leader[keep])], names=["fp", "root"])

    alike = keep(both.mapInArrow(check, "fp long, root long"), "simhash-alike")
    discard(spark, path)
    return alike


def near_dedup(docs: DataFrame, radius: int = BITS, shingle: int = SHINGLE, text: str = "text", key: str = "doc_id", leaf: int | None = None, similarity: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links of at most radius bits), one row for each row of docs.

    Null and empty texts have fingerprint zero and are linked like any other. A null doc_id
    is never the least; a component of null ids has component_id null. Other columns are
    left behind. An empty table gives no rows.

    With similarity, texts whose sets of shingles have at least that Jaccard similarity are
    linked as well (similar_links): their fingerprints differ by ten bits or so, more than
    a vantage point can tell from chance (32 by 4).
    """
    fps = stored(fingerprints(docs, text, key, shingle, similarity is not None), "fingerprints")
    points = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-points")
    edges, temporary = links(points, radius, leaf), []
    if similarity is not None:
        edges = edges.union(similar_links(docs, text, key, fps, shingle, similarity, temporary))
    edges = stored(edges, "simhash-links")
    for df in temporary:
        drop(df)
    labels = components(edges)
    rooted = points.join(labels.withColumnRenamed("fp", "__fp"), F.col("fp") == F.col("__fp"), "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select(F.col("fp").alias("__fp"), "root").join(ids, "root").select("__fp", "component_id")
    out = fps.join(by_fp, F.col("fp") == F.col("__fp"))  # AQE splits the fingerprint of a large group
    out = stored(out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"), "simhash-components")
    for df in (fps, points, edges, labels):
        drop(df)
    return out
