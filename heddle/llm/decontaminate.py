"""Benchmark decontamination (operator 2): Wu-Manber search over words.

The symbols are words, known by 64-bit hashes. Windows of the items are grouped by length
(13, and the lengths of shorter items). Each group has a shift table over blocks of three
words, which says how far the search may move without missing an occurrence, and buckets of
windows by their last block; in a bucket windows stand by the hash of all their words, and
what agrees in that is compared byte by byte. Texts are searched side by side.

The items are a query set searched against all documents, in passes of bounded size: a pass
is compiled, broadcast, searched, its hits are stored, and it is dropped before the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm import blocks as B
from heddle.llm.shared import stored

U64 = np.uint64
WINDOW = 13
BLOCK = 3
#: Most bytes of compiled items that are searched, and broadcast, at once, and what an item's word takes of them at most.
PASS_BYTES, WORD_BYTES = 96 << 20, 80
#: Ends of windows that are looked at one after the other; longer texts are searched in several lanes.
LANE = 4096
#: Words of texts that are searched side by side.
TOGETHER = 1 << 18
#: A-Z become a-z, other ASCII that is neither digit nor letter becomes a space; bytes of other characters stay.
_TABLE = bytes(c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256)).lower()

RESULT = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class Words:
    """The words of some texts: bytes, where words start and end, their hashes, and off: words before each text, then all."""

    def __init__(self, texts: list[list[bytes]]):
        joined = [b" ".join(t) for t in texts]
        self.buf, self.starts, self.ends, self.off = B.tokens(joined)
        self.hash = B.word_hashes(self.buf, self.starts, self.ends)

    def grams(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n words from at."""
        h = self.hash[at].copy()
        for j in range(1, n):
            h = B.mix(h * U64(B._Q) + self.hash[at + j])
        return h

    def content(self, at: int, n: int) -> bytes:
        return self.buf[self.starts[at] : self.ends[at + n - 1]].tobytes()


@dataclass
class Patterns:
    """Windows of one length: shift table (ascending keys and their shifts) and buckets (key, first and last window).

    Windows (whole, at) are distinct and ascend by bucket and hash. The items that have
    window j are item[owner[j] : owner[j + 1]], so a window that all items share is compared once.
    """

    length: int
    block: int
    key: np.ndarray
    shift: np.ndarray
    bucket: np.ndarray
    first: np.ndarray
    whole: np.ndarray
    at: np.ndarray
    owner: np.ndarray
    item: np.ndarray

    @staticmethod
    def compile(words: Words, starts: np.ndarray, item: np.ndarray, length: int) -> Patterns:
        block = min(BLOCK, length)
        key, shift = np.zeros(0, U64), np.zeros(0, np.uint8)
        for s in range(length - block + 1):  # shifts ascend, so what is there already is the least
            new = np.unique(words.grams(starts + (length - block - s), block))
            key, where = np.unique(np.concatenate([key, new]), return_index=True)
            shift = np.concatenate([shift, np.full(len(new), s, np.uint8)])[where]
        suffix, whole = words.grams(starts + length - block, block), words.grams(starts, length)
        order = np.lexsort((item, whole, suffix))
        suffix, whole, starts, item = suffix[order], whole[order], starts[order], item[order]
        new = np.ones(len(suffix), bool)
        new[1:] = (suffix[1:] != suffix[:-1]) | (whole[1:] != whole[:-1])
        for i in np.flatnonzero(~new).tolist():
            new[i] = words.content(int(starts[i]), length) != words.content(int(starts[i - 1]), length)
        group = np.cumsum(new) - 1
        other = new.copy()
        other[1:] |= item[1:] != item[:-1]  # an item once for each window
        owner = np.append(np.flatnonzero(new[other]), other.sum())
        bucket, first = np.unique(suffix[new], return_index=True)
        return Patterns(length, block, key, shift, bucket, np.append(first, group[-1] + 1 if len(group) else 0), whole[new], starts[new].astype(np.int32), owner, item[other].astype(np.int32))

    def nbytes(self) -> int:
        return sum(getattr(self, c).nbytes for c in ("key", "shift", "bucket", "first", "whole", "at", "owner", "item"))

    def candidates(self, text: Words, lane: int = LANE) -> np.ndarray:
        """Ends (last words) of windows whose last block ends a pattern; others are skipped by the shift table."""
        m, b = self.length, self.block
        begin, stop = text.off[:-1] + m - 1, text.off[1:]
        own = stop > begin
        begin, stop = begin[own], stop[own]
        lanes = -(-(stop - begin) // lane)
        number = np.arange(lanes.sum()) - np.repeat(np.append(0, np.cumsum(lanes)[:-1]), lanes) if len(lanes) else np.zeros(0, np.int64)
        at = np.repeat(begin, lanes) + number * lane
        stop = np.minimum(at + lane, np.repeat(stop, lanes))
        out = []
        while len(at):
            k = text.grams(at - b + 1, b)
            i = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            step = np.where(self.key[i] == k, self.shift[i], m - b + 1).astype(np.int64)
            out.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def search(self, own: Words, text: Words) -> Iterator[tuple[int, int]]:
        """(first word, window) of each occurrence. own: the words of the items."""
        m, b = self.length, self.block
        end = self.candidates(text)
        if not len(end):
            return
        bucket = np.searchsorted(self.bucket, text.grams(end - b + 1, b))
        lo, hi, wanted = self.first[bucket], self.first[bucket + 1], text.grams(end - m + 1, m)
        last = hi.copy()
        while (lo < hi).any():
            mid = (lo + hi) // 2
            less = (lo < hi) & (self.whole[np.minimum(mid, len(self.whole) - 1)] < wanted)
            lo, hi = np.where(less, mid + 1, lo), np.where((lo < hi) & ~less, mid, hi)
        found = np.flatnonzero((lo < last) & (self.whole[np.minimum(lo, len(self.whole) - 1)] == wanted))
        for i in found.tolist():
            at, j, there = int(end[i]) - m + 1, int(lo[i]), None
            while j < last[i] and self.whole[j] == wanted[i]:
                there = there or text.content(at, m)
                if own.content(int(self.at[j]), m) == there:
                    yield at, j
                j += 1


class Pass:
    """Items compiled for the search."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.names = [name for name, _ in items]
        self.words = Words([w for _, w in items])
        size = np.diff(self.words.off)
        self.groups = []
        for length in np.unique(np.minimum(size, WINDOW)).tolist():
            if length:
                own = np.flatnonzero(np.minimum(size, WINDOW) == length)
                n = size[own] - length + 1
                item = np.repeat(own, n)
                starts = np.repeat(self.words.off[own] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                self.groups.append(Patterns.compile(self.words, starts, item, length))

    def nbytes(self) -> int:
        w = self.words
        return sum(g.nbytes() for g in self.groups) + w.buf.nbytes + w.starts.nbytes + w.ends.nbytes + w.hash.nbytes

    def search(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """Hits (from, to) and names of items of each text; so many texts at once as have TOGETHER words, one at least."""
        out: list[tuple[list, set]] = [([], set()) for _ in texts]
        ends = np.cumsum([len(t) for t in texts])
        first = 0
        while first < len(texts):
            stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + TOGETHER, "right")))
            text = Words(texts[first:stop])
            windows: dict[int, set[tuple[int, int]]] = {}
            for k, g in enumerate(self.groups):
                for at, j in g.search(self.words, text):
                    i = int(np.searchsorted(text.off, at, "right")) - 1
                    a = at - int(text.off[i])
                    out[first + i][0].append((a, a + g.length))
                    windows.setdefault(i, set()).add((k, j))
            for i, found in windows.items():
                items = np.unique(np.concatenate([self.groups[k].item[self.groups[k].owner[j] : self.groups[k].owner[j + 1]] for k, j in found]))
                out[first + i][1].update(self.names[x] for x in items.tolist())
            first = stop
        return out


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def passes(benchmark: DataFrame, most: int = PASS_BYTES) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in passes of at most so many compiled bytes; an item that is longer is cut where its windows overlap. At least one pass, perhaps empty."""
    room = max(WINDOW, most // WORD_BYTES)
    held, size, given = [], 0, False
    for row in benchmark.select("item_id", "text").toLocalIterator():
        name, words = "" if row["item_id"] is None else str(row["item_id"]), words_of((row["text"] or "").encode())
        step = max(1, room - WINDOW + 1)
        for a in range(0, max(1, len(words) - WINDOW + 1), step):
            part = words[a : a + step + WINDOW - 1]
            if held and size + len(part) > room:
                yield held
                held, size, given = [], 0, True
            held.append((name, part))
            size += len(part)
    if held or not given:
        yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs (all its columns, or those in keep) with n_words, n_hit, n_items, items_sha256 and contaminated.

    One map over the documents for each pass of items, no shuffle; where there are several
    the hits of the earlier ones, one row for each text that has any, are joined to the
    documents for the last. Null or empty texts have no words and are not contaminated;
    items without words are no items; an item with a null id is named by the empty string,
    items of one id are one item. Columns of docs with a result's name are replaced.
    Repeated rows get the same result.
    """
    spark = docs.sparkSession
    names = [name for name, _ in RESULT]
    kept = [c for c in (keep or docs.columns) if c not in names]
    before, rest = None, passes(benchmark, pass_bytes)
    now = next(rest)
    while (coming := next(rest, None)) is not None:
        shipped = spark.sparkContext.broadcast(Pass(now))
        hits = stored(docs.select(text).mapInArrow(_finder(shipped), "__digest string, __hits array<bigint>, __items array<string>").dropDuplicates(["__digest"]), "hits")
        shipped.destroy()
        before = hits if before is None else before.union(hits)
        now = coming
    shipped = spark.sparkContext.broadcast(Pass(now))
    df = docs.select(*dict.fromkeys([*kept, text]))
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(n, t) for n, t in RESULT]])
    if before is not None:
        all_hits = before.groupBy("__digest").agg(F.flatten(F.collect_list("__hits")).alias("__hits"), F.flatten(F.collect_list("__items")).alias("__items"))
        df = df.withColumn("__d", F.md5(F.coalesce(F.col(text), F.lit("")))).join(all_hits, F.col("__d") == F.col("__digest"), "left").drop("__d", "__digest")
    return df.mapInArrow(_judge(shipped, text, kept), schema)


def _texts(batch: pa.RecordBatch, text: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.names.index(text)).cast(pa.large_binary()).to_pylist()]


def _finder(shipped):
    def run(batches):
        for batch in batches:
            texts = _texts(batch, batch.schema.names[0])
            found = [(hashlib.md5(t).hexdigest(), h, i) for t, (h, i) in zip(texts, shipped.value.search([words_of(t) for t in texts]), strict=True) if h]
            cols = [pa.array([d for d, _, _ in found], pa.string()), pa.array([[x for p in merged(h) for x in p] for _, h, _ in found], pa.list_(pa.int64())), pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["__digest", "__hits", "__items"])

    return run


def _judge(shipped, text: str, kept: list[str]):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            words = [words_of(t) for t in _texts(batch, text)]
            found = shipped.value.search(words)
            if "__hits" in names:
                for (hits, items), more, names_ in zip(found, batch.column(names.index("__hits")).to_pylist(), batch.column(names.index("__items")).to_pylist(), strict=True):
                    hits += zip((more or [])[::2], (more or [])[1::2], strict=True)
                    items |= set(names_ or [])
            n = [sum(b - a for a, b in merged(hits)) for hits, _ in found]
            cols = {c: batch.column(names.index(c)) for c in kept}
            cols["n_words"] = pa.array([len(w) for w in words], pa.int64())
            cols["n_hit"] = pa.array(n, pa.int64())
            cols["n_items"] = pa.array([len(i) for _, i in found], pa.int64())
            cols["items_sha256"] = pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for _, i in found], pa.string())
            cols["contaminated"] = pa.array([h > 0 and 20 * h >= len(w) for h, w in zip(n, words, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run
