"""Repeated windows of a fixed length, over words (operator 4) or bytes (operator 9): seed and extend.

Seeds are winnowed anchors: of the k-grams in a window the one with the least hash, so equal
windows have equal anchors at equal offsets. In three exchanges of packed keys

1. anchors are counted; those that occur once anywhere end here,
2. occurrences of a repeated anchor are told apart by their context, which is all that the
   windows of this anchor cover, to the left and to the right: in equal contexts all windows
   are equal, so a class of copies is settled at once, whatever its size,
3. where an anchor has several contexts, one occurrence of each is sent with its content.
   All extensions of an anchor are found at once by sorting: its windows, each a suffix of
   a context cut at the window's length, are put in suffix order, ties by position, and
   neighbours are compared symbol by symbol. A run of neighbours with a common prefix of
   the whole length is a class of equal windows; what stands behind another member has its
   previous smaller position there.

What is left are the maximal runs of repeated windows.

An anchor of over CROWD contexts isn't brought into one task: its windows are dealt singly,
each by its own hash, once for a block.

Contexts, and windows of a crowded anchor, are taken for equal if 128 bits of hash agree (for
10 ** 12 of them the chance of any error is about 10 ** 24 / 2 ** 129, below 2e-15). All else
is compared symbol by symbol.

``any``: a window is repeated if it occurs anywhere else. ``earlier``: only if it occurs at
a smaller (doc_id, start); a null doc_id stands before all others, and rows with equal
doc_id are one place, so of them neither is the earlier at equal starts.

A block holds its texts whole: a text needs some ten times its size in a task's memory.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heddle.llm import blocks as B
from heddle.llm.shared import drop, stored

U64 = np.uint64
SEGMENT = 1 << 18
#: A kernel holds some arrays for the symbols of a block.
BLOCK_BYTES = 6 << 20
#: Contexts of an anchor that one task sorts together; windows that are sorted at once, where they are of several anchors.
CROWD, SORTED = 1 << 14, 1 << 19
NULL_ID = -(1 << 63)
MIXED, FIRST, CROWDED = 2, 4, 8


class Symbols:
    """A block's symbols. off: symbols before each text, then all."""

    off: np.ndarray

    def codes(self, a: int, b: int) -> np.ndarray:
        """64-bit codes of the symbols from a to b."""
        raise NotImplementedError

    def content(self, a: int, b: int) -> bytes:
        """The symbols from a to b themselves, as read() takes them."""
        raise NotImplementedError

    @staticmethod
    def read(body: bytes) -> np.ndarray:
        """Numbers that are equal where the symbols are, of all contents of a part together."""
        raise NotImplementedError


@dataclass
class Anchors:
    """Ascending by place: hash of the k-gram, where it is, first and last start of its windows."""

    key: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (w - size)], v[w - size :]) if w > size else v


def anchors(sym: Symbols, length: int, k: int) -> Anchors:
    n, w = int(sym.off[-1]), length - k + 1
    out: list[tuple] = []
    if n >= length:
        begin, stop = sym.off[:-1], sym.off[1:] - length + 1  # where windows start
        fits = stop > begin
        begin, stop = begin[fits], stop[fits]
        mask = U64((1 << 20) - 1)
        up, down = B.powers(SEGMENT + length + 1)
        for a in range(0, n - length + 1, SEGMENT):
            b = min(a + SEGMENT, n - length + 1)
            own = slice(int(np.searchsorted(stop, a, "right")), int(np.searchsorted(begin, b)))
            if own.start >= own.stop:
                continue
            edge = np.zeros(b - a + 1, np.int32)
            np.add.at(edge, np.maximum(begin[own] - a, 0), 1)
            np.add.at(edge, np.minimum(stop[own], b) - a, -1)
            ok = np.cumsum(edge[:-1]) > 0
            m = b - a + length - 1
            s = np.zeros(m + 1, np.uint64)
            np.cumsum(sym.codes(a, a + m) * up[:m], out=s[1:])
            g = B.mix((s[k:] - s[:-k]) * down[: m - k + 1])
            low = sliding_min((g & ~mask) | np.arange(len(g), dtype=np.uint64), w)
            p = (low & mask).astype(np.int64)
            new = np.ones(b - a, bool)
            new[1:] = (p[1:] != p[:-1]) | (ok[1:] != ok[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], b - a) - 1
            own = ok[first]
            lo, hi = first[own], last[own]
            at = p[lo]
            out.append((B.mix(g[at]), at + a, lo + a, hi + a))  # the least hashes are all small; keys should be spread
    if not out:
        return Anchors(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    return Anchors(*(np.concatenate(c) for c in zip(*out, strict=True)))


def range_keys(sym: Symbols, lo: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of the symbols from lo, which ascend, to stop."""
    out = np.empty(len(lo), np.uint64)
    i = 0
    while i < len(lo):
        a = int(lo[i])
        j = int(np.searchsorted(lo, a + SEGMENT))
        m = int(stop[i:j].max()) - a
        up, down = B.powers(m + 1)
        s = np.zeros(m + 1, np.uint64)
        np.cumsum(sym.codes(a, a + m) * up[:m], out=s[1:])
        out[i:j] = (s[stop[i:j] - a] - s[lo[i:j] - a]) * down[lo[i:j] - a]
        i = j
    return out


def window_keys(sym: Symbols, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows at starts, which ascend."""
    key, key2 = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(starts, a + SEGMENT))
        m = int(starts[j - 1]) - a + length
        rel = starts[i:j] - a
        for q, to in ((B._Q, key), (B._Q2, key2)):
            up, down = B.powers(m + 1, q)
            s = np.zeros(m + 1, np.uint64)
            np.cumsum(sym.codes(a, a + m) * up[:m], out=s[1:])
            to[i:j] = B.mix((s[rel + length] - s[rel]) * down[rel])
        i = j
    return key, key2


@dataclass
class Groups:
    """Occurrences grouped by (key, key2), in the order of the keys."""

    of: np.ndarray  # the group of each occurrence
    key: np.ndarray
    key2: np.ndarray
    n: np.ndarray
    pos: np.ndarray  # least position
    at: np.ndarray  # the occurrence there


def group(key: np.ndarray, key2: np.ndarray, pos: np.ndarray, n: np.ndarray) -> Groups:
    order = np.lexsort((pos, key2, key))
    k, k2 = key[order], key2[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
    first = np.flatnonzero(new)
    of = np.empty(len(k), np.int64)
    of[order] = np.cumsum(new) - 1
    total = np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)
    return Groups(of, k[first], k2[first], total, pos[order][first], order[first])


def spread(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of each, size numbers."""
    return np.repeat(lo - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum()) if len(lo) else np.zeros(0, np.int64)


def suffix_runs(symbols: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of starts, cut at length, ties as given; and whether each in that order has a common prefix of length with the one before."""
    wide = np.ndarray((len(symbols) - length + 1,), f"S{length * symbols.itemsize}", symbols, strides=(symbols.itemsize,))
    own = wide[starts]
    order = np.argsort(own, kind="stable")
    own = own[order]
    same = np.zeros(len(own), bool)
    same[1:] = own[1:] == own[:-1]
    return order, same


@dataclass
class Open:
    """Occurrences sent with their content, ascending by key: windows lo to lo + size - 1 each."""

    key: np.ndarray
    lo: np.ndarray
    size: np.ndarray
    pos: np.ndarray
    weight: np.ndarray


class Plan:
    """The kernels of one operator. Plans go to the executors, so they hold parameters only."""

    def __init__(self, symbols: Callable[[list[bytes]], Symbols], length: int, k: int, mode: str, text: str = "text", key: str = "doc_id", density: float = 0.03, crowd: int = CROWD):
        self.symbols, self.length, self.k, self.mode, self.text, self.key, self.density, self.crowd = symbols, length, k, mode, text, key, density, crowd
        self.parts = [1, 1, 1]

    # each step repeats the ones before it from the block and the replies

    def _ids(self, table: pa.Table) -> np.ndarray:
        return np.array([NULL_ID if i is None else i for i in table[self.key].to_pylist()], np.int64)

    def _one(self, table: pa.Table):
        sym = self.symbols(B.texts_of(table, self.text))
        anc = anchors(sym, self.length, self.k)
        keys, of, _ = B.distinct(anc.key)
        return sym, anc, keys, of, np.bincount(of, minlength=len(keys))

    def _pos(self, sym: Symbols, table: pa.Table, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of symbols as rank of the doc_id and start, in one number that ascends with both."""
        ids, rank = np.unique(self._ids(table), return_inverse=True)
        doc = np.searchsorted(sym.off, at, "right") - 1
        return (rank[doc].astype(np.int64) << 32) | (at - sym.off[doc]), ids

    def _two(self, table: pa.Table, replies):
        sym, anc, keys, of, _ = self._one(table)
        again = B.aligned(keys, self.parts[0], replies[0])[of] > 0 if len(keys) else np.zeros(0, bool)
        anc = Anchors(anc.key[again], anc.at[again], anc.lo[again], anc.hi[again])
        pos, ids = self._pos(sym, table, anc.lo)
        ctx = B.mix(range_keys(sym, anc.lo, anc.hi + self.length) + (anc.at - anc.lo).astype(np.uint64) * U64(B._Q2) + (anc.hi - anc.lo).astype(np.uint64) * U64(0x2545F4914F6CDD1D))
        return sym, anc, pos, ids, group(anc.key, ctx, pos, np.ones(len(pos), np.int64))

    def _three(self, table: pa.Table, replies):
        """sym, whole ranges found (lo, hi), ids, what is open, and the single windows of crowded anchors with their groups."""
        sym, anc, pos, ids, g = self._two(table, replies)
        bits = B.aligned(g.key, self.parts[1], replies[1])[g.of] if len(g.key) else np.zeros(0, np.uint64)
        has = lambda bit: (bits & U64(bit)) > 0
        dup, mixed = has(1), has(MIXED)
        if self.mode == "any":
            whole = dup
            first = np.zeros(len(pos), bool)
            first[g.at] = True
            open_ = mixed & (~dup | (has(FIRST) & first))
        else:
            whole = (pos != g.pos[g.of]) | dup
            open_ = mixed & ~whole
        size, weight = anc.hi - anc.lo + 1, np.where(whole, 2, 1)
        own = np.flatnonzero(open_ & ~has(CROWDED))
        own = own[np.argsort(anc.key[own], kind="stable")]
        near = Open(anc.key[own], anc.lo[own], size[own], pos[own], weight[own])

        own = np.flatnonzero(open_ & has(CROWDED))
        own = own[np.argsort(anc.lo[own])]
        starts = spread(anc.lo[own], size[own])
        key, key2 = window_keys(sym, starts, self.length)
        wpos, _ = self._pos(sym, table, starts)
        w = group(key, key2, wpos, np.repeat(weight[own], size[own]))
        return sym, (anc.lo[whole], anc.hi[whole]), ids, near, starts, wpos, w

    def send_one(self, block, table, replies):
        _, _, keys, _, n = self._one(table)
        yield B.entry_batch(block, self.parts[0], keys, n=np.minimum(n, 2))

    def _place(self, g: Groups, ids: np.ndarray) -> dict[str, np.ndarray]:
        return {"n": np.minimum(g.n, 2)} if self.mode == "any" else {"doc": ids[g.pos >> 32], "start": (g.pos & 0xFFFFFFFF).astype(np.uint32)}

    def send_two(self, block, table, replies):
        _, _, _, ids, g = self._two(table, replies)
        yield B.entry_batch(block, self.parts[1], g.key, key2=g.key2, **self._place(g, ids))

    def send_three(self, block, table, replies):
        sym, _, ids, near, *_, w = self._three(table, replies)
        stop = near.lo + near.size + self.length - 1
        body = lambda a, b: b"".join(sym.content(x, y) for x, y in zip(near.lo[a:b].tolist(), stop[a:b].tolist(), strict=True))
        place = {"key2": near.weight.astype(np.uint8)} if self.mode == "any" else {"doc": ids[near.pos >> 32], "start": (near.pos & 0xFFFFFFFF).astype(np.uint32)}
        yield B.entry_batch(block, self.parts[2], near.key, n=near.size, body=body, **place)
        yield B.entry_batch(block, self.parts[2], w.key, 1, key2=w.key2, **self._place(w, ids))

    def _windows(self, o: Open, replies: dict) -> np.ndarray:
        """Whether the windows of o are repeated."""
        got = [np.unpackbits(np.frombuffer(replies[0, p], np.uint8), count=int(o.size[a:b].sum())) for p, a, b in B.cuts(o.key, self.parts[2])]
        return np.concatenate(got).astype(bool) if got else np.zeros(0, bool)

    def covered(self, table: pa.Table, replies) -> tuple[Symbols, np.ndarray]:
        """The block's symbols and which of them a repeated window covers."""
        sym, (lo, hi), _, near, starts, wpos, w = self._three(table, replies)
        found = spread(near.lo, near.size)[self._windows(near, replies[2])]
        if len(starts):
            dup = (B.aligned(w.key, self.parts[2], replies[2], 1) & U64(1) > 0)[w.of]
            if self.mode == "earlier":
                dup |= wpos > w.pos[w.of]
            found = np.append(found, starts[dup])
        edge = np.zeros(int(sym.off[-1]) + 1, np.int32)
        np.add.at(edge, np.append(lo, found), 1)
        np.add.at(edge, np.append(hi, found) + self.length, -1)
        return sym, np.cumsum(edge[:-1], dtype=np.int32) > 0

    # reducers

    def count(self, table: pa.Table) -> list[bytes]:
        key, lengths = B.keys_of(table, self.parts[0])
        _, of, _ = B.distinct(key)
        total = np.bincount(of, B.numbers_of(table))
        return B.split((total[of] >= 2).astype(np.uint8), lengths)

    def _places(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return B.array_of(table, "doc", np.int64), B.array_of(table, "start", np.uint32)

    def contexts(self, table: pa.Table) -> list[bytes]:
        return self._classes(table, self.parts[1])

    def _classes(self, table: pa.Table, parts: int) -> list[bytes]:
        """For each entry whether its class (key, key2) occurs elsewhere, or earlier; whether its key has other classes; whether it stands for its class."""
        key, lengths = B.keys_of(table, parts)
        key2 = B.array_of(table, "key2", np.uint64)
        if self.mode == "any":
            order = np.lexsort((key2, key))
        else:
            doc, start = self._places(table)
            order = np.lexsort((start, doc, key2, key))
        k, k2 = key[order], key2[order]
        newk = np.ones(len(k), bool)
        newk[1:] = k[1:] != k[:-1]
        new = newk.copy()
        new[1:] |= k2[1:] != k2[:-1]
        first = np.flatnonzero(new)
        of, of_key = np.cumsum(new) - 1, np.cumsum(newk) - 1
        several = np.bincount(of_key[first])[of_key]
        bits = np.where(several > 1, MIXED, 0) | np.where(several > self.crowd, CROWDED, 0)
        if self.mode == "any":
            total = np.add.reduceat(B.numbers_of(table)[order].astype(np.int64), first)
            bits |= total[of] >= 2
            bits[first] |= FIRST
        else:
            d, s = doc[order], start[order]
            bits |= (d != d[first][of]) | (s != s[first][of])
        out = np.empty(len(k), np.uint8)
        out[order] = bits
        return B.split(out, lengths)

    def extensions(self, table: pa.Table) -> list[bytes]:
        if table["kind"][0].as_py():
            return self._classes(table, self.parts[2])
        key, lengths = B.keys_of(table, self.parts[2])
        size = B.numbers_of(table).astype(np.int64)
        symbols = self.symbols.read(b"".join(table["body"].to_pylist()))
        begin = np.append(0, np.cumsum(size + self.length - 1)[:-1])
        bit_at = np.append(0, np.cumsum(size))
        if self.mode == "any":
            weight = B.array_of(table, "key2", np.uint8).astype(np.int64)
            order = np.argsort(key, kind="stable")
        else:
            doc, start = self._places(table)
            order = np.argsort(key, kind="stable")
        found = np.zeros(int(bit_at[-1]), bool)
        edges = np.append(np.flatnonzero(np.diff(key[order], prepend=key[order][:1] + U64(1))), len(order))
        ends = np.append(0, np.cumsum(size[order]))
        at = 0
        while at < len(edges) - 1:
            # the anchors that are sorted together: some, or one that has more windows than that
            to = max(at + 1, int(np.searchsorted(ends[edges], ends[edges[at]] + SORTED, "right")) - 1)
            own = order[edges[at] : edges[to]]
            of = np.repeat(own, size[own])
            shift = spread(np.zeros(len(own), np.int64), size[own])
            if self.mode == "earlier":
                place = doc[of], start[of].astype(np.int64) + shift
                by = np.lexsort(place[::-1])
                of, shift, place = of[by], shift[by], (place[0][by], place[1][by])
            sa, same = suffix_runs(symbols, begin[of] + shift, self.length)
            first = np.flatnonzero(~same)
            run = np.cumsum(~same) - 1
            if self.mode == "any":
                hit = np.add.reduceat(weight[of][sa], first)[run] >= 2
            else:
                # a run stands in the order of positions: what isn't its least has its previous smaller position in it
                d, s = place[0][sa], place[1][sa]
                hit = (d != d[first][run]) | (s != s[first][run])
            found[(bit_at[of] + shift)[sa]] = hit
            at = to
        ends = bit_at[np.append(0, np.cumsum(lengths))]
        return [np.packbits(found[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def find(docs: DataFrame, plan: Plan, finish, schema, what: str) -> DataFrame:
    """finish(table, symbols, covered) -> RecordBatch for each block of docs, in rows of schema; stored."""
    index = B.pack(docs, plan.text, BLOCK_BYTES)
    parts = B.parts_for(B.total_bytes(index), plan.density)
    plan.parts = [parts, parts, min(B.PARTS, 4 * parts)]  # the last one's entries carry content
    one = B.exchange(B.kernel(index, plan.send_one, B.ENTRIES), plan.count, "anchors", parts)
    two = B.exchange(B.kernel(index, plan.send_two, B.ENTRIES, one), plan.contexts, "contexts", parts)
    three = B.exchange(B.kernel(index, plan.send_three, B.ENTRIES, one, two), plan.extensions, "extensions", plan.parts[2])

    def last(block, table, replies):
        yield finish(table, *plan.covered(table, replies))

    out = stored(B.kernel(index, last, schema, one, two, three), what)
    for replies in (one, two, three):
        drop(replies)
    B.drop_blocks(index)
    return out
