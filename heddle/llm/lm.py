"""LM scoring (operator 8): a weighted backoff automaton over words, of order three.

Counts of all n-grams of one to three tokens of the training documents are summed by
exchanges of packed keys (heddle.llm.blocks), one for each order: each block sends its
distinct n-grams with their training counts and gets the corpus counts of the same n-grams
back, and whether another block has them. An n-gram whose first or last n - 1 tokens no
other block has can't be in one either, so its own counts are the corpus's and it isn't
sent. From the counts a block builds the part of the automaton that its own texts can
reach, exactly; nothing of the model is broadcast, nothing is pruned.

States are the root, and each history seen in training: a word, the start of a text, or
two tokens of either kind. Smoothing is Dirichlet's, each order with the next lower one as
its prior:

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w|v)   = (c(v w) + K2 p(w)) / (c(v) + K2)
    p(w|u v) = (c(u v w) + K3 p(w|v)) / (c(u v) + K3)

A seen n-gram is an arc from its history's state, of weight log10 p, to the state of its
own last two tokens. Where a state has no arc for a token its failure arc leads to the
state of one token less, of weight log10(K / (c(history) + K)); the root has an arc for
every token. Texts are read from left to right with the state carried along (traverse).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm import blocks as B
from heddle.llm.shared import drop, stored

U64 = np.uint64
#: Weights of the priors: K2 and K3.
KAPPA = (2000.0, 5.0)
FOLDS, HELD = 7, 2
BLOCK_BYTES = 6 << 20
#: Tokens that a traversal reads one after the other; longer texts are read in several lanes.
LANE = 512
#: Codes of the end token and of the start, as a history.
END, START = U64(0x0123456789ABCDE1), U64(0xFEDCBA9876543217)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
RESULT = [("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


@dataclass
class Order:
    """Distinct n-grams of one order, ascending by key: their training counts in the block, one token where each ends, and the n-gram that ends at each token (-1: none)."""

    key: np.ndarray
    n: np.ndarray
    at: np.ndarray
    of: np.ndarray


class Grams:
    """Tokens of a block's texts and its n-grams up to some order. Tokens are numbered by their place in orders[0]; the start of a text is one as well."""

    def __init__(self, table: pa.Table, text: str, key: str, most: int = 3):
        self.ids = table[key].to_pylist()
        texts = [t.translate(_LOWER) for t in B.texts_of(table, text)]
        buf, starts, ends, off = B.tokens(texts)
        words = B.word_hashes(buf, starts, ends)
        del buf, starts, ends
        size = np.diff(off) + 1  # and the end
        self.off = np.append(0, np.cumsum(size))
        n = int(self.off[-1])
        last = np.zeros(n, bool)
        last[self.off[1:] - 1] = True
        token = np.empty(n, np.uint64)
        token[last] = END
        token[~last] = words
        first = self.off[:-1]
        self.held = np.array([held_out(i) for i in self.ids], bool)
        train = np.repeat(~self.held, size)
        self.first = np.zeros(n, bool)
        self.first[first] = True
        self.orders = [self._order(B.mix(np.append(token, START)), train)]
        self.start = int(self.orders[0].of[-1])
        self.orders[0].of = self.orders[0].of[:-1]
        self.orders[0].n[self.start] = (~self.held).sum()
        if most > 1:
            history = np.empty_like(token)
            history[1:] = token[:-1]
            history[first] = START
            pair = B.mix(history * U64(B._Q) + token)
            del history
            self.orders.append(self._order(pair, train))
        if most > 2:
            triple = np.empty_like(pair)
            triple[1:] = B.mix(pair[:-1] * U64(B._Q2) + token[1:])
            self.orders.append(self._order(triple, train, np.flatnonzero(~self.first)))

    @staticmethod
    def _order(keys: np.ndarray, train: np.ndarray, own: np.ndarray | None = None) -> Order:
        key, of, at = B.distinct(keys if own is None else keys[own])
        counted = of[: len(train)][train] if own is None else of[train[own]]
        n = np.bincount(counted, minlength=len(key))
        if own is not None:
            at, inner = own[at], of
            of = np.full(len(keys), -1, np.int32)
            of[own] = inner
        return Order(key, n, at.astype(np.int32), of.astype(np.int32))

    def parts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each n-gram of orders[k] the numbers of its first k tokens and of its last k."""
        at, low = self.orders[k].at, self.orders[k - 1].of
        if k == 1:
            return np.where(self.first[at], self.start, low[at - 1]), low[at]
        return low[at - 1], low[at]

    def resolve(self, parts: int, replies: list[dict]) -> tuple[list[np.ndarray], np.ndarray | None]:
        """The corpus counts of the orders that replies are of, and which n-grams of the next order another block may have."""
        counts, sent = [], np.ones(len(self.orders[0].key), bool)
        for k, (o, got) in enumerate(zip(self.orders, replies, strict=False)):
            count, shared = o.n.copy(), np.zeros(len(o.key), bool)
            reply = B.aligned(o.key[sent], parts, got)
            count[sent], shared[sent] = reply >> U64(1), reply & U64(1) > 0
            counts.append(count.astype(np.float64))
            sent = None
            if k + 1 < len(self.orders):
                before, after = self.parts(k + 1)
                sent = shared[before] & shared[after]
        return counts, sent


@dataclass
class Automaton:
    """Arcs: source, token, weight, target. For each state its failure arc's weight and target, and its depth, the tokens that it remembers. State 0 is the root, start the state before a text.

    at: for each token of the block and each depth the arc that a state of this depth, if
    the text leads there, has for the token; -1 if none.
    """

    source: np.ndarray
    token: np.ndarray
    weight: np.ndarray
    target: np.ndarray
    fail_weight: np.ndarray
    fail: np.ndarray
    depth: np.ndarray
    start: int
    at: np.ndarray


def build(g: Grams, counts: list[np.ndarray], tokens: float, types: float, kappa: tuple[float, float]) -> Automaton:
    """The automaton of the n-grams of g, given their corpus counts."""
    one, two, three = g.orders
    c1, c2, c3 = counts
    end = _number_of(one, B.mix(np.array([END])))
    # states: the root, then words, then pairs, where they are histories
    history1 = c1 > 0
    if end >= 0:
        history1[end] = False
    state1 = np.where(history1, np.cumsum(history1), 0).astype(np.int64)
    before2, word2 = g.parts(1)
    history2 = (c2 > 0) & (word2 != end)
    state2 = np.where(history2, np.cumsum(history2) + history1.sum(), state1[word2]).astype(np.int64)
    p1 = (c1 + 1) / (tokens + types + 1)
    p2 = (c2 + kappa[0] * p1[word2]) / (c1[before2] + kappa[0])
    before3, two3 = g.parts(2)
    p3 = (c3 + kappa[1] * p2[two3]) / (c2[before3] + kappa[1])
    seen1 = np.arange(len(c1)) != g.start  # the start is no token, all others have an arc of the root
    seen2, seen3 = c2 > 0, c3 > 0
    source = [np.zeros(seen1.sum(), np.int64), state1[before2[seen2]], state2[before3[seen3]]]
    token = [np.flatnonzero(seen1), word2[seen2], one.of[three.at[seen3]]]
    weight = [np.log10(p1[seen1]), np.log10(p2[seen2]), np.log10(p3[seen3])]
    target = [state1[seen1], state2[seen2], state2[two3[seen3]]]
    at, base = [], 0
    for o, seen in ((one, seen1), (two, seen2), (three, seen3)):
        arc = np.append(np.where(seen, np.cumsum(seen) - 1 + base, -1), -1)  # the last one for where no n-gram ends
        at.append(arc[o.of].astype(np.int32))
        base += int(seen.sum())
    fail_weight = np.concatenate([[0.0], np.log10(kappa[0] / (c1[history1] + kappa[0])), np.log10(kappa[1] / (c2[history2] + kappa[1]))])
    fail = np.concatenate([np.zeros(1 + history1.sum(), np.int64), state1[word2[history2]]])
    depth = np.repeat(np.array([0, 1, 2], np.int8), [1, history1.sum(), history2.sum()])
    return Automaton(np.concatenate(source), np.concatenate(token), np.concatenate(weight), np.concatenate(target), fail_weight, fail, depth, int(state1[g.start]), np.stack(at))


def _number_of(order: Order, key: np.ndarray) -> int:
    i = int(np.searchsorted(order.key, key)[0])
    return i if i < len(order.key) and order.key[i] == key[0] else -1


def traverse(a: Automaton, off: np.ndarray, lane: int = LANE) -> np.ndarray:
    """The log10 weight of each token, read from left to right, texts side by side.

    A longer text is read in lanes. A lane but a text's first starts two tokens early at the
    root, which brings it to the state that the lane before it ends in: no state remembers
    more than two tokens, and each is the longest history that the automaton has.
    """
    out = np.zeros(a.at.shape[1])
    size = np.diff(off)
    lanes = -(-size // lane)
    text = np.repeat(np.arange(len(size)), lanes)
    number = np.arange(len(text)) - np.repeat(np.append(0, np.cumsum(lanes)[:-1]), lanes)
    begin = off[:-1][text] + number * lane
    stop = np.minimum(begin + lane, off[1:][text])
    warm = np.where(number > 0, np.minimum(2, number * lane), 0)
    order = np.argsort(-(stop - begin + warm), kind="stable")
    begin, stop, warm = begin[order], stop[order], warm[order]
    state = np.where(warm > 0, 0, a.start)
    at, length = begin - warm, stop - begin + warm
    for step in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -step, "left"))  # lanes longer than step
        here = state[:live].copy()
        place = at[:live] + step
        total = np.zeros(live)
        arc = a.at[a.depth[here], place]
        todo = np.flatnonzero(arc < 0)
        while len(todo):
            total[todo] += a.fail_weight[here[todo]]
            here[todo] = a.fail[here[todo]]
            arc[todo] = a.at[a.depth[here[todo]], place[todo]]
            todo = todo[arc[todo] < 0]
        state[:live] = a.target[arc]
        counted = step >= warm[:live]
        out[place[counted]] = (total + a.weight[arc])[counted]
    return out


def sums(parts: int):
    def run(table: pa.Table) -> list[bytes]:
        """Twice the sum of a key's counts, and one more if several blocks have it."""
        key, lengths = B.keys_of(table, parts)
        _, of, _ = B.distinct(key)
        total = np.bincount(of, B.numbers_of(table)).astype(np.uint64)  # sums below 2 ** 53 are exact
        return B.split((total * U64(2) + (np.bincount(of) > 1))[of], lengths)

    return run


def word_totals(parts: int):
    def run(table: pa.Table) -> bytes:
        """A part's training tokens and types of words, as two big-endian numbers."""
        key, _ = B.keys_of(table, parts)
        n = B.numbers_of(table)
        own = (n > 0) & (key != B.mix(np.array([START]))[0])
        return np.array([n[own].sum(dtype=np.uint64), len(np.unique(key[own]))], ">u8").tobytes()

    return run


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", kappa: tuple[float, float] = KAPPA) -> DataFrame:
    """doc_id with held_out, n_tokens, n_known, train_tokens, base_score and score, one row for each row of docs.

    Null texts are empty: their only token is the end. A null doc_id counts as the empty
    text in the choice of folds, so it trains. Repeated rows are counted each. Without any
    training document N = V = 0 and every score is 0. Other columns are left behind. Words
    and n-grams are told apart by 64 bits of hash: of n distinct ones about n * n / 2 ** 65
    pairs are taken for each other. A block holds its texts whole, so a text must fit into
    a task's memory some 60 times.
    """
    docs = docs.select(key, text)
    index = B.pack(docs, text, BLOCK_BYTES)
    parts = B.parts_for(B.total_bytes(index), 0.12)
    counts: list[DataFrame] = []
    for most in (1, 2, 3):

        def send(block, table, replies, most=most):
            g = Grams(table, text, key, most)
            _, sent = g.resolve(parts, replies)
            o = g.orders[-1]
            yield B.entry_batch(block, parts, o.key[sent], n=o.n[sent])

        counts.append(B.exchange(B.kernel(index, send, B.ENTRIES, *[c.filter("block >= 0") for c in counts]), sums(parts), "ngrams", parts, totals=word_totals(parts) if most == 1 else None))
    both = counts[0].filter("block < 0").select(*[F.conv(F.hex(F.substring("reply", 1 + 8 * i, 8)), 16, 10).cast("long").alias(n) for i, n in enumerate(("tokens", "types"))])
    tokens, types = (int(x or 0) for x in both.agg(F.sum("tokens"), F.sum("types")).first())
    schema = T.StructType([docs.schema[key], *[T.StructField(n, t) for n, t in RESULT]])

    def finish(block, table, replies):
        g = Grams(table, text, key)
        c, _ = g.resolve(parts, replies)
        token, at = g.orders[0].of, g.off[:-1]
        base = np.log10((c[0] + 1) / (tokens + types + 1))[token]
        known = (c[0] > 0)[token]
        step = traverse(build(g, c, tokens, types, kappa), g.off)
        total = lambda v: np.add.reduceat(v, at) if len(at) else np.zeros(0)
        cols = {
            key: table[key].combine_chunks(),
            "held_out": pa.array(g.held),
            "n_tokens": pa.array(np.diff(g.off)),
            "n_known": pa.array(total(known.astype(np.int64)).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(at), tokens)),
            "base_score": pa.array(total(base)),
            "score": pa.array(total(step)),
        }
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    out = stored(B.kernel(index, finish, schema, *[c.filter("block >= 0") for c in counts]), "scores")
    for c in counts:
        drop(c)
    B.drop_blocks(index)
    return out
