"""The exchange of packed keys."""

import numpy as np
import pyarrow as pa

from heddle.llm import blocks as B


def keys(n, seed=0):
    return np.sort(np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64))


def test_keys_and_numbers_round_trip():
    for n in (0, 1, 2, 1000):
        k = keys(n)
        for parts in (1, 3, 1000):
            got = [B.unpack_keys(B.pack_keys(k[a:b], B.low_key(p, parts)), B.low_key(p, parts)) for p, a, b in B.cuts(k, parts)]
            assert np.array_equal(np.concatenate([np.zeros(0, np.uint64), *got]), k)
    k = np.repeat(np.array([0, 5, 2**64 - 1], np.uint64), 3)
    assert np.array_equal(B.unpack_keys(B.pack_keys(k, 0), 0), k)
    v = np.array([0, 1, 254, 255, 256, 2**40, 255], np.uint64)
    assert np.array_equal(B.unpack_numbers(B.pack_numbers(v), len(v)), v)
    assert len(B.pack_keys(keys(1 << 17), 0)) < 7.1 * (1 << 17)  # a byte less the more keys there are


def test_rows_and_replies():
    k = keys(5000)
    for parts in (1, 7, 900):
        rows = pa.Table.from_batches([B.entry_batch(4, parts, k, 2, n=np.arange(5000))])
        assert sum(rows["count"].to_pylist()) == 5000
        replies = {}
        for p in rows["part"].to_pylist():
            part = rows.filter(pa.compute.equal(rows["part"], p)).combine_chunks()
            own, lengths = B.keys_of(part, parts)
            assert (B.part_of(own, parts) == p).all()
            replies[2, p] = B.split(B.numbers_of(part) + np.uint64(1), lengths)[0]
        assert np.array_equal(B.aligned(k, parts, replies, 2), np.arange(5000) + 1)


def test_rows_do_not_shrink_with_the_corpus():
    k = keys(1 << 18)
    at = {total: B.entry_batch(0, B.parts_for(total, 0.03), k).num_rows for total in (10**9, 10**12, 10**14, 10**17)}
    assert at[10**14] == at[10**17] <= B.PARTS  # a row keeps its block's share of keys


def test_a_key_of_every_block_is_one_entry_of_each():
    hot = np.full(1000, 77, np.uint64)
    n = [len(B.cuts(np.unique(np.sort(np.append(hot, keys(10, s)))), 1)) for s in range(3)]
    assert n == [1, 1, 1]
    assert sum(B.entry_batch(0, 1, np.unique(hot))["count"].to_pylist()) == 1
