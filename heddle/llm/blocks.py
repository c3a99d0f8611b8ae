"""Blocks of rows kept in the shared folder, and the exchange of packed keys between them.

Operators that compare every position of every text would shuffle many times the input.
Here rows are packed into blocks of some megabytes, once. A kernel reads a block, merges
its keys (64-bit hashes) into distinct ones with values, and sends them in ascending order,
one binary row for each part of the key space. Keys are stored as gaps of as many bytes as
the largest needs, numbers as one byte with an escape. A part's reducer sees a key once for
each block that has it, and answers each block in the order of the keys sent. So a key that
fills a third of the corpus costs one entry for each block, and the JVM moves few, large
rows. There are at most PARTS parts, so a row doesn't shrink below its block's share of
them however large the corpus; beyond that a part, which a task holds whole, grows.

A block is read where it is needed through its place in the index (file, offset, length);
a kernel that is run again reads the same bytes. What is stored is deleted when it has been
read for the last time (drop_blocks, shared.drop), and shuffle files go as soon as their job is done.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.shared import discard, drop, scratch, stored
from heddle.llm.warc import open_fs

INDEX = "block long, file string, offset long, length long, bytes long"
ENTRIES = "kind int, part int, block long, count int, key binary, key2 binary, n binary, doc binary, start binary, body binary"
REPLIES = "block long, kind int, part int, reply binary"
BLOCK_BYTES = 8 << 20
#: Entries that a part should have, and most parts.
PART_ENTRIES, PARTS = 1 << 19, 1 << 16
U64 = np.uint64


def tidy() -> None:
    """Give memory that is free back to the system: a worker is kept from task to task, and an executor has several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pack(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write docs (all columns) as blocks of about block_bytes of text; the index, stored. A longer row has a block of its own."""
    folder = scratch(docs.sparkSession, "blocks")

    def run(batches):
        where, base = open_fs(folder)
        where.create_dir(base, recursive=True)
        held, size, out, at, rows = [], 0, None, 0, []
        name = f"part-{uuid.uuid4().hex}"

        def put():
            nonlocal held, size, at, out
            if not held:
                return
            if out is None:
                out = where.open_output_stream(f"{base}/{name}", compression=None)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in held:
                    w.write_batch(b)
            body = sink.getvalue()
            out.write(body)
            rows.append((int.from_bytes(os.urandom(8)) >> 1, f"{folder}/{name}", at, body.size, size))
            at += body.size
            held, size = [], 0
            del sink, body
            tidy()

        for batch in batches:
            if not batch.num_rows:
                continue
            n = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(text))), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(n.astype(np.int64))
            start = 0
            while start < len(ends):
                room = block_bytes - size
                stop = max(start + (not held), int(np.searchsorted(ends, (ends[start - 1] if start else 0) + room, "right")))
                if stop > start:
                    held.append(batch.slice(start, stop - start))
                    size += int(ends[stop - 1] - (ends[start - 1] if start else 0))
                    start = stop
                if size >= block_bytes or start < len(ends):
                    put()
        put()
        if out is not None:
            out.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 1 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=[c.split()[0] for c in INDEX.split(", ")])

    index = stored(docs.mapInArrow(run, INDEX), "block-index")
    index.blocks_at = folder
    return index


def drop_blocks(index: DataFrame) -> None:
    """Delete the blocks and their index, when nothing reads them any more."""
    discard(index.sparkSession, index.blocks_at)
    drop(index)


def fetch(file: str, offset: int, length: int) -> pa.Table:
    where, path = open_fs(file)
    with where.open_input_file(path) as f:
        return pa.ipc.open_stream(f.read_at(length, offset)).read_all()


def kernel(index: DataFrame, run: Callable[..., Iterator[pa.RecordBatch]], schema, *replies: DataFrame) -> DataFrame:
    """run(block, table, [{(kind, part): bytes} of each reply table]) for each block.

    A block's replies are as large as its own keys. They and the index are dealt by block,
    once, into so many tasks that each has few blocks, whatever their size in bytes.
    """
    tasks, n_replies = max(1, min(index.count(), 1 << 16)), len(replies)
    index = index.repartition(tasks, "block")
    for i, r in enumerate(replies):
        own = r.repartition(tasks, "block").groupBy(F.col("block").alias("__b")).agg(F.collect_list(F.struct("kind", "part", "reply")).alias(f"replies{i}"))
        index = index.join(own, F.col("block") == F.col("__b"), "left").drop("__b")

    def each(batches):
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {n: batch.column(names.index(n))[i] for n in names}
                table = fetch(row["file"].as_py(), row["offset"].as_py(), row["length"].as_py())
                cells = [row[f"replies{k}"] for k in range(n_replies)]
                got = [{(x["kind"].as_py(), x["part"].as_py()): x["reply"].as_py() for x in (c if c.is_valid else [])} for c in cells]
                yield from run(row["block"].as_py(), table, got)
                del table, got, cells, row
                tidy()

    return index.mapInArrow(each, schema)


def total_bytes(index: DataFrame) -> int:
    return index.agg(F.sum("bytes")).first()[0] or 0


def parts_for(total: int, entries_per_byte: float) -> int:
    return max(1, min(PARTS, int(total * entries_per_byte / PART_ENTRIES) + 1))


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Monotone in the key, so sorted keys are sorted by part."""
    return ((key >> U64(32)) * U64(parts)) >> U64(32)


def low_key(part: int, parts: int) -> int:
    """The least key of a part."""
    return -(-(part << 32) // parts) << 32


def pack_keys(key: np.ndarray, low: int) -> bytes:
    """Ascending keys as gaps from low on, after one byte for the width of a gap."""
    if not len(key):
        return b""
    gap = key.copy()
    gap[1:] -= key[:-1]
    gap[0] -= U64(low)
    width = max(1, (int(gap.max()).bit_length() + 7) // 8)
    return bytes([width]) + gap.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(packed: bytes, low: int) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.uint64)
    width = packed[0]
    own = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    gap = np.zeros((len(own), 8), np.uint8)
    gap[:, :width] = own
    gap = gap.view(np.uint64).ravel()
    gap[0] += U64(low)
    return np.cumsum(gap, dtype=np.uint64)


def pack_numbers(n: np.ndarray) -> bytes:
    """Numbers as bytes; those from 255 on as 255, and whole at the end."""
    large = n >= 255
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[large].astype(np.uint64).tobytes()


def unpack_numbers(packed: bytes, count: int) -> np.ndarray:
    n = np.frombuffer(packed, np.uint8, count).astype(np.uint64)
    if len(packed) > count:
        n[n == 255] = np.frombuffer(packed[count:], np.uint64)
    return n


def cuts(key: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) for each part that ascending keys have."""
    part = part_of(key, parts)
    first = np.flatnonzero(np.diff(part, prepend=part[:1] + U64(1))) if len(key) else np.zeros(0, int)
    return list(zip(part[first].tolist(), first.tolist(), [*first[1:].tolist(), len(key)], strict=True)) if len(first) else []


def entry_batch(block: int, parts: int, key: np.ndarray, kind: int = 0, **values) -> pa.RecordBatch:
    """Rows of ENTRIES for keys in ascending order. n are numbers, body a function (from, to) -> bytes, the others arrays."""
    where = cuts(key, parts)
    size = len(where)
    cols = {"kind": pa.array([kind] * size, pa.int32()), "part": pa.array([p for p, _, _ in where], pa.int32()), "block": pa.array([block] * size, pa.int64()), "count": pa.array([b - a for _, a, b in where], pa.int32())}
    cols["key"] = pa.array([pack_keys(key[a:b], low_key(p, parts)) for p, a, b in where], pa.binary())
    for name in ("key2", "n", "doc", "start", "body"):
        v = values.get(name)
        put = (lambda a, b: None) if v is None else v if callable(v) else (lambda a, b, v=v: pack_numbers(v[a:b])) if name == "n" else (lambda a, b, v=v: v[a:b].tobytes())
        cols[name] = pa.array([put(a, b) for _, a, b in where], pa.binary())
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def aligned(key: np.ndarray, parts: int, replies: dict, kind: int = 0) -> np.ndarray:
    """The replies to entry_batch(key, kind), in its order."""
    got = [unpack_numbers(replies[kind, p], b - a) for p, a, b in cuts(key, parts)]
    return np.concatenate(got) if got else np.zeros(0, np.uint64)


def exchange(entries: DataFrame, reducer: Callable[[pa.Table], list[bytes]], what: str, parts: int, totals: Callable[[pa.Table], bytes] | None = None) -> DataFrame:
    """REPLIES, stored: reducer gets the rows of a kind and part and returns a reply for each; totals gives one more for them, of block -1."""

    def run(table: pa.Table) -> pa.Table:
        tidy()
        table = table.combine_chunks()
        replies = reducer(table)
        cols = [table[c].combine_chunks() for c in ("block", "kind", "part")]
        if totals:
            replies = [*replies, totals(table)]
            cols = [pa.concat_arrays([c, pa.array([-1], pa.int64()) if i == 0 else c[:1]]) for i, c in enumerate(cols)]
        return pa.table({**dict(zip(("block", "kind", "part"), cols, strict=True)), "reply": pa.array(replies, pa.binary())})

    # so many tasks: small parts may be a lot of work, which their bytes don't show
    return stored(entries.repartition(parts, "kind", "part").groupBy("kind", "part").applyInArrow(run, REPLIES), what)


def keys_of(table: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a part's rows, one row after the other, and how many each has."""
    lengths = table["count"].to_numpy().astype(np.int64)
    low = low_key(table["part"][0].as_py(), parts) if len(lengths) else 0
    own = [unpack_keys(x.as_py(), low) for x in table["key"].combine_chunks()]
    return (np.concatenate(own) if own else np.zeros(0, np.uint64)), lengths


def numbers_of(table: pa.Table, name: str = "n") -> np.ndarray:
    own = [unpack_numbers(x.as_py(), k) for x, k in zip(table[name].combine_chunks(), table["count"].to_pylist(), strict=True)]
    return np.concatenate(own) if own else np.zeros(0, np.uint64)


def array_of(table: pa.Table, name: str, dtype) -> np.ndarray:
    own = [np.frombuffer(x.as_buffer(), dtype) for x in table[name].combine_chunks()]
    return np.concatenate(own) if own else np.zeros(0, dtype)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, ascending, the number of each key's own one, and where one of each is. Faster than np.unique, whose inverse needs a stable sort."""
    order = np.argsort(keys)
    own = keys[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    of = np.empty(len(own), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return own[new], of, order[new]


def split(values: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Replies: the numbers of each row."""
    ends = np.cumsum(lengths)
    return [pack_numbers(values[e - n : e]) for e, n in zip(ends, lengths, strict=True)]


# hashing

_Q = 0x9E3779B97F4A7C15 | 1
_Q2 = 0xD1342543DE82EF95
_TABLE = np.random.Generator(np.random.PCG64(20240517)).integers(0, 2**64, 256, dtype=np.uint64)
_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, q: int = _Q) -> tuple[np.ndarray, np.ndarray]:
    """q ** i and q ** -i modulo 2 ** 64, for i < n at least."""
    if q not in _cache or len(_cache[q][0]) < n:
        size = max(n, 1 << 19)
        up = np.full(size, q, np.uint64)
        down = np.full(size, pow(q, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _cache[q] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _cache[q]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xA0761D6478BD642F)
    h ^= h >> U64(32)
    return h


def texts_of(table: pa.Table, text: str = "text") -> list[bytes]:
    return [b"" if x is None else x for x in table[text].cast(pa.large_binary()).to_pylist()]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """buf (the texts with a space after each), starts and ends of its words, and off: words before each text, then all."""
    buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8) if texts else np.zeros(0, np.uint8)
    word = np.zeros(len(buf) + 1, np.int8)
    word[:-1] = ~_SPACE[buf]
    d = np.diff(word, prepend=np.int8(0))
    starts, ends = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)]) if texts else np.zeros(1, np.int64)
    return buf, starts, ends, np.searchsorted(starts, edges)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + chunk, "right")))
        n = int(ends[j - 1] - a)
        up, down = powers(n + 1)
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[buf[a : a + n]] * up[:n], out=s[1:])
        lo, hi = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((s[hi] - s[lo]) * down[lo] + (hi - lo).astype(np.uint64) * U64(_Q2))
        i = j
    return out


def byte_codes(buf: np.ndarray) -> np.ndarray:
    return _TABLE[buf]
