"""Suffix-array dedup (operator 9) over the bytes of all texts.

A byte goes if a string of 100 bytes covers it that also starts earlier. That is so where
the longest previous factor (LPF) of a position reaches 100: its previous or next smaller
position in suffix order shares 100 bytes with it. Whether it does is all that is asked, so
the suffix array is sparse and cut at 100 bytes, with equal suffixes put by position: such
a suffix has its previous smaller position right before it, in the same run of common
prefixes, unless it is the run's least. heddle.llm.repeats brings positions together that
can share 100 bytes (the same anchor in another context), sorts them and compares
neighbours byte by byte. Copies in equal contexts need no sorting, their least position is
kept at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from heddle.llm import blocks as B
from heddle.llm import repeats as R

LENGTH, SEED = 100, 28
RESULT = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())]


class ByteSymbols(R.Symbols):
    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.off = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))

    def codes(self, a: int, b: int) -> np.ndarray:
        return B.byte_codes(self.buf[a:b])

    def content(self, a: int, b: int) -> bytes:
        return self.buf[a:b].tobytes()

    @staticmethod
    def read(body: bytes) -> np.ndarray:
        return np.frombuffer(body, np.uint8)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, replace: bool = False) -> DataFrame:
    """docs (all columns, or those in keep) with n_bytes, n_removed, n_spans and kept_sha256; with replace, text is what is left.

    replace drops bytes that a cut leaves without the rest of their character. Null texts
    are empty (with replace they stay null). A null doc_id stands before all others; rows
    of equal doc_id are one place, so at equal starts neither is earlier and both stay.
    Columns of a result's name are replaced. An empty table gives no rows.
    """
    names = [n for n, _ in RESULT]
    kept = [c for c in (keep or docs.columns) if c not in names]
    docs = docs.select(*dict.fromkeys([*kept, key, text]))
    plan = R.Plan(ByteSymbols, length, seed, "earlier", text, key, density=0.03)
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(n, t) for n, t in RESULT]])

    def finish(table: pa.Table, sym: R.Symbols, gone: np.ndarray) -> pa.RecordBatch:
        packed = sym.buf[~gone].tobytes()
        at = np.append(0, np.cumsum(~gone))[sym.off]
        left = [packed[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        starts = sym.off[:-1][np.diff(sym.off) > 0]
        begins[starts] = gone[starts]  # a run ends with its document
        spans = np.append(0, np.cumsum(begins))[sym.off]
        removed = np.append(0, np.cumsum(gone))[sym.off]
        cols = {c: table[c].combine_chunks() for c in kept}
        if replace:
            whole = [None if not ok else t.decode("utf-8", "ignore") for t, ok in zip(left, table[text].is_valid().to_pylist(), strict=True)]
            cols[text] = pa.array(whole, table[text].type)
        cols |= {"n_bytes": pa.array(np.diff(sym.off)), "n_removed": pa.array(np.diff(removed)), "n_spans": pa.array(np.diff(spans))}
        cols["kept_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in left], pa.string())
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return R.find(docs, plan, finish, schema, "suffix-dedup")
