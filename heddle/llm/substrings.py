"""Substring dedup (operator 4): seed and extend over words.

Every word inside a window of 35 words whose word sequence also starts anywhere else goes.
Documents meet on winnowed anchors of eight words. The occurrences of an anchor are extended
both ways: for every number of words to the left of it the windows that start there are
sorted by their words, so that those which agree as far as the length, to the right as
well, stand side by side, for all pairs of occurrences at once (heddle.llm.repeats). The
maximal runs of windows found so are the maximal repeats, and they are what is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from heddle.llm import blocks as B
from heddle.llm import repeats as R

WINDOW, SEED = 35, 8
RESULT = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())]


class WordSymbols(R.Symbols):
    def __init__(self, texts: list[bytes]):
        self.text, self.starts, self.ends, self.off = B.tokens(texts)
        self.hashes = B.word_hashes(self.text, self.starts, self.ends)

    def codes(self, a: int, b: int) -> np.ndarray:
        return self.hashes[a:b]

    def content(self, a: int, b: int) -> bytes:
        return b" ".join([*self.text[self.starts[a] : self.ends[b - 1]].tobytes().split(), b""])

    @staticmethod
    def read(body: bytes) -> np.ndarray:
        return pa.array(body.split(b" ")[:-1], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.uint32)


def kept_texts(sym: WordSymbols, keep: np.ndarray) -> list[bytes]:
    """Each text's kept words, joined by one space."""
    edge = np.zeros(len(sym.text) + 1, np.int8)
    edge[sym.starts[keep]] += 1
    edge[sym.ends[keep]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    inside[sym.ends[keep]] = True  # each text is followed by a space, so a word's end is in the buffer
    out = np.where(inside, sym.text, 0)
    out[sym.ends[keep]] = 0x20
    packed = out[inside].tobytes()
    size = np.where(keep, sym.ends - sym.starts + 1, 0)
    at = np.append(0, np.cumsum(size))[sym.off]
    return [packed[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, replace: bool = False) -> DataFrame:
    """docs (all columns, or those in keep) with n_words, n_removed and kept_sha256; with replace, text is what is left.

    Null and empty texts have no words. Every row is a document of its own: repeated rows
    repeat each other's windows, whatever their doc_id. Columns of a result's name are
    replaced. An empty table gives no rows.
    """
    names = [n for n, _ in RESULT]
    kept = [c for c in (keep or docs.columns) if c not in names]
    docs = docs.select(*dict.fromkeys([*kept, key, text]))
    plan = R.Plan(WordSymbols, window, seed, "any", text, key, density=0.02)
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(n, t) for n, t in RESULT]])

    def finish(table: pa.Table, sym: WordSymbols, gone: np.ndarray) -> pa.RecordBatch:
        left = kept_texts(sym, ~gone)
        removed = np.append(0, np.cumsum(gone))[sym.off]
        cols = {c: table[c].combine_chunks() for c in kept}
        if replace:
            cols[text] = pa.array(left, pa.binary()).cast(table[text].type)
        cols["n_words"] = pa.array(np.diff(sym.off))
        cols["n_removed"] = pa.array(np.diff(removed))
        cols["kept_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in left], pa.string())
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return R.find(docs, plan, finish, schema, "substring-dedup")
