"""Source divergence audit (operator 13): how the vocabularies of a language's sources differ.

Each kept term has a smoothed share p in each source, in whole thousand-millionths. The
distance of two sources is the sum of |p - p'| over all kept terms, added up exactly as

* V |b - b'|, where b is the share that a source gives a term it lacks, plus corrections:
* heavy terms, which at least one in LIGHT of a language's sources has: dense numpy tiles of
  terms by sources, each source's column against all columns;
* light terms: their postings (source, p). For each source, the sorted p against the b' of
  all others; then, for each two postings of a term, what this misses where both have it.

Cells (language, term, source, p) are dealt by language, tile of sources, tile of sources and
chunk of terms, so a task holds at most about CELLS of them, however large a language, a source
or a term's postings are; with up to TILE sources nothing is sent twice. A task gives one sum
for each pair of sources in its tiles.

Terms are counted in the tasks that read the texts before anything is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.blocks import tidy
from heddle.llm.shared import drop, stored

UNIT, SMOOTH, LEAST_DOCS, RANKS = 1_000_000_000, 5, 30, 50
#: A term is heavy if at least one in LIGHT sources of its language has it. Sources of a tile, cells of a task.
LIGHT, TILE, CELLS = 8, 256, 1 << 20
#: Distinct terms that a task counts before it passes its counts on, bytes of a text looked at at once.
HELD, SLICE = 1 << 17, 1 << 20
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(text: bytes) -> Counter:
    """The terms of a text, lower-cased, with their numbers."""
    out: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            inside = TERM.match(text, end)
            end = inside.end() if inside else end
        out.update(TERM.findall(text[at:end].lower()))
        at = end
    return out


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """COUNTS: occurrences of each term and documents that have it, of each group; a null term has the group's documents. Rows of a key may be several."""

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def put():
            for (a, b), (n, d) in held.items():
                terms = list(n)
                cols = [[a] * len(terms), [b] * len(terms), [None if t is None else t.decode() for t in terms], list(n.values()), [d[t] for t in terms]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 3 else pa.int64()) for i, c in enumerate(cols)], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            groups = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for i, g in enumerate(groups):
                n, d = held.setdefault(g, (Counter(), Counter()))
                before = len(n)
                found = _terms(batch.column(0)[i].as_buffer().to_pybytes())
                n.update(found)
                d.update(found.keys())
                n[None] += 0
                d[None] += 1
                size += len(n) - before
                if size > HELD:
                    yield from put()
                    held, size = {}, 0
        yield from put()
        held = {}
        tidy()

    own = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (text, lang, source)]
    return docs.select(own[0].cast("binary").alias("text"), own[1].alias("lang"), own[2].alias("source")).mapInArrow(run, COUNTS)


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT (n + SMOOTH) / (total + SMOOTH terms)), exact for any counts; null without terms."""
    share = f"1 + (CAST({UNIT} AS DECIMAL(10, 0)) * CAST({n} + {SMOOTH} AS DECIMAL(20, 0))) div CAST({total} + {SMOOTH} * {terms} AS DECIMAL(20, 0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN {share} END")


def _tile(table: pa.Table, tile: int) -> pa.Table:
    """What the pairs (one below two) of a chunk's cells add to V |b - b'|. A source's base is in its row without a term."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    sid, p, heavy = (table[c].to_numpy() for c in ("sid", "p", "heavy"))
    term = table["term"].combine_chunks().dictionary_encode().indices
    cell = term.is_valid().to_numpy(zero_copy_only=False)
    code = term.fill_null(-1).to_numpy()
    names, column = np.unique(sid, return_inverse=True)
    b = np.zeros(len(names), np.int64)
    b[column[~cell]] = p[~cell]
    rows, cols = np.flatnonzero(names // tile == i), np.flatnonzero(names // tile == j)
    apart = np.abs(b[:, None] - b)
    total = np.zeros((len(names), len(names)), np.int64)

    # heavy terms: dense tiles of sources by terms
    at = np.flatnonzero(cell & heavy)
    terms, own = np.unique(code[at], return_inverse=True)
    order = np.argsort(own, kind="stable")
    at, own = at[order], own[order]
    step = max(1, (1 << 18) // len(names))
    for low in range(0, len(terms), step):
        x, y = np.searchsorted(own, [low, low + step])
        dense = np.repeat(b[:, None], min(step, len(terms) - low), axis=1)
        dense[column[at[x:y]], own[x:y] - low] = p[at[x:y]]
        for r in rows:
            total[r, cols] += np.abs(dense[cols] - dense[r]).sum(axis=1)
    total[np.ix_(rows, cols)] -= len(terms) * apart[np.ix_(rows, cols)]

    # light terms: a source's own postings against what the others give terms that they lack
    at = np.flatnonzero(cell & ~heavy)
    at = at[np.lexsort((p[at], column[at]))]
    ends = np.searchsorted(column[at], np.arange(len(names) + 1))
    for g in range(len(names)):
        mine, others = p[at[ends[g] : ends[g + 1]]], cols if names[g] // tile == i else rows
        upto = np.append(0, np.cumsum(mine))
        k = np.searchsorted(mine, b[others])
        far = upto[-1] - 2 * upto[k] + (2 * k - len(mine)) * b[others] - len(mine) * apart[g, others]
        total[g, others] += far
        total[others, g] += far
    # and, for two postings of a term, what this misses
    at = at[np.lexsort((column[at], code[at]))]
    t, c, v = code[at], column[at], p[at]
    gap = 1
    while True:
        k = np.flatnonzero(t[gap:] == t[:-gap])
        if not len(k):
            break
        g, h, x, y = c[k], c[k + gap], v[k], v[k + gap]
        np.add.at(total, (g, h), np.abs(x - y) - np.abs(x - b[h]) - np.abs(b[g] - y) + apart[g, h])
        gap += 1

    r, c = np.meshgrid(rows, cols, indexing="ij")
    told = (r < c) & (total[r, c] != 0)
    r, c = r[told], c[told]
    lang = pa.array([table["lang"][0].as_py()] * len(r), pa.string())
    return pa.table({"lang": lang, "one": names[r], "two": names[c], "delta": total[r, c]})


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: of each (lang, source) its distance to each other source of the language ('pair'), and the terms that it has more often than its language ('term', up to ranks).

    Nulls in text, lang and source are empty strings, which are a language and a source like
    others. Repeated rows are documents of their own. A language without a term in least_docs
    documents has distances zero and no terms; a source that stands alone in its language
    has no pairs. Equal values are ranked by item. Other columns are not looked at. An
    empty table gives no rows.
    """
    found = counts(docs, text, lang, source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = stored(found, "divergence-counts")
    terms = found.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), F.count("*").alias("sources"))
    terms = terms.filter(F.col("docs") >= least_docs).drop("docs")
    kept = stored(found.drop("docs").join(terms, ["lang", "term"]), "divergence-kept")

    # one row for each group and language
    order = Window.partitionBy("lang").orderBy("source")
    groups = found.filter("term IS NULL").select("lang", "source", (F.row_number().over(order) - 1).cast("long").alias("sid"))
    n = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"))
    per_lang = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_total"))
    groups = groups.join(n, ["lang", "source"], "left").join(per_lang, "lang", "left").fillna(0, ["total", "cells", "terms", "lang_total"])
    every = Window.partitionBy("lang")
    groups = groups.withColumns({"of": F.count("*").over(every), "cells": F.sum("cells").over(every), "base": _share("0", "total", "terms")})
    chunks = F.ceil(F.least("cells", 2 * TILE * F.col("terms")) / CELLS)
    groups = stored(groups.withColumns({"tile": F.floor(F.col("sid") / TILE), "tiles": F.ceil(F.col("of") / TILE), "chunks": F.greatest(chunks, F.lit(1))}), "divergence-groups")

    # cells and sources, in all tiles that they belong to
    shares = kept.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "total", "terms"), "q": _share("all_n", "lang_total", "terms")})
    cells = shares.select("lang", "sid", "term", "p", (F.col("sources") * LIGHT >= F.col("of")).alias("heavy"), "tile", "tiles", F.pmod(F.xxhash64("term"), "chunks").alias("chunk"))
    heads = groups.filter("terms > 0").select("lang", "sid", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), F.lit(False).alias("heavy"), "tile", "tiles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    size = TILE
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    dealt = cells.union(heads).withColumn("other", other)
    dealt = dealt.select("lang", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "chunk", "sid", "term", "p", "heavy")
    deltas = dealt.groupBy("lang", "i", "j", "chunk").applyInArrow(lambda table: _tile(table, size), "lang string, one long, two long, delta long")
    deltas = deltas.groupBy("lang", "one", "two").agg(F.sum("delta").alias("delta"))

    # each two sources of a language, by tiles
    own = groups.select("lang", "source", "sid", "base", "terms", "tile", other.alias("other"))
    one = own.filter("tile <= other").select("lang", F.col("tile").alias("i"), F.col("other").alias("j"), F.col("sid").alias("one"), F.col("source").alias("s"), F.col("base").alias("b"), "terms")
    two = own.filter("tile >= other").select("lang", F.col("other").alias("i"), F.col("tile").alias("j"), F.col("sid").alias("two"), F.col("source").alias("t"), F.col("base").alias("c"))
    pairs = one.join(two, ["lang", "i", "j"]).filter("one < two").join(deltas, ["lang", "one", "two"], "left")
    value = F.when(F.col("terms") > 0, F.col("terms") * F.abs(F.col("b") - F.col("c")) + F.coalesce("delta", F.lit(0))).otherwise(0).cast("long")
    both = F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item"))))
    pairs = pairs.select("lang", both.alias("x"), value.alias("value")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    more = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs, more = (x.withColumn("rank", F.row_number().over(ranked)) for x in (pairs, more))
    out = stored(pairs.union(more.filter(F.col("rank") <= ranks)), "divergence")
    for df in (found, kept, groups):
        drop(df)
    return out
