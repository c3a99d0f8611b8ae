"""BPE encoding and decoding (operator 12) with a public tokenizer, by tree concatenation.

A text is halved until its pieces have at most PIECE bytes, wherever the cuts fall. Pieces
are encoded side by side. Then neighbours are joined, level by level: a window around the
join is encoded again, and grows until it has a token in common with the left piece and
one with the right piece. Left tokens up to the one, window tokens between them and right
tokens from the other on are the encoding of both pieces together, exactly:

* BPE merges by rank, so a token sequence is the encoding of its text if (and only if) every
  two neighbours are the encoding of theirs. All neighbours of the result stand side by side
  in one of the three encodings, which a common token makes one.
* What the pre-tokenizer and the added tokens do at a place depends on MARGIN bytes around
  it at most, and a run of letters or symbols that holds the common token ends at the same
  place in both encodings. Common tokens keep MARGIN from the cut and from the window's ends.
* A common token is bounded by characters (not by bytes within one), and what follows
  (left) or begins it (right) is a character that Unicode composition never joins to what
  stands before it, so the text is normalised alike on both sides.

In the worst case, a long run without a rhythm of its own, a window grows to both pieces,
which is the plain encoding.

Pieces are encoded through a memo of their parts between white space, since no token spans
any; the tokenizer sees each distinct part once (of plain words, its model alone, where the
pre-tokenizer is found to leave them whole). Texts over LONG bytes are dealt out as
pieces to all tasks, and only their joins are made where the row is put together.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.blocks import _SPACE, tidy
from heddle.llm.shared import drop, stored

#: Bytes of a piece, of a text that is dealt out in pieces, of a window's half to begin with.
PIECE, LONG, WINDOW = 4096, 1 << 16, 64
#: Bytes around a place that decide what the pre-tokenizer does there; no added token is longer.
MARGIN = 16
#: Bytes of text encoded at a time, of parts remembered, of parts given to the tokenizer in one call.
BATCH, MEMO, CALL = 1 << 20, 160 << 20, 8 << 10
#: Letters that have no other form when normalised than a small one, and parts that are a run of them with up to three signs after it.
_LETTERS = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]]
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]{0,3})")
#: Characters that are never composed with what stands before them.
_STARTS = re.compile("[\x00-\x7fÀ-˿Ͱ-҂Ҋ-ԯぁ-ゖァ-ヺ㐀-鿿가-힣]")
RESULT = [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]


@dataclass
class Tokens:
    """Tokens of a stretch of a text: ids and where they begin and end in it, in bytes."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def part(self, a: int, b: int, shift: int = 0) -> Tokens:
        return Tokens(self.ids[a:b], self.begin[a:b] + shift, self.end[a:b] + shift)

    def clean(self) -> np.ndarray:
        """Tokens that share no character with a neighbour."""
        own = np.ones(len(self.ids), bool)
        if len(own) > 1:
            apart = self.begin[1:] >= self.end[:-1]
            own[1:] &= apart
            own[:-1] &= apart
        return own


def together(parts: list[Tokens]) -> Tokens:
    return Tokens(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "begin", "end")))


_NONE = Tokens(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))


class _Memo(dict):
    """Numbers of parts; new ones are noted."""

    def __init__(self):
        self.new, self.bytes = [], 0

    def __missing__(self, part: bytes) -> int:
        self[part] = n = len(self)
        self.new.append(part)
        self.bytes += len(part) + 200
        return n


class Encoder:
    """A tokenizer file with a memo of at most about MEMO bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        for t in self.tokenizer.get_added_tokens_decoder().values():
            if t.lstrip or t.rstrip or t.single_word or t.normalized or len(t.content.encode()) > MARGIN or _SPACE[list(t.content.encode())].any():
                raise ValueError(f"added token {t.content!r}: only short ones that are matched as they stand")
        self.model = self.tokenizer.model
        strings = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.strings = pa.array(strings)
        self.bytes = np.array([len(x.removesuffix("</w>")) for x in strings])  # a character for each byte
        self._forget()
        self.letters = {ord(c): self._mapped(c) for c in _LETTERS}
        self.signs: dict[str, list[int]] = {"": []}
        self.words = all(self._word(_WORD.fullmatch(p)) == self.tokenizer.encode(p, add_special_tokens=False).ids for p in ("Zq", "the,", "QUÀßéX***", "a."))

    def _mapped(self, text: str) -> str:
        """What the model is given for it."""
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        return "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

    def _forget(self):
        self.memo = _Memo()
        self.first = self.count = np.zeros(0, np.int64)
        self.flat = _NONE

    def _word(self, found: re.Match) -> list[int]:
        """Ids of a run of letters with few signs after it: two words for the model, which is asked alone."""
        letters, signs = found.groups()
        if signs not in self.signs:
            self.signs[signs] = [t.id for t in self.model.tokenize(self._mapped(signs))]
        return [t.id for t in self.model.tokenize(letters.translate(self.letters))] + self.signs[signs]

    def plain(self, parts: list[bytes]) -> tuple[Tokens, np.ndarray]:
        """The tokens of all parts, one part after the other, placed in their own part, and how many each has.

        The tokenizer gets many parts at once, with a space between them, which no token spans.
        """
        found, counts, a = [], [], 0
        while a < len(parts):
            b, size = a, 0
            while b < len(parts) and (b == a or size < CALL):
                size += len(parts[b]) + 1
                b += 1
            text = b" ".join(parts[a:b])
            e = self.tokenizer.encode(text.decode(), add_special_tokens=False)
            at = np.array(e.offsets, np.int64).reshape(-1, 2)
            if not text.isascii():  # offsets count characters
                c = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
                at = np.append(0, np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)))[at]
            starts = np.cumsum([0, *(len(p) + 1 for p in parts[a:b])])
            of = np.searchsorted(starts, at[:, 0], "right") - 1
            found.append(Tokens(np.array(e.ids, np.int32), at[:, 0] - starts[of], at[:, 1] - starts[of]))
            counts.append(np.bincount(of, minlength=b - a)[: b - a])
            a = b
        return together([_NONE, *found]), np.concatenate([np.zeros(0, np.int64), *counts])

    def apart(self, parts: list[bytes]) -> list[Tokens]:
        """The tokens of each part, without the memo."""
        flat, count = self.plain(parts)
        upto = np.append(0, np.cumsum(count))
        return [flat.part(upto[i], upto[i + 1]) for i in range(len(parts))]

    def _learn(self):
        new, self.memo.new = self.memo.new, []
        count, first = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        ids, others, match, word = [], [], _WORD.fullmatch, self._word
        for i, part in enumerate(new):
            found = match(part.decode()) if self.words else None
            if found:
                own = word(found)
                first[i], count[i] = len(ids), len(own)
                ids += own
            else:
                others.append(i)
        end = np.cumsum(self.bytes[ids]) if ids else np.zeros(0, np.int64)
        begin = np.append(0, end)[:-1] if ids else end
        start = np.repeat(begin[np.delete(first, others)], np.delete(count, others)) if ids else end
        own = Tokens(np.array(ids, np.int32), begin - start, end - start)
        more, n = self.plain([new[i] for i in others])
        count[others], first[others] = n, len(ids) + np.cumsum(n) - n
        self.first = np.concatenate([self.first, first + len(self.flat.ids)])
        self.count, self.flat = np.concatenate([self.count, count]), together([self.flat, own, more])

    def decode(self, off: np.ndarray, flat: np.ndarray) -> pa.Array:
        """The texts of token sequences, special tokens included."""
        if self.tokenizer.decoder is None:  # then it joins the tokens' strings by spaces
            return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(off, pa.int64()), self.strings.take(pa.array(flat))), " ").cast(pa.string())
        return pa.array(self.tokenizer.decode_batch([flat[a:b].tolist() for a, b in zip(off, off[1:], strict=False)], skip_special_tokens=False), pa.string())

    def encode(self, texts: list[bytes]) -> list[Tokens]:
        """The plain encoding of each text."""
        if self.memo.bytes > MEMO:
            self._forget()
        joined = b" ".join([*texts, b""])
        numbers = np.fromiter(map(self.memo.__getitem__, joined.split()), np.int64)
        if self.memo.new:
            self._learn()
        word = np.zeros(len(joined) + 1, np.int8)
        word[:-1] = ~_SPACE[np.frombuffer(joined, np.uint8)]
        starts = np.flatnonzero(np.diff(word, prepend=np.int8(0)) == 1)
        edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
        n = self.count[numbers]
        upto = np.append(0, np.cumsum(n))
        at = np.repeat(self.first[numbers] - upto[:-1], n) + np.arange(upto[-1])
        place = np.repeat(starts, n)
        whole = Tokens(self.flat.ids[at], self.flat.begin[at] + place, self.flat.end[at] + place)
        cut = upto[np.searchsorted(starts, edges)]
        return [whole.part(cut[i], cut[i + 1], -edges[i]) for i in range(len(texts))]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder: what it remembers serves its later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(text: bytes, size: int) -> list[int]:
    """0, places between characters that halve the text until no piece has more than size bytes, and its length."""
    n = 1
    while n * size < len(text):
        n *= 2
    out = [0]
    for k in range(1, n):
        at = k * len(text) // n
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        if at > out[-1] and at < len(text):
            out.append(at)
    return [*out, len(text)]


def _starts(text: bytes, at: int) -> bool:
    return at >= len(text) or _STARTS.match(text[at : at + 4].decode(errors="ignore")) is not None


def _common(text: bytes, one: Tokens, two: Tokens, low: int, high: int, left: bool) -> tuple[int, int] | None:
    """Places in one and two of a token that they share between low and high: the last one for the left side, else the first."""
    a, b = (int(np.searchsorted(t.begin, low)) for t in (one, two))
    c, d = (int(np.searchsorted(t.begin, high)) for t in (one, two))
    # bytes within a character are no boundary: there a window's tokens overlap, so a clean one begins and ends with characters
    near_one, near_two = one.part(max(0, a - 1), c + 1), two.part(max(0, b - 1), d + 1)
    a0, b0 = max(0, a - 1), max(0, b - 1)
    clean_one, clean_two = near_one.clean(), near_two.clean()
    there = {(x, y, i): k for k, (x, y, i, ok) in enumerate(zip(near_one.begin.tolist(), near_one.end.tolist(), near_one.ids.tolist(), clean_one.tolist(), strict=True)) if ok and x >= low and y <= high}
    order = range(len(near_two.ids))
    for k in reversed(order) if left else order:
        x, y = int(near_two.begin[k]), int(near_two.end[k])
        if clean_two[k] and x >= low and y <= high and (x, y, int(near_two.ids[k])) in there and _starts(text, y if left else x):
            return a0 + there[x, y, int(near_two.ids[k])], b0 + k
    return None


def joined(encoder: Encoder, joins: list[tuple[bytes, int, int, int, Tokens, Tokens]], window: int = 0) -> list[Tokens]:
    """The tokens of text[low:high] for each (text, low, cut, high, tokens of the left part, of the right part)."""
    out: list[Tokens | None] = [None] * len(joins)
    todo, w = list(range(len(joins))), window or WINDOW
    while todo:
        spans = []
        for k in todo:
            text, low, cut, high = joins[k][:4]
            a, b = max(low, cut - w), min(high, cut + w)
            while a > low and text[a] & 0xC0 == 0x80:
                a -= 1
            while b < high and text[b] & 0xC0 == 0x80:
                b += 1
            spans.append((a, b))
        found = encoder.apart([joins[k][0][a:b] for k, (a, b) in zip(todo, spans, strict=True)])
        again = []
        for k, (a, b), mid in zip(todo, spans, found, strict=True):
            text, low, cut, high, left, right = joins[k]
            mid = mid.part(0, len(mid.ids), a)
            head = (-1, -1) if a == low else _common(text, left, mid, a + MARGIN, cut - MARGIN, True)
            tail = (len(right.ids), len(mid.ids)) if b == high else _common(text, right, mid, cut + MARGIN, b - MARGIN, False)
            if head is None or tail is None:
                again.append(k)
            else:
                out[k] = together([left.part(0, head[0] + 1), mid.part(head[1] + 1, tail[1]), right.part(tail[0], len(right.ids))])
        todo, w = again, 2 * w
    return out


def tree(encoder: Encoder, texts: list[bytes], ends: list[list[int]], leaves: list[list[Tokens]]) -> list[Tokens]:
    """The tokens of each text from those of its pieces, which lie between its ends."""
    while any(len(own) > 1 for own in leaves):
        joins = []
        for text, at, own in zip(texts, ends, leaves, strict=True):
            joins += [(text, at[i], at[i + 1], at[i + 2], own[i], own[i + 1]) for i in range(0, len(own) - 1, 2)]
        done = iter(joined(encoder, joins))
        leaves = [[next(done) if i + 1 < len(own) else own[i] for i in range(0, len(own), 2)] for own in leaves]
        ends = [[*at[:-1:2], at[-1]] for at in ends]
    return [own[0] for own in leaves]


def encode_texts(encoder: Encoder, texts: list[bytes], size: int) -> list[Tokens]:
    ends = [cuts(t, size) for t in texts]
    pieces = [(t[a:b], a) for t, at in zip(texts, ends, strict=True) for a, b in zip(at, at[1:], strict=False)]
    found = iter([p.part(0, len(p.ids), a) for p, (_, a) in zip(encoder.encode([p for p, _ in pieces]), pieces, strict=True)])
    return tree(encoder, texts, ends, [[next(found) for _ in at[1:]] for at in ends])


def _runs(column: pa.Array) -> list[tuple[int, int]]:
    """Ranges of rows of about BATCH bytes."""
    n = np.frombuffer(column.cast(pa.large_binary()).buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    out, a = [], 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(n, n[a] + BATCH, "right")) - 1)
        out.append((a, min(b, len(column))))
        a = out[-1][1]
    return out


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def _results(encoder: Encoder, rest: list[pa.Array], ids: list[np.ndarray]) -> pa.RecordBatch:
    off = np.cumsum([0, *map(len, ids)])
    flat = np.concatenate([np.zeros(0, np.int32), *ids])
    return pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(off), pa.int64()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat)), encoder.decode(off, flat)], names=["__keep", *(n for n, _ in RESULT)])


def bpe(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, piece: int = 0, long: int = 0) -> DataFrame:
    """docs (all columns, or those in keep) with n_tokens, ids (without special tokens being added) and decoded.

    path is the tokenizer's file, which executors must have; its model is BPE and its tokens
    span no white space. Null and empty texts have no tokens and decode to an empty text.
    Strings of added tokens in a text become those tokens, as in the library. Rows are
    independent: repeated rows and null ids are kept as they are. Columns of a result's
    name are replaced. An empty table gives no rows.
    """
    piece, long = piece or PIECE, long or LONG
    names = [n for n, _ in RESULT]
    kept = [c for c in (keep or docs.columns) if c not in names]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__keep"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    packed = T.StructField("__keep", rows.schema["__keep"].dataType)  # null in all pieces of a row but the first
    schema = T.StructType([packed, *[T.StructField(n, t) for n, t in RESULT]])

    def whole(batches):
        encoder = encoder_of(path)
        for batch in batches:
            for a, b in _runs(batch.column(1)):
                found = encode_texts(encoder, _bytes(batch.column(1).slice(a, b - a)), piece)
                yield _results(encoder, [batch.column(0).slice(a, b - a)], [t.ids for t in found])
        tidy()

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = _bytes(batch.column(1).slice(i, 1))[0]
                at, row = cuts(data, long // 2), int.from_bytes(os.urandom(8)) >> 1
                n = len(at) - 1
                keeps = batch.column(0).take(pa.array([i] + [None] * (n - 1), pa.int64()))
                yield pa.RecordBatch.from_arrays([keeps, pa.array([row] * n), pa.array(range(n), pa.int64()), pa.array([data[x:y] for x, y in zip(at, at[1:], strict=False)], pa.binary())], names=["__keep", "row", "place", "piece"])

    def encode_pieces(batches):
        encoder = encoder_of(path)
        for batch in batches:
            for a, b in _runs(batch.column(3)):
                found = encode_texts(encoder, _bytes(batch.column(3).slice(a, b - a)), piece)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(4)] + [pa.array([getattr(t, c).astype(np.int32).tobytes() for t in found], pa.binary()) for c in ("ids", "begin", "end")], names=[*batch.schema.names, "ids", "begin", "end"])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("place").combine_chunks()
        parts = table["piece"].to_pylist()
        at = np.cumsum([0, *map(len, parts)]).tolist()
        own = [Tokens(*(np.frombuffer(table[c][i].as_py(), np.int32) for c in ("ids", "begin", "end"))).part(0, None, at[i]) for i in range(len(parts))]
        encoder = encoder_of(path)
        found = tree(encoder, [b"".join(parts)], [at], [own])
        return pa.Table.from_batches([_results(encoder, [table["__keep"].combine_chunks().slice(0, 1)], [found[0].ids])])

    large = F.octet_length("__text") > long
    short = rows.filter(~large).mapInArrow(whole, schema)
    spec = T.StructType([packed, T.StructField("row", T.LongType()), T.StructField("place", T.LongType()), T.StructField("piece", T.BinaryType())])
    dealt = stored(rows.filter(large).mapInArrow(cut, spec), "bpe-pieces")
    encoded = dealt.repartition("row", "place").mapInArrow(encode_pieces, T.StructType([*spec, *[T.StructField(c, T.BinaryType()) for c in ("ids", "begin", "end")]]))
    out = short.union(encoded.groupBy("row").applyInArrow(join, schema))
    return out.select("__keep.*", *names)
