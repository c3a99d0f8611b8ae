import random

import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from heddle.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
ALPHABET = ["a", "b", "aa", "ing", "the", "'", "'s", "'re", "'ll", "s", "r", "e", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "1", "½", "é", "é", "́", "̧", "İ", "ǅ", "Σ", "ﬁ", "中", "文字", "각", "ᄀ", "ᅡ", "ᆨ", "<|endoftext|>", "<|startoftext|>", "<|end", "oftext|>", "😀", "!", "...", "\x00", "A", "ZE", "が"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=160).map("".join), st.sampled_from([1, 3, 8, 32, 90]))
def test_tree_equals_plain(text, size):
    got = bpe.encode_texts(bpe_encoder(), [text.encode()], size)[0]
    assert got.ids.tolist() == PLAIN.encode(text, add_special_tokens=False).ids


_held = []


def bpe_encoder():
    if not _held:
        _held.append(bpe.Encoder(PATH))
    return _held[0]


def test_long_unsplit_runs(encoder):
    rng = random.Random(3)
    texts = ["a" * 5001, "ab" * 3000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)), "".join(rng.choice("中文字漢語日本") for _ in range(9000)), "!?" * 4000 + "x", "'s" * 2500, "the" * 4000 + " " + "ing" * 4000]
    for size in (50, 700):
        got = bpe.encode_texts(encoder, [t.encode() for t in texts], size)
        assert [t.ids.tolist() for t in got] == [e.ids for e in PLAIN.encode_batch(texts, add_special_tokens=False)]


def test_windows_settle_joins(encoder):
    """Joins take only what lies around them: without the right windows the result is wrong, and windows stay small where words are short."""
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(1, 9))) for _ in range(4000)).encode()
    ends = bpe.cuts(text, 512)
    pieces = [p.ids.tolist() for p in encoder.encode([text[a:b] for a, b in zip(ends, ends[1:])])]
    whole = encoder.encode([text])[0].ids.tolist()
    assert sum(pieces, []) != whole
    sizes = []
    plain = encoder.apart
    encoder.apart = lambda t: sizes.extend(map(len, t)) or plain(t)
    try:
        assert bpe.encode_texts(encoder, [text], 512)[0].ids.tolist() == whole
    finally:
        del encoder.apart
    assert 0 < sum(sizes) < 0.6 * len(text)


def test_rows(spark):
    rng = random.Random(1)
    texts = [None, "", "  ", "Hello World's <|endoftext|>x", "Hello World's <|endoftext|>x", "x" * 3001, "".join(rng.choice(ALPHABET) for _ in range(5000))] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(120))) for _ in range(60)]
    rows = [(i if i != 7 else None, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, decoded string, ids int").repartition(3)
    for piece, long in ((0, 0), (40, 1000)):
        got = bpe.bpe(df, PATH, keep=["doc_id", "text"], piece=piece, long=long).collect()
        assert len(got) == len(rows) + 1
        for r in got:
            ids = PLAIN.encode(r.text or "", add_special_tokens=False).ids
            assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), PLAIN.decode(ids, skip_special_tokens=False))
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in [*rows, rows[3]])
    assert bpe.bpe(df, PATH).columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert bpe.bpe(df.limit(0), PATH).count() == 0


def test_query(spark):
    """The registered query over whole documents against the library's own encoding of whole texts."""
    import hashlib

    from heddle.llm import queries

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op12_bpe(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = PLAIN.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(PLAIN.decode(ids, skip_special_tokens=False)))
