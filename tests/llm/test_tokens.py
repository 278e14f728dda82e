from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from panelcast.llm import bpe
from panelcast.llm import token_files as tf

from .helpers import PLAIN, awkward, docs, empty

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("leaf,window", [(16, 1), (64, 4), (8192, 32)])
def test_tree_equals_library(library, leaf, window):
    codec = bpe.Codec(bpe.load_ranks(RANKS), public_tokenizers.PATTERN, leaf, window)
    rng = random.Random(4)
    alphabet = ["the ", "River's ", "we'll", "  ", "\n", "\n\n ", "12345", "%%&&", "é", "你好", "'", "r", "e", "l", "x" * 40, "\u00a0", "\t", " '", "don't ", "ſ"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(0, 400))) for _ in range(150)] + ["", " ", "a" * 5000, " " * 3000, PLAIN * 100, "'ll" * 700]
    for text in texts:
        got = codec.encode(text)
        assert got.tolist() == library.encode_ordinary(text)
        assert codec.decode(got) == text.encode()


def test_bpe_rows(spark, library):
    df = awkward(spark)
    want = []
    for r in df.collect():
        ids = np.array(library.encode_ordinary(r.text or ""), dtype="<u4")
        want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = bpe.round_trip(df, RANKS, public_tokenizers.PATTERN)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    decoded = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted((bytes(r.bytes) for r in decoded.collect())) == sorted((r.text or "").encode() for r in df.collect())
    assert bpe.round_trip(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def brute_lengths(counts, most):
    """Least total bits over all multisets of lengths that satisfy Kraft's inequality, by search."""
    best = [None]

    def search(left, space, cost, low):
        if best[0] is not None and cost >= best[0]:
            return
        if not left:
            best[0] = cost
            return
        for bits in range(low, most + 1):
            if space >= 2.0**-bits * len(left):  # the rest have at least as short codes
                pass
            if 2.0**-bits <= space:
                search(left[1:], space - 2.0**-bits, cost + bits * left[0], bits)

    search(sorted(counts, reverse=True), 1.0, 0, 1)
    return best[0]


def test_code_lengths_are_optimal():
    rng = random.Random(5)
    for _ in range(30):
        counts = [rng.choice([1, 2, 3, 10, 100, 1000]) for _ in range(rng.randrange(2, 8))]
        lengths = tf.code_lengths(np.array(counts), 4)
        assert lengths.max() <= 4 and sum(2.0 ** -int(x) for x in lengths) <= 1.0
        assert sum(c * int(x) for c, x in zip(counts, lengths)) == brute_lengths(counts, 4)


def test_blocks_decode_alone():
    rng = np.random.default_rng(6)
    blocks = [rng.zipf(1.3, n).clip(0, 40_000).astype(np.uint32) for n in (1, 255, 256, 257, 5000)]
    counts = np.bincount(np.concatenate(blocks))
    lengths = tf.code_lengths(counts)
    codes, lookup = tf.canonical(lengths)
    assert sorted((int(n), int(c)) for n, c in zip(lengths, codes) if n) == sorted({(int(n), int(c)) for n, c in zip(lengths, codes) if n})
    packed = [tf.pack(b, codes, lengths) for b in blocks]
    for got, want in zip(tf.unpack([p[0] for p in packed], [p[1] for p in packed], [len(b) for b in blocks], lookup), blocks):
        assert got.tolist() == want.tolist()
    # reading may start at any checkpoint
    data, marks = packed[4]
    (tail,) = tf.unpack([data], [marks[7:]], [5000 - 7 * tf.CHECKPOINT], lookup)
    assert tail.tolist() == blocks[4][7 * tf.CHECKPOINT :].tolist()


def test_files_round_trip(spark):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(WORDS)
    df = awkward(spark)
    got = sorted(tf.round_trip(df, WORDS, 2).collect(), key=lambda r: r.start)
    want = [(r.doc_id, encoder.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in df.collect()]
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want), key=repr)
    assert tf.round_trip(empty(spark), WORDS, 2).count() == 0


def test_files_hold_ids(spark):
    df = docs(spark, [PLAIN, "", PLAIN * 300])
    path = tf.new_folder(spark)
    tokens = tf.encode_texts(df, WORDS, 2)
    tf.write(tokens, path, parts=2)
    assert {r.doc_id: bytes(r.ids) for r in tf.read(spark, path).collect()} == {r.doc_id: bytes(r.ids) for r in tokens.collect()}
