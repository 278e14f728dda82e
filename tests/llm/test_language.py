from __future__ import annotations

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from panelcast.llm import language as lg

from .helpers import awkward, docs, empty

PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = {
    "en": "the and of with house river garden tree water light under over between people child morning evening".split(),
    "de": "der und die mit haus fluss garten baum wasser licht unter über zwischen leute kind morgen abend".split(),
    "fr": "le et de avec maison fleuve jardin arbre eau lumière sous sur entre gens enfant matin soir".split(),
}


@pytest.fixture(scope="module")
def small():
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b"bc", b" ab", b"ca", b"\xc3\xa9"]
    return lg.Pieces(pieces)


def all_segmentations(word, of, p):
    if not word:
        return 1.0
    return sum(p[of[word[:k]]] * all_segmentations(word[k:], of, p) for k in range(1, len(word) + 1) if word[:k] in of)


def test_forward_sums_all_segmentations(small):
    rng = np.random.default_rng(7)
    p = rng.random((small.size, 2))
    p /= p.sum(axis=0)
    words = [b" abc", b" abcabc", b"c", " é".encode(), b" ab", b" abcabca"]
    got = lg.log_probabilities(words, small, lg.lift(p, small))
    for w, row in zip(words, got):
        for k in range(2):
            assert math.isclose(row[k], math.log(all_segmentations(w, small.of, p[:, k])), rel_tol=1e-9)
            assert math.isclose(lg.log_of_long(w, small, lg.lift(p, small))[k], row[k], rel_tol=1e-9)


def test_long_words_stay_finite(small):
    p = np.full((small.size, 2), 1.0 / small.size)
    got = lg.log_probabilities([b" " + b"ab" * 5000], small, lg.lift(p, small))
    assert np.isfinite(got).all()


def test_expected_counts(small):
    """Against posteriors of every segmentation, spelled out."""
    rng = np.random.default_rng(8)
    p = rng.random(small.size)
    p /= p.sum()
    names = {v: k for k, v in small.of.items()}

    def segmentations(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in small.of:
                yield from ([small.of[word[:k]], *rest] for rest in segmentations(word[k:]))

    want = np.zeros(small.size)
    words, times = [b" abc", b"abab"], np.array([2.0, 3.0])
    for w, n in zip(words, times):
        every = list(segmentations(w))
        mass = np.array([np.prod(p[s]) for s in every])
        for s, m in zip(every, mass / mass.sum()):
            for piece in s:
                want[piece] += n * m
    assert np.allclose(lg.expected_counts(words, times, small, p), want) and len(names) == small.size - 1


def corpus(spark, n=150):
    rng = random.Random(9)
    langs = {i: sorted(WORDS)[i % 3] for i in range(n)}
    return docs(spark, [" ".join(rng.choices(WORDS[langs[i]], k=rng.randrange(3, 40))).capitalize() for i in range(n)], langs=langs)


def test_texts_without_a_letter():
    assert lg.words_of("½ ² 12 _ %".encode()) == []
    assert lg.words_of("² x1 Ünd".encode()) == ["²", "x", "ünd"]


def test_held_out_accuracy(spark):
    df = corpus(spark)
    got = lg.predict(df, lg.fit(df, PIECES), PIECES).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(150) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_held_out_rows_are_not_learned_from(spark):
    df = corpus(spark)
    swapped = df.selectExpr("doc_id", "text", "CASE WHEN crc32(encode(string(doc_id), 'utf-8')) % 5 = 0 THEN 'zz' ELSE lang END AS lang")
    assert "zz" not in lg.fit(swapped, PIECES)[0]


def test_awkward(spark):
    df = awkward(spark).unionByName(corpus(spark).selectExpr("doc_id + 1000 AS doc_id", "* EXCEPT (doc_id)"))
    got = {r.doc_id: r for r in lg.predict(df, lg.fit(df, PIECES), PIECES).where("doc_id < 100").collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0.0 for i in (0, 1, 2, 6)) and got[3].lang_pred == "en"
    kept = lg.keep_determined(df, PIECES)
    assert kept.columns == df.columns and not {0, 1, 2, 6} & {r.doc_id for r in kept.collect()}
    nothing = empty(spark)
    assert lg.predict(nothing, lg.fit(nothing, PIECES), PIECES).count() == 0 and lg.keep_determined(nothing, PIECES).count() == 0
    unlabelled = docs(spark, ["some words"]).selectExpr("doc_id", "text", "string(NULL) AS lang")
    assert lg.predict(unlabelled, lg.fit(unlabelled, PIECES), PIECES).first().lang_pred == "und"


def long_runs():
    vocabulary = lg.Pieces(sorted({bytes([b]) for b in range(256)} | {b"abc", b"bca", b"xyz"}))
    single = (vocabulary.lengths == 1) / 256.0
    one, two = 0.04 * single, 0.04 * single
    one[vocabulary.of[b"abc"]], one[vocabulary.of[b"bca"]], two[vocabulary.of[b"xyz"]] = 0.86, 0.1, 0.96
    return vocabulary, np.stack([one, two], axis=1)


def test_runs_of_any_length_have_a_probability():
    """10 KB of learned pieces: sums neither overflow nor vanish, whichever language is ahead."""
    vocabulary, p = long_runs()
    word = b"abc" * 1700 + b"xyz" * 1700
    want = np.full((len(word) + 1, 2), -np.inf)
    want[0] = 0.0
    with np.errstate(divide="ignore"):
        logs = np.log(p)
    for j in range(1, len(word) + 1):
        for k in (1, 3):
            number = vocabulary.of.get(word[max(0, j - k) : j])
            if number and j >= k:
                want[j] = np.logaddexp(want[j], want[j - k] + logs[number])
    got = lg.log_probabilities([word], vocabulary, lg.lift(p, vocabulary))[0]
    assert np.isfinite(got).all() and np.allclose(got, want[-1], rtol=1e-9)


def test_long_runs_are_learned(monkeypatch):
    vocabulary, p = long_runs()
    words, times = [b"abc" * 40, b"xabca" * 20, b"abc"], np.array([3.0, 2.0, 1.0])
    got = lg.expected_counts(words, times, vocabulary, p[:, 0])
    monkeypatch.setattr(lg, "LONGEST_TOGETHER", 1000)
    assert got[vocabulary.of[b"abc"]] > 100 and np.allclose(got, lg.expected_counts(words, times, vocabulary, p[:, 0]))
    monkeypatch.undo()
    assert lg.expected_counts([b"abc" * 3000], np.array([1.0]), vocabulary, p[:, 0])[vocabulary.of[b"abc"]] > 2900
