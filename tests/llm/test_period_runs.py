from __future__ import annotations

import hashlib
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import period_runs as pr
from panelcast.llm.queries import planted_period

from .helpers import awkward, docs, empty


def brute(words, least):
    """Every stretch against every period, straight from the definition."""
    out, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)  # smallest period first
            i = max(j, i) + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def kept(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), max_size=5), st.integers(2, 12))
def test_equals_brute_force(texts, least):
    got = pr.analysed(list(range(len(texts))), [" ".join(t).encode() for t in texts], least, None).to_pylist()
    for words, row in zip(texts, got, strict=True):
        want = brute(words, least)
        assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == want
        assert row["collapsed"].decode() == kept(words, want) and row["n_words"] == len(words)


def fibonacci(k):
    a, b = "a", "ab"
    for _ in range(k):
        a, b = b, b + a
    return b


@pytest.mark.parametrize("word", ["a" * 300, "ab" * 100 + "a", "aab" * 60 + "b", fibonacci(11), ("abc" * 20 + "d") * 6, "abcdefghij" * 20])
def test_highly_periodic(word, monkeypatch):
    monkeypatch.setattr(pr, "STEP", 50)
    got = pr.runs_of(np.array([ord(c) for c in word]))
    assert list(zip(*(x.tolist() for x in got))) == brute(word, pr.LEAST)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    letter = rng.integers(0, 3, 400)
    order, levels = pr.suffix_array(letter)
    text = letter.tolist()
    assert order.tolist() == sorted(range(400), key=lambda i: text[i:])
    assert levels[-1][order].tolist() == list(range(400))


def test_megabytes():
    """One text of 6 MB: a million words, first periodic throughout, then without repetition."""
    began = time.time()
    (row,) = pr.analysed([1], [b"alpha beta gamma delta " * 250_000], pr.LEAST, None).to_pylist()
    assert [tuple(r.values()) for r in row["runs"]] == [(0, 1_000_000, 4)] and row["collapsed"] == b"alpha beta gamma delta"
    (row,) = pr.analysed([1], [b" ".join(b"w%d" % i for i in range(800_000))], pr.LEAST, None).to_pylist()
    assert row["runs"] == [] and row["n_words"] == 800_000
    assert time.time() - began < 60


def test_awkward(spark):
    df = awkward(spark)
    got = sorted(pr.find_runs(df).collect(), key=repr)
    assert len(got) == df.count()
    assert sorted((repr(r.doc_id), r.n_words) for r in got) == sorted((repr(r.doc_id), len((r.text or "").encode().split())) for r in df.collect())
    for r in got:
        if r.doc_id == 9:  # 400 copies without a blank between them: last and first word are one from the second copy on
            assert [(x.start, x.period) for x in r.runs] == [(1, 23)] and len(r.collapsed.split()) == 1 + 23 + 1
        else:
            assert not r.runs
    assert pr.find_runs(empty(spark)).count() == 0
    digests = pr.digests(pr.find_runs(df))
    blank = digests.where("doc_id = 0").first()
    nothing = hashlib.sha256(b"").hexdigest()
    assert blank[1:] == (0, None, None, None, None, nothing, nothing)


def test_query_on_fixture(spark):
    """Digests of planted periods against the definition."""
    texts = [" ".join("abcdefgh"[(i * k) % 7] for k in range(3 + i % 90)) for i in range(120)]
    got = {r.doc_id: r for r in pr.digests(pr.find_runs(docs(spark, texts), rewrite=planted_period)).collect()}
    seen = 0
    for i, t in enumerate(texts):
        h, words = zlib.crc32(str(i).encode()), t.split()
        if h % 10 == 0:
            n, g = len(words), h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            seen += 1
        runs = brute(words, 12)
        r = got[i]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept(words, runs).encode()).hexdigest()
        if runs:
            s, n, q = max(runs, key=lambda x: (x[1], -x[0], -x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert seen > 5
