from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from panelcast.llm import exact_dedup as ed
from panelcast.llm import near_dedup as nd

from .helpers import PLAIN, awkward, docs, empty, rows


def brute_exact(items):
    """(doc_id, keep_id, size) by comparing whole texts."""
    bare = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for i, t in items:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    return sorted(((i, min(groups[bare(t)])[3], len(groups[bare(t)])) for i, t in items), key=repr)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_equals_comparison_of_texts(spark, bits):
    """Three-bit hashes make nearly all chunks collide: the verified identifiers must still tell them apart."""
    rng = random.Random(1)
    long = ["".join(rng.choices("abcdefgh ", k=rng.randrange(1, 30_000))) for _ in range(30)]
    texts = long + [t.replace(" ", "  ") for t in long[:10]] + [t[:-1] + "z" for t in long[:10]] + ["", None, " "]
    df = docs(spark, texts)
    got = ed.dedup(df, bits)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got.collect()), key=repr) == brute_exact(list(enumerate(texts)))
    assert got.where("kept").count() == len({re.sub(r"\s", "", t or "") for t in texts})


def test_exact_awkward(spark):
    df = awkward(spark)
    items = [(r.doc_id, r.text) for r in df.collect()]
    got = ed.dedup(df)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got.collect()), key=repr) == brute_exact(items)
    kept = ed.drop_duplicates(df)
    assert kept.columns == df.columns
    assert kept.count() == len({re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in items})
    assert kept.where("doc_id = 9").count() == 1  # repeated row
    assert ed.dedup(empty(spark)).count() == 0 and ed.drop_duplicates(empty(spark)).count() == 0


def test_cuts_follow_content():
    rng = random.Random(2)
    body = bytes(rng.choices(range(97, 123), k=60_000))
    gear = ed.gear_table()
    (a,), (b,) = ed.chunks_of([body], gear), ed.chunks_of([b"other start" + body], gear)
    assert b"".join(a) == body
    assert len(set(a) & set(b)) > 0.8 * len(a)
    assert all(len(c) <= ed.MOST for c in a)
    assert ed.chunks_of([body, b"", body], gear) == [a, [b""], a]


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_fingerprints(spark):
    df = awkward(spark)
    want = sorted(((r.doc_id, f"{brute_print(r.text):016x}") for r in df.collect()), key=repr)
    got = nd.near_dedup(df)
    assert sorted(((r.doc_id, r.fingerprint) for r in got.collect()), key=repr) == want
    least = {}
    for i, p in want:
        if i is not None:
            least[p] = min(i, least.get(p, i))
    assert all(r.component_id <= least[r.fingerprint] for r in got.collect())
    kept = nd.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.where("doc_id = 9").count() <= 1
    assert nd.near_dedup(empty(spark)).count() == 0 and nd.drop_near_duplicates(empty(spark)).count() == 0


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 40, dtype=np.int64)
    prints = set(base.tolist())
    for b in base.tolist():
        for _ in range(25):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            value = b & 0xFFFFFFFFFFFFFFFF
            for f in flips:
                value ^= 1 << int(f)
            prints.add(value - (1 << 64) if value >> 63 else value)
    prints = sorted(prints)
    got = rows(nd.links(spark.createDataFrame([(p,) for p in prints], "print long")))
    arr = np.array(prints, dtype=np.int64).view(np.uint64)
    want = {(prints[i], prints[j]) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 3) + i + 1}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (100, 300)]
    got = dict(rows(nd.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}


def test_near_copies_leave_one(spark):
    words = PLAIN.split() * 30
    edited = list(words)
    edited[400] = "changed"
    kept = nd.drop_near_duplicates(docs(spark, [" ".join(words), " ".join(edited), "something else entirely is written in this one"]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
