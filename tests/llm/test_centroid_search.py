from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from panelcast.llm import centroid_search as cs

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance long, `a.b` string"


def full_search(vectors, centroids):
    d = [[sum((int(x) - int(c)) ** 2 for x, c in zip(v, row)) for row in centroids] for v in vectors]
    return [r.index(min(r)) for r in d], [min(r) for r in d]


@pytest.mark.parametrize("spread", [3, 60, 5000, 1 << 23, 1 << 40])
def test_search_equals_full_search(spread):
    rng = np.random.default_rng(spread)
    centroids = rng.integers(-spread, spread, (9, 6)).tolist()
    centroids[7] = centroids[2]  # a tie
    vectors = rng.integers(-spread, spread, (400, 6))
    vectors[:9] = centroids
    vectors = vectors if spread < cs.SMALL else vectors.astype(object)
    number, distance = cs.Search(centroids).nearest(vectors)
    assert (number.tolist(), [int(d) for d in distance]) == full_search(vectors.tolist(), centroids)


def test_search_of_mixed_sizes():
    small, large = [[0, 0], [1, 5]], [[1 << 30, 3], [2, 2]]
    for centroids, vectors in ((small, np.array(large, dtype=object)), (large, np.array(small))):
        number, distance = cs.Search(centroids).nearest(vectors)
        assert (number.tolist(), [int(d) for d in distance]) == full_search(vectors.tolist(), centroids)


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    centre = rng.integers(-300, 300, (8, 64)) + np.arange(8)[:, None] * 200
    vectors = centre[rng.integers(0, 8, 2000)] + rng.integers(-40, 40, (2000, 64))
    search = cs.Search(centre.tolist())
    number, distance = search.nearest(vectors)
    assert (number.tolist(), distance.tolist()) == full_search(vectors.tolist(), centre.tolist())
    assert search.distances < 2000 * 8 / 3


def test_digits():
    for value in (0, 1, -1, 5 << 90, -(7 << 61) + 3, (1 << 30) - 1, 1 << 30, -(1 << 30), -(1 << 30) - 1):
        assert sum(d << (cs.DIGIT * p) for p, d in cs.digits(value)) == value


def brute(rows, k=8, rounds=10, seed="3", size=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in drawn]
    for _ in range(rounds):
        number, _ = full_search([v for _, v in kept], centroids)
        for c in range(len(centroids)):
            members = [v for (_, v), n in zip(kept, number) if n == c]
            if members:
                centroids[c] = [sum(col) // len(members) for col in zip(*members)]
    number, distance = full_search([v for _, v in kept], centroids)
    inertia = [sum(d for d, n in zip(distance, number) if n == c) for c in range(len(centroids))]
    return sorted(((i, n, d, inertia[n], sum(distance), [str(x) for x in centroids[n]]) for (i, _), n, d in zip(kept, number, distance)), key=repr)


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 9, 9, "x") for i, v in vectors], SCHEMA)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_awkward(spark):
    rng = np.random.default_rng(5)
    vec = [[float(np.float32(x)) for x in v] for v in rng.normal(0, 0.1, (60, 64))]
    rows = [(i, v) for i, v in enumerate(vec)] + [(3, vec[3]), (3, vec[3]), (None, vec[0]), (-7, vec[1])]
    rows += [(100, None), (101, []), (102, vec[0][:63]), (103, vec[0] + [0.0]), (104, [None] + vec[0][1:]), (105, [float("nan")] + vec[0][1:]), (106, [float("-inf")] + vec[0][1:])]
    got = result(cs.cluster(table(spark, rows)))
    assert got == brute(rows) and len(got) == 64
    few = rows[:3]
    assert result(cs.cluster(table(spark, few))) == brute(few)  # fewer vectors than centroids
    same = [(i, vec[0]) for i in range(20)]
    assert result(cs.cluster(table(spark, same))) == brute(same)  # ties everywhere, empty centroids
    assert cs.cluster(table(spark, [])).count() == 0
    assert cs.cluster(table(spark, rows[-7:])).count() == 0


def test_huge_components(spark):
    vec = [[float(np.float32(x)) for x in v] for v in np.random.default_rng(6).normal(0, 1, (12, 4))]
    rows = [(i, [x * (1e6 if i % 3 else 1e30) for x in v]) for i, v in enumerate(vec)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    want = [(i, n, min(d, cs.MOST), min(ci, cs.MOST), min(t, cs.MOST), c) for i, n, d, ci, t, c in brute(rows, 3, 4, size=4)]
    got = result(cs.cluster(table(spark, rows), 4, 3, 4))
    assert [r[:2] + r[5:] for r in got] == [r[:2] + r[5:] for r in want] and [r[2] for r in got] == [r[2] for r in want]
