"""Integer k-means whose assignment is an equal-average equal-variance nearest-neighbour search.

Vectors are made of integers, floor(1024 x) for every component x.  Centroids are sorted by component
sum.  A vector starts at the place of its own sum and looks outward in both directions.  With S the
sum, W = k sum(x^2) - S^2 (k^2 times the variance) and best the least squared distance so far, a
direction ends where ``(S_x - S_c)^2 > k best``, a centroid is passed over where
``(S_x - S_c)^2 + (sqrt W_x - sqrt W_c)^2 > k best``, and only the others get their distance.  All
of it is integer arithmetic: roots are taken down to integers and their difference is lessened by one,
so no bound ever exceeds the true one and ties are decided as by full search (smaller number first).

A round is one scan: tasks search batch by batch and give the count and component sums of every
centroid once, Spark adds them up, and the driver takes k x 64 exact sums and new centroids (a bounded
size).  Nothing else leaves the executors; the last assignment is staged once for the inertia.  Every
round reads the given DataFrame again: stage it before if it is costly.

Defined cases: vectors that are null, have another number of components or a null or non-finite one
are left out.  Components of any size are right: batches with one of 2^24 or more are searched in
unbounded integers, sums travel as digits; a squared distance or inertia that no long can hold is given as
the largest long.  Vectors of equal hash are drawn by their components; a null id is hashed last.
Fewer vectors than centroids give as many centroids as vectors; an empty centroid stays where it is.
Repeated rows count as often as they occur.  Other columns are ignored, whatever their names.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.sources.staging import stage

SCALE = 1024
#: Below this size of a component all squares of the search fit in 64 bits.
SMALL = 1 << 24
#: Sums travel as digits of this many bits, so that adding up tasks never overflows.
DIGIT = 30
MOST = (1 << 63) - 1
ROWS = 8192


def usable(vectors: DataFrame, size: int, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and vec (array of doubles) of the rows with exactly ``size`` finite components."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vec"))
    return rows.where(F.col("vec").isNotNull() & (F.size("vec") == size) & finite)


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(1024 x) as 64-bit integers, or as Python integers where a component is large."""
    with np.errstate(over="ignore"):
        product = np.floor(values * SCALE)  # exact: a power of two
    if product.size == 0 or np.abs(product).max() < SMALL:
        return product.astype(np.int64)
    whole = [int(p) if np.isfinite(p) else int(x) * SCALE for p, x in zip(product.ravel(), values.ravel())]
    out = np.empty(values.size, dtype=object)
    out[:] = whole
    return out.reshape(values.shape)


def root(values: np.ndarray) -> np.ndarray:
    """Square roots rounded down to integers."""
    if values.dtype == object:
        return np.array([isqrt(int(v)) for v in values], dtype=object)
    r = np.sqrt(values.astype(np.float64)).astype(np.int64)
    r -= r * r > values
    return r + ((r + 1) * (r + 1) <= values)


class Search:
    """Exact nearest centroid of every vector of a batch."""

    def __init__(self, centroids: list[list[int]]):
        large = any(abs(c) >= SMALL for row in centroids for c in row)
        self.centroids = np.array(centroids, dtype=object if large else np.int64)
        self.size = self.centroids.shape[1]
        sums = self.centroids.sum(axis=1)
        by = np.argsort(sums, kind="stable")
        self.number, self.sums, self.sorted = by, sums[by], self.centroids[by]
        self.spread = root(self.size * (self.sorted * self.sorted).sum(axis=1) - self.sums * self.sums)
        self.distances = 0  # computed so far, of vectors x centroids

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) for every row of an integer matrix."""
        if vectors.dtype == object and self.centroids.dtype != object:
            return Search([[int(x) for x in row] for row in self.centroids.astype(object)]).widened().nearest(vectors)
        if self.centroids.dtype == object and vectors.dtype != object:
            vectors = vectors.astype(object)
        n, k, m = len(vectors), len(self.sums), self.size
        sums = vectors.sum(axis=1)
        spread = root(m * (vectors * vectors).sum(axis=1) - sums * sums)
        home = np.searchsorted(self.sums, sums)
        best = np.full(n, -1, dtype=vectors.dtype)  # none yet
        found = np.full(n, k, dtype=np.int64)
        going = {-1: np.arange(n), 1: np.arange(n)}
        for step in range(k):
            for side in (1, -1):
                rows = going[side]
                at = home[rows] + step if side == 1 else home[rows] - 1 - step
                inside = (at >= 0) & (at < k)
                rows, at = rows[inside], at[inside]
                gap = (sums[rows] - self.sums[at]) ** 2
                limit, none = m * best[rows], best[rows] < 0
                open_ = (none | (gap <= limit)).astype(bool)
                rows, at, gap, limit, none = rows[open_], at[open_], gap[open_], limit[open_], none[open_]
                going[side] = rows
                apart = np.maximum(abs(spread[rows] - self.spread[at]) - 1, 0)
                near = (none | (gap + apart * apart <= limit)).astype(bool)
                rows, at = rows[near], at[near]
                if not len(rows):
                    continue
                self.distances += len(rows)
                off = vectors[rows] - self.sorted[at]
                distance = (off * off).sum(axis=1)
                number = self.number[at]
                better = ((best[rows] < 0) | (distance < best[rows]) | ((distance == best[rows]) & (number < found[rows]))).astype(bool)
                best[rows[better]], found[rows[better]] = distance[better], number[better]
        return found, best

    def widened(self) -> Search:
        """The same search over unbounded integers."""
        for name in ("centroids", "sums", "sorted", "spread"):
            setattr(self, name, getattr(self, name).astype(object))
        return self


def matrices(parts: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in parts:
        for first in range(0, batch.num_rows, ROWS):
            part = batch.slice(first, ROWS)
            yield part, scaled(part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, size))


def digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit): value = sum of digit x 2^(30 place); only the last digit may be negative."""
    place = 0
    while value >> DIGIT not in (0, -1):
        yield place, value & ((1 << DIGIT) - 1)
        value, place = value >> DIGIT, place + 1
    yield place, value


def sums_of(rows: DataFrame, centroids: list[list[int]]) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """Action: members of every centroid, and the exact sum of their components by (centroid, component)."""
    size = len(centroids[0])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, count = Search(centroids), np.zeros(len(centroids), dtype=np.int64)
        total = np.zeros((len(centroids), size), dtype=object)
        for _, vectors in matrices(parts, size):
            number, _ = search.nearest(vectors)
            for c in np.unique(number):
                members = vectors[number == c]
                count[c] += len(members)
                total[c] += members.sum(axis=0).astype(object)
        out = [(int(c), -1, 0, int(count[c])) for c in np.flatnonzero(count)]
        out += [(int(c), j, place, digit) for c in np.flatnonzero(count) for j in range(size) for place, digit in digits(int(total[c, j]))]
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "component", "place", "part"])

    parts = rows.mapInArrow(batches, "cluster int, component int, place int, part long")
    count: dict[int, int] = {}
    total: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "component", "place").agg(F.sum("part").alias("part")).collect():  # centroids x components x digits
        if r.component < 0:
            count[r.cluster] = r.part
        else:
            key = (r.cluster, r.component)
            total[key] = total.get(key, 0) + (r.part << (DIGIT * r.place))
    return count, total


def first_centroids(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """Action: the k vectors with the smallest SHA-256 of seed:id."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    drawn = rows.orderBy(by.asc_nulls_last(), "vec").limit(k).collect()
    return [[int(x) for x in scaled(np.array([r.vec], dtype=np.float64))[0]] for r in drawn]


def fit(rows: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3") -> list[list[int]]:
    """Action: centroids after ``rounds`` rounds over ``usable`` rows."""
    centroids = first_centroids(rows, k, seed)
    for _ in range(rounds if centroids else 0):
        count, total = sums_of(rows, centroids)
        centroids = [[total[c, j] // count[c] for j in range(len(old))] if c in count else old for c, old in enumerate(centroids)]
    return centroids


def assign(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster and squared distance of every row."""
    size = len(centroids[0])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for part, vectors in matrices(parts, size):
            number, distance = search.nearest(vectors)
            distance = distance if distance.dtype != object else [min(int(d), MOST) for d in distance]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(batches, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, size: int = 64, k: int = 8, rounds: int = 10, seed: str = "3") -> DataFrame:
    """Action, stages: vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of decimals as text) of every usable vector."""
    spark: SparkSession = vectors.sparkSession
    rows = usable(vectors, size)
    centroids = fit(rows, k, rounds, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<string>"
    if not centroids:
        return spark.createDataFrame([], schema)
    placed = stage(assign(rows, centroids))
    sums = {r.cluster: int(r.total) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    of_cluster = [(c, min(s, MOST), min(sum(sums.values()), MOST), [str(x) for x in centroids[c]]) for c, s in sorted(sums.items())]
    known = spark.createDataFrame(of_cluster, "cluster int, cluster_inertia long, inertia long, centroid array<string>")
    return placed.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows


def cluster_sql(size: int = 64, k: int = 8, rounds: int = 10, seed: str = "3") -> str:
    """The same by full search, one step of plain SQL a round."""
    floor_mean = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
    steps = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {size} AND len([x FOR x IN embedding IF isfinite(x)]) = {size})",
        "v AS MATERIALIZED (SELECT r, j, CAST(floor(1024 * CAST(embedding[j] AS DOUBLE)) AS HUGEINT) AS x FROM kept, (SELECT unnest(range(1, " + f"{size + 1}" + ")) AS j))",
        f"seeds AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), embedding) - 1 AS c FROM kept)",
        f"c0 AS MATERIALIZED (SELECT c, j, x FROM seeds JOIN v USING (r) WHERE c < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{i} c ON v.j = c.j GROUP BY v.r, c.c)")
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT a.c, v.j, {floor_mean} AS x FROM a{i} a JOIN v USING (r) GROUP BY a.c, v.j)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, j, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN m{i} m USING (c, j))")
    return (
        "WITH " + ",\n".join(steps) + f",\nhashes AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY c)\n"
        "SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN hashes USING (c)"
    )
