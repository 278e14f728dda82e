"""Periodic runs of words by an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q that is at least ``max(LEAST, 2 q)``
words long and that no neighbouring word extends.  The documents of a batch are laid one behind the
other; the letter of a place is (document, word), so nothing repeats across documents and one suffix
array serves all of them.  It is built by prefix doubling in which only unresolved groups are sorted
again; the ranks of every doubling are kept, because two blocks of 2^t words are equal exactly if
their ranks at t are.

Squares come from the branching-tandem test on LCP intervals, without tree nodes: an interval of
depth d is a range of ranks with a boundary at its least LCP, split child by child.  Of both sides
only the smaller is visited; its suffix i starts (ends) a square of period d that cannot be rotated to
the right if ISA[i + d] (ISA[i - d]) lies in the other side.  Every run has one such square for each
multiple of its period.  Squares are rotated to the left by blocks of falling powers of two; those
that meet in the same stretch are one run, its period is the smallest.  Time is O(n log n) array
steps; memory of a task is a batch of about 1 MB of text, or one longer text: about 100 bytes a word
and 4 more for every doubling up to the longest repetition.

Defined cases: null or blank text has no words, no runs and an empty collapsed text.  A very long text
is one batch.  Runs that start together are told apart by their period.  Repeated rows and null
doc_ids are treated like others; other columns are ignored, whatever their names.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import text_batches

#: Words a run has at least.
LEAST = 12
BATCH_BYTES = 1 << 20
#: Suffixes of smaller children looked at in one array step.
STEP = 1 << 20

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def letters(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(document, word) of every place as one number, and the first place of every document (one more than documents)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    number = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
    word = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    return np.repeat(np.arange(len(texts)), sizes) * max(len(number), 1) + word, np.concatenate([[0], np.cumsum(sizes)])


def heads(keys: np.ndarray) -> np.ndarray:
    """For sorted keys: is a place the first of its group?"""
    first = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    return first


def suffix_array(letter: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and for each t the rank of every block of 2^t letters (with -1 behind the end).

    A rank is the place of the group's first member in the array, so the last ranks are the inverse array.
    """
    n = len(letter)
    order = np.argsort(letter, kind="stable")
    first = heads(letter[order])
    rank = np.full(n + 1, -1, dtype=np.int32)
    at = np.flatnonzero(first)
    rank[order] = np.repeat(at, np.diff(np.append(at, n)))
    levels, slots, h = [rank], np.arange(n), 1
    while True:
        alone = first & np.append(first[1:], True)
        slots = slots[~alone]  # whole groups, in order
        if not len(slots):
            return order, levels
        open_ = order[slots]
        behind = levels[-1][np.minimum(open_ + h, n)].astype(np.int64) + 1
        key = levels[-1][open_].astype(np.int64) * (n + 1) + behind
        by = np.argsort(key, kind="stable")
        open_, first = open_[by], heads(key[by])
        order[slots] = open_
        at = np.flatnonzero(first)
        rank = levels[-1].copy()
        rank[open_] = np.repeat(slots[at], np.diff(np.append(at, len(open_))))
        levels.append(rank)
        h *= 2


def common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """Length of the longest common stretch from a and b on (or, ``back``, up to a and b), for a <> b."""
    n, done = len(levels[0]) - 1, np.zeros(len(a), dtype=np.int64)
    for t in range(len(levels) - 1, -1, -1):
        if back:
            x, y = a - done - (1 << t), b - done - (1 << t)
            same = (np.minimum(x, y) >= 0) & (levels[t][np.maximum(x, 0)] == levels[t][np.maximum(y, 0)])
        else:
            same = levels[t][np.minimum(a + done, n)] == levels[t][np.minimum(b + done, n)]
        done += same.astype(np.int64) << t
    return done


def nearest(depth: np.ndarray, open_: np.ndarray, step: int, strict: bool) -> np.ndarray:
    """For every ``open_`` place the nearest one before (step -1) or behind (+1) it with a smaller depth, or, not ``strict``, one not greater.

    Pointers jump along pointers; all other places are less deep.
    """
    to = np.arange(len(depth)) + step
    places = open_
    while len(open_):
        over = depth[to[open_]] >= depth[open_] if strict else depth[to[open_]] > depth[open_]
        open_ = open_[over]
        to[open_] = to[to[open_]]
    return to[places]


def squares(order: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square that cannot be rotated to the right, each once."""
    n, inverse = len(order), levels[-1]
    depth = np.zeros(n + 1, dtype=np.int64)  # depth[k]: LCP of the suffixes at k - 1 and k
    near = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    depth[near] = common(levels, order[near - 1], order[near])
    low, high = nearest(depth, near, -1, strict=False), nearest(depth, near, 1, strict=True)  # sides [low, near) and [near, high)
    left = near - low <= high - near
    start, size = np.where(left, low, near), np.where(left, near - low, high - near)
    other, other_end = np.where(left, near, low), np.where(left, high, near)
    cut = np.append(0, np.cumsum(size))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    first = 0
    while first < len(near):
        last = max(first + 1, int(np.searchsorted(cut, cut[first] + STEP, "right")) - 1)
        part = slice(first, last)
        node = np.repeat(np.arange(first, last), size[part])
        suffix = order[start[node] + np.arange(len(node)) - (cut[node] - cut[first])]
        d = depth[near[node]]
        for place, begin in ((suffix + d, suffix), (suffix - d, suffix - d)):
            inside = (place >= 0) & (place < n)
            r = inverse[np.where(inside, place, 0)]
            hit = inside & (r >= other[node]) & (r < other_end[node])
            found.append((begin[hit], d[hit]))
        first = last
    return tuple(np.concatenate([x[k] for x in found] or [np.empty(0, np.int64)]) for k in (0, 1))


def runs_of(letter: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least ``least`` letters, by start, then period."""
    if len(letter) < 2:
        return (np.empty(0, np.int64),) * 3
    order, levels = suffix_array(letter)
    begin, period = squares(order, levels)
    end = begin + 2 * period
    begin = begin - common(levels, begin, begin + period, back=True)
    keep = end - begin >= least
    begin, end, period = begin[keep], end[keep], period[keep]
    by = np.lexsort((period, end, begin))
    begin, end, period = begin[by], end[by], period[by]
    once = np.ones(len(begin), dtype=bool)
    once[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])  # a stretch's smallest period
    begin, length, period = begin[once], (end - begin)[once], period[once]
    by = np.lexsort((period, begin))
    return begin[by], length[by], period[by]


def analysed(doc_ids: list[int | None], texts: list[bytes], least: int, rewrite: Rewrite | None) -> pa.RecordBatch:
    words = [t.split() for t in texts]  # bytes split at ASCII white space only
    if rewrite:
        words = [rewrite(d, w) for d, w in zip(doc_ids, words)]
    letter, first = letters(words)
    begin, length, period = runs_of(letter, least)
    document = np.searchsorted(first, begin, "right") - 1
    dropped = np.zeros(len(letter) + 1, dtype=np.int64)
    np.add.at(dropped, begin + period, 1)
    np.add.at(dropped, begin + length, -1)
    dropped = np.cumsum(dropped) > 0
    touched = set(document.tolist())
    collapsed = [
        b" ".join(w for w, out in zip(ws, dropped[first[k] : first[k + 1]].tolist()) if not out) if k in touched else b" ".join(ws)
        for k, ws in enumerate(words)
    ]
    fields = [pa.array(x, pa.int64()) for x in (begin - first[document], length, period)]
    offsets = pa.array(np.searchsorted(document, np.arange(len(texts) + 1)), pa.int32())
    runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
    columns = [pa.array(doc_ids, pa.int64()), pa.array(np.diff(first), pa.int64()), runs, pa.array(collapsed, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, least: int = LEAST, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of every row.

    The collapsed text has the words, joined by one space, without those that any run holds after its first period.
    ``rewrite`` may replace a document's words first.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids = batch.column("doc_id").to_pylist()
            for at, texts in text_batches(batch, "text", BATCH_BYTES):
                yield analysed(ids[at : at + len(texts)], texts, least, rewrite)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    found = rows.mapInArrow(batches, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000L * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
