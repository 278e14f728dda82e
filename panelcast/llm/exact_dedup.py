"""Exact duplicates by content-defined chunk recipes.

A text (white space deleted) is cut where a rolling hash of its last 32 bytes says so, so the cuts
depend on the content around them alone.  A chunk's identifier is its 64-bit hash, *verified*: all
distinct chunk contents are compared, and where different contents share a hash each gets an ordinal
of its own.  A document is then only its ordered list of identifiers, about eight bytes for two
kilobytes of text: equal lists mean equal texts, and only lists are grouped and joined.

Defined cases: null text counts as empty, and all empty texts are equal.  A null ``doc_id`` loses
every tie.  Repeated rows are members of their group like any other row, and one of them stays.
A very long text is a list of chunk identifiers; rows of equal length are told apart by ``doc_id``.  Columns other than ``doc_id`` and
``text`` are ignored, or carried along by ``drop_duplicates``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import keep_rows, salt_of, salted_lookup, text_batches, text_key
from panelcast.sources.staging import stage

SPACE = b" \t\n\x0b\x0c\r"
WINDOW = 32
LEAST, MOST, MEAN_BITS = 512, 8192, 11


def gear_table() -> np.ndarray:
    """256 pseudo-random 32-bit numbers from a fixed rule."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], dtype=np.uint32)


def candidate_ends(data: np.ndarray, gear: np.ndarray, mean_bits: int = MEAN_BITS) -> np.ndarray:
    """Positions after which the rolling hash of the last 32 bytes asks for a cut, for all bytes at once."""
    h = gear[data]
    step = 1
    while step < WINDOW:  # doubles the bytes each hash covers
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
        step *= 2
    return np.flatnonzero(h >> np.uint32(32 - mean_bits) == 0) + 1


def cut(start: int, end: int, ends: np.ndarray, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of the text at [start, end): first candidate at least ``least`` away, ``most`` at the latest."""
    out, at = [], start
    while end - at > least:
        i = int(np.searchsorted(ends, at + least))
        nxt = int(ends[i]) if i < len(ends) else end
        at = min(nxt, at + most, end)
        out.append(at)
    if at < end or not out:
        out.append(end)
    return out


def chunks_of(texts: list[bytes], gear: np.ndarray) -> list[list[bytes]]:
    """Chunks of each text (white space already deleted); an empty text is one empty chunk."""
    joined = b"".join(texts)
    ends = candidate_ends(np.frombuffer(joined, dtype=np.uint8), gear) if len(joined) > WINDOW else np.empty(0, dtype=np.int64)
    out, at = [], 0
    for text in texts:
        stop, parts, last = at + len(text), [], at
        for e in cut(at, stop, ends):  # a cut is at least LEAST bytes into its text: the hash never sees a neighbour
            parts.append(joined[last:e])
            last = e
        out.append(parts)
        at = stop
    return out


def hash_of(chunk: bytes, bits: int) -> int:
    return xxhash.xxh64_intdigest(chunk, 7) & ((1 << bits) - 1)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def recipe_batches(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = gear_table()
        for batch in batches:
            for first, texts in text_batches(batch, "text"):
                bare = [t.translate(None, SPACE) for t in texts]
                recipes = [b"".join(hash_of(c, bits).to_bytes(8, "big") for c in parts) for parts in chunks_of(bare, gear)]
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), part.column("n_points"), pa.array(recipes, pa.binary()),
                     pa.array([hashlib.sha256(t).hexdigest() for t in bare], pa.string())],
                    names=["doc_id", "text_key", "n_points", "recipe", "text_sha256"],
                )

    return run


def chunk_batches(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = gear_table()
        for batch in batches:
            for first, texts in text_batches(batch, "text"):
                bare = [t.translate(None, SPACE) for t in texts]
                row, pos, hashes, contents = [], [], [], []
                for i, parts in enumerate(chunks_of(bare, gear)):
                    row += [first + i] * len(parts)
                    pos += range(len(parts))
                    hashes += [signed(hash_of(c, bits)) for c in parts]
                    contents += parts
                ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
                keys = batch.column("text_key").take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, keys, pa.array(pos, pa.int64()), pa.array(hashes, pa.int64()), pa.array(contents, pa.binary())],
                    names=["doc_id", "text_key", "pos", "hash", "chunk"],
                )

    return run


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Action, stages: (doc_id, text_key, n_points, recipe, text_sha256) per row; equal recipes are equal texts.

    ``bits`` shortens the hash, for tests of the way colliding chunks take.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(F.col("text")).alias("text_key"), F.length(text).cast("long").alias("n_points"))
    out = stage(rows.mapInArrow(recipe_batches(bits), "doc_id long, text_key long, n_points long, recipe binary, text_sha256 string"))
    chunks = rows.select("doc_id", "text_key", "text").mapInArrow(chunk_batches(bits), "doc_id long, text_key long, pos long, hash long, chunk binary")
    contents = chunks.select("hash", "chunk").distinct()
    shared = stage(contents.groupBy("hash").count().where("count > 1").select("hash"))
    if shared.isEmpty():
        return out  # every hash has one content: the hash identifies it
    # Chunks that share a hash: number their contents, and rebuild the recipes that hold such a hash.
    numbered = contents.join(shared, "hash", "left_semi").withColumn("ordinal", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")) - 1)
    entry = F.concat(F.lpad(F.hex("hash"), 16, "0"), F.lpad(F.hex("ordinal"), 16, "0"))
    spelled = (
        chunks.join(numbered, ["hash", "chunk"], "left").withColumn("ordinal", F.coalesce("ordinal", F.lit(0)))
        .groupBy("doc_id", "text_key", "pos").agg(F.min(entry).alias("entry"))
        .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("pos", "entry"))).alias("entries"))
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), F.encode(F.array_join("entries.entry", ""), "utf-8").alias("exact"))
    )
    exact = out.join(spelled, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text")))
    return stage(exact.select("doc_id", "text_key", "n_points", F.col("exact").alias("recipe"), "text_sha256"))


def dedup(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_key.

    Of equal texts the row with the most code points stays, then the smallest doc_id.
    """
    rows = recipes(docs, bits)
    # copies may be a third of all rows: partial results per task, then one row per recipe
    best = F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id")))
    groups = rows.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = groups.select("recipe", F.col("best.doc_id").alias("keep_id"), "group_size")
    joined = salted_lookup(rows, groups, "recipe", salt_of("doc_id"))
    again = Window.partitionBy("recipe", salt_of("doc_id"), "doc_id").orderBy(F.desc("n_points"), "text_key")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(again) == 1)
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "text_key")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged."""
    return keep_rows(docs, dedup(docs).where("kept"))
