"""Longest-processing-time sharding.

Equal texts form a group that stays together.  Groups go to shards by size, largest first, each to
the shard with the least load, kept in a heap.  The heap must see every item in turn, so the items
are bounded whatever the input: groups of at least ``total / ITEMS`` bytes (at most ``ITEMS`` of
them) are items of their own, all smaller groups are first packed by hash into ``ITEMS`` bundles,
which are items like the others.  With 16,384 items the bundles end far below a shard's load, and
the largest of them is what shards may differ by.

Slots are gapless from 0 in each shard: rows are numbered inside buckets of a shard, buckets are
offset by the counts before them, so no task sees a whole shard.

Defined cases: null text weighs nothing, has crc 0 and is grouped with empty text.  Null doc_ids come
first in their bucket.  Repeated rows are rows of their group.  A very long text
only counts its bytes.  Items of equal size go in order of their key, equally loaded shards in order of their number.  Other
columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import salt_of, salted_lookup
from panelcast.sources.staging import stage

ITEMS = 1 << 14
ROW_BYTES = 8
#: Rows of one numbering task, about.
BUCKET_ROWS = 1 << 17


def longest_first(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Item → shard for (item, size): largest first (ties: smallest item), to the least load (ties: smallest shard)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for item, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def group_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def assign(docs: DataFrame, shards: int = 24, items: int = ITEMS) -> DataFrame:
    """Action, stages: doc_id, size, text_crc32, shard, slot of each row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), group_of(F.col("text")).alias("text_group"),
    ))
    groups = rows.groupBy("text_group").agg(F.sum("size").alias("bytes"))
    groups = stage(groups)
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    # bundles are numbered below `items`; a group of its own carries a negative number
    bundle = F.pmod(F.xxhash64("text_group"), F.lit(items))
    large = groups.where(F.col("bytes") * items >= total)
    own = {-1 - i: r for i, r in enumerate(sorted(large.collect(), key=lambda r: bytes(r.text_group)))}  # at most `items` rows
    small = groups.where(F.col("bytes") * items < total).groupBy(bundle.alias("item")).agg(F.sum("bytes").alias("bytes")).collect()  # at most `items` rows
    sizes = [(k, r.bytes) for k, r in own.items()] + [(r.item, r.bytes) for r in small]
    shard_of = longest_first(sizes, shards)
    alone = spark.createDataFrame([(r.text_group, shard_of[k]) for k, r in own.items()], "text_group binary, own_shard int")
    packed = spark.createDataFrame([(r.item, shard_of[r.item]) for r in small], "item long, item_shard int")
    # both tables have at most `items` rows, so broadcasting them is bounded
    placed = (
        rows.withColumn("item", bundle).join(F.broadcast(alone), "text_group", "left").join(F.broadcast(packed), "item", "left")
        .withColumn("shard", F.coalesce("own_shard", "item_shard"))
    )
    return number(placed.select("doc_id", "size", "text_crc32", "shard"), shards)


def number(placed: DataFrame, shards: int) -> DataFrame:
    """Add ``slot``: gapless from 0 in each shard."""
    placed = stage(placed)
    n = placed.count()
    buckets = n // (BUCKET_ROWS * shards) + 8
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("_n", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("_n")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Action: write the whole documents with their shard and slot, one folder per shard."""
    placed = assign(docs, shards).select("doc_id", "text_crc32", "shard", "slot").dropDuplicates(["doc_id", "text_crc32"])
    keyed = docs.withColumn("_crc", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("p._id")) & (F.col("d._crc") == F.col("p.text_crc32"))
    joined = keyed.join(placed.withColumnRenamed("doc_id", "_id").alias("p"), same).drop("_id", "_crc", "text_crc32")
    joined.write.partitionBy("shard").parquet(path)
