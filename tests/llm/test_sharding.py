from __future__ import annotations

import zlib
from collections import defaultdict

from panelcast.llm import sharding as sh

from .helpers import PLAIN, awkward, docs, empty


def brute(sizes, shards):
    loads, out = [0] * shards, {}
    for item, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        k = min(range(shards), key=lambda s: (loads[s], s))
        loads[k] += size
        out[item] = k
    return out


def test_heap_equals_search():
    sizes = [(i, (i * 7919) % 1000 + 1) for i in range(500)]
    assert sh.longest_first(sizes, 7) == brute(sizes, 7)


def check(df, got, shards):
    texts = [(r.doc_id, r.text) for r in df.collect()]
    rows = got.collect()
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
    of_text = defaultdict(set)
    for r in rows:
        of_text[r.text_crc32].add(r.shard)
    assert all(len(v) == 1 for v in of_text.values())


def test_awkward(spark):
    df = awkward(spark)
    check(df, sh.assign(df, 5), 5)
    check(df, sh.assign(df, 3, items=2), 3)  # nearly all groups in bundles
    assert sh.assign(empty(spark), 24).count() == 0


def test_balance(spark):
    df = docs(spark, [PLAIN[: 10 + i % 90] + str(i) for i in range(3000)])
    got = sh.assign(df, 8)
    check(df, got, 8)
    loads = [r[1] for r in got.groupBy("shard").sum("size").collect()]
    assert max(loads) - min(loads) <= 128


def test_written_shards(spark, tmp_path):
    df = awkward(spark)
    sh.write_shards(df.drop("shard"), str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()
