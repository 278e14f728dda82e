"""Token-id files: canonical, length-limited Huffman codes over independent blocks.

Code lengths come from the counts of all ids (package-merge, at most 16 bits), so the code book is
one length per id.  A block holds the ids of consecutive whole documents; its bits can be decoded
alone, and the bit offset of every 256th id is stored with it, so reading may start at any of these
checkpoints and many stretches are decoded in step through one 2^16-entry table.

Layout of a file set (Parquet as the container, written by Spark into one folder):

* ``codes``  id, n_bits: the code book.
* ``blocks`` part, block, local_start (ids of the part before the block), n_ids, doc_ids, doc_tokens,
  checkpoints (bit offset of every 256th id), bits.  Ascending (part, block) is ascending doc_id.
* ``parts``  part, before (ids of all documents before the part).

Defined cases: null or empty text is the end id alone.  Null doc_ids come first.  Repeated rows are
encoded like others.  A very long text is encoded whole and lies in one block.  Ids with codes of equal length get them in order
of id.  Other columns are ignored, whatever their names.  An empty table gives empty files and an empty result.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import text_batches
from panelcast.sources.staging import stage, staging_root

MOST_BITS = 16
CHECKPOINT = 256
BLOCK_IDS = 1 << 15
#: Words a task remembers the ids of; beyond it starts anew.
REMEMBERED = 400_000
STAGED = "doc_id long, n_tokens long, ids binary"


# --- ids of texts ---------------------------------------------------------------------------------------------------

# Fixed value: the split pattern under which words may be encoded by their runs of letters, digits and signs.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin words whose runs split and lower-case one way only: no apostrophe, no special token, no fraction or raised digit.
PLAIN_WORD = re.compile("[!-&(-;=-~¡-±´-¸º»¿-įı-ɏ]+")
RUNS = re.compile(r"[^\W\d_]+|\d|(?:\W|_)+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WordEncoder:
    """Ids of texts through the library; words between ASCII white space are encoded once and then remembered.

    Right for tokenizers whose normaliser and pre-tokeniser never join or look across white space.  For
    the split pattern above, plain Latin words go to the library's model run by run, which spares most of the work: the
    same run stands in many words.
    """

    def __init__(self, path: str, width: int = 4):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.by_runs = runs_apply(path)
        self.code = {2: "H", 4: "I"}[width]
        # ids as little-endian bytes: joined without making a number of any of them
        self.words: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.letters = byte_letters()

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            spelled = run if run.isascii() else "".join(self.letters[b] for b in run.encode())
            ids = self.runs[run] = self.packed([t.id for t in self.model.tokenize(spelled)])
        return ids

    def learn(self, words: list[bytes]) -> None:
        if len(self.runs) > REMEMBERED:
            self.runs.clear()
        other = []
        for word in words:
            text = word.decode()
            if self.by_runs and PLAIN_WORD.fullmatch(text):
                lower = text.lower()
                self.words[word] = self.run(lower) if lower.isalpha() else b"".join(map(self.run, RUNS.findall(lower)))
            else:
                other.append(word)
        for word, coded in zip(other, self.whole.encode_batch([w.decode() for w in other], add_special_tokens=False)):
            self.words[word] = self.packed(coded.ids)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian integers."""
        split = [t.split() for t in texts]
        every = set(chain.from_iterable(split))
        if len(self.words) > REMEMBERED:
            self.words.clear()
        self.learn(list(every.difference(self.words)))
        return [b"".join(map(self.words.__getitem__, words)) for words in split]


def runs_apply(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        pipeline = json.load(f)
    steps = [(x["type"], x.get("pattern")) for x in (pipeline.get("normalizer") or {}).get("normalizers", [])]
    splits = (pipeline.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return steps == [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)] and splits[0].get("pattern") == {"Regex": SPLIT} and splits[-1].get("type") == "ByteLevel"


def id_bytes(tokenizer: str) -> int:
    """Bytes an id needs: 2 for vocabularies of up to 65,536 ids, else 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4


def id_batches(tokenizer: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encoder = WordEncoder(tokenizer, width)
        end = encoder.packed([end_id])
        for batch in batches:
            for first, texts in text_batches(batch, "text"):
                ids = [x + end for x in encoder.encode(texts)]
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "n_tokens", "ids"],
                )

    return run


# --- the code -------------------------------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids do not fit codes of {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(most):  # each level: the symbols merged with the pairs of the level below
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank)
        merged = merged[rank]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take, n = 2 * (len(used) - 1), len(used)
    depth = np.zeros(n, dtype=np.int64)
    for rank in reversed(levels):  # how many of the first `take` items are symbols, how many are pairs
        chosen = rank[:take]
        depth[chosen[chosen < n]] += 1
        take = 2 * int((chosen >= n).sum())
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each id, table of 2^16 entries: id << 5 | bits)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.left_shift(np.int64(1), MOST_BITS - lengths[order].astype(np.int64))
    firsts = np.cumsum(spans) - spans
    codes = np.zeros(len(lengths), dtype=np.uint64)
    codes[order] = (firsts >> (MOST_BITS - lengths[order].astype(np.int64))).astype(np.uint64)
    lookup = np.repeat(order.astype(np.int64) << 5 | lengths[order], spans)
    return codes, np.pad(lookup, (0, (1 << MOST_BITS) - len(lookup)))


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits as bytes with padding for wide reads, bit offset of every 256th id)."""
    n_bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(n_bits)
    starts = ends - n_bits
    total = int(ends[-1]) if len(ends) else 0
    words, inside = starts >> 5, starts & 31
    wide = codes[ids] << (64 - inside - n_bits).astype(np.uint64)  # the code within two 32-bit words
    size = (total >> 5) + 3
    # bits of different ids never overlap, so adding them is exact
    out = np.bincount(words, (wide >> np.uint64(32)).astype(np.float64), size) + np.bincount(words + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    return out.astype(">u4").tobytes(), starts[::CHECKPOINT]


def unpack(blocks: list[bytes], checkpoints: list[np.ndarray], sizes: list[int], lookup: np.ndarray) -> list[np.ndarray]:
    """Ids of each block: all stretches between checkpoints, of all blocks, are decoded in step."""
    lane_block = np.repeat(np.arange(len(blocks)), [len(c) for c in checkpoints])
    base = np.cumsum([0] + [len(b) for b in blocks])
    data = np.frombuffer(b"".join(blocks), dtype=np.uint8).astype(np.uint32)
    at = np.concatenate(checkpoints).astype(np.int64) + base[lane_block] * 8 if len(lane_block) else np.empty(0, np.int64)
    within = np.concatenate([np.arange(len(c)) for c in checkpoints]) if len(lane_block) else at
    left = np.minimum(np.asarray(sizes)[lane_block] - within * CHECKPOINT, CHECKPOINT) if len(lane_block) else at
    order = np.argsort(-left, kind="stable")  # long stretches first, so that finished ones fall off the end
    at, left = at[order], left[order]
    lanes = np.zeros((len(at), CHECKPOINT), dtype=np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -k, side="left"))
        pos = at[:live]
        byte = pos >> 3
        window = (data[byte] << 16) | (data[byte + 1] << 8) | data[byte + 2]
        hit = lookup[(window >> (8 - (pos & 7)).astype(np.uint32)) & 0xFFFF]
        lanes[:live, k] = hit >> 5
        at[:live] += hit & 31
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    lanes = lanes[back]
    out, lane = [], 0
    for c, n in zip(checkpoints, sizes):
        out.append(lanes[lane : lane + len(c)].reshape(-1)[:n])
        lane += len(c)
    return out


# --- files ----------------------------------------------------------------------------------------------------------

def encode_texts(docs: DataFrame, tokenizer: str, end_id: int, width: int = 4) -> DataFrame:
    """Lazy: (doc_id, n_tokens, ids as little-endian integers of ``width`` bytes), the end id behind each document's ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(id_batches(tokenizer, end_id, width), STAGED)


def count_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield counted(batches, width)

    return run


def counted(batches: Iterator[pa.RecordBatch], width: int) -> pa.RecordBatch:
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for ids in batch.column("ids"):
            got = np.bincount(np.frombuffer(ids.as_py(), dtype=f"<u{width}"))
            if len(got) > len(total):
                total = np.pad(total, (0, len(got) - len(total)))
            total[: len(got)] += got
    used = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


def block_batches(lengths: bytes, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(lengths, dtype=np.uint8)
        codes, _ = canonical(bits)
        held, size, block, start = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, block, start
            ids = np.concatenate([np.frombuffer(x, dtype=f"<u{width}") for _, _, x in held])
            data, marks = pack(ids, codes, bits)
            row = pa.RecordBatch.from_arrays(
                [pa.array([held[0][0][1]], pa.int32()), pa.array([block], pa.int64()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([[k[0] for k, _, _ in held]], pa.list_(pa.int64())), pa.array([[n for _, n, _ in held]], pa.list_(pa.int64())),
                 pa.array([marks], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                names=BLOCK_COLUMNS,
            )
            held, size, block, start = [], 0, block + 1, start + len(ids)
            return row

        for batch in batches:
            for doc_id, part, n, ids in zip(*(batch.column(c) for c in ("doc_id", "part", "n_tokens", "ids"))):
                held.append(((doc_id.as_py(), part.as_py()), n.as_py(), ids.as_py()))
                size += held[-1][1]
                if size >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    return run


BLOCK_COLUMNS = ["part", "block", "local_start", "n_ids", "doc_ids", "doc_tokens", "checkpoints", "bits"]
BLOCKS = "part int, block long, local_start long, n_ids long, doc_ids array<long>, doc_tokens array<long>, checkpoints array<long>, bits binary"


def write(tokens: DataFrame, path: str, parts: int | None = None, width: int = 4) -> None:
    """Action: write the file set of ``tokens`` (as of ``encode_texts``, staged) to ``path`` in ascending doc_id order."""
    spark = tokens.sparkSession
    counts = tokens.select("ids").mapInArrow(count_batches(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row per vocabulary entry
    total = np.zeros(max((r.id for r in counts), default=-1) + 1, dtype=np.int64)
    for r in counts:
        total[r.id] = r.n
    lengths = code_lengths(total)
    book = pd.DataFrame({"id": np.arange(len(lengths)), "n_bits": lengths.astype(np.int32)})
    spark.createDataFrame(book, "id long, n_bits int").coalesce(1).write.parquet(f"{path}/codes")
    n_parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = tokens.repartitionByRange(n_parts, F.asc_nulls_first("doc_id")).withColumn("part", F.spark_partition_id()).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    ranged.mapInArrow(block_batches(lengths.tobytes(), width), BLOCKS).write.parquet(f"{path}/blocks")
    # ids before each part: the parts are few, one row for each task that wrote blocks
    sums = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    before, rows = 0, []
    for r in sorted(sums, key=lambda r: r.part):
        rows.append((r.part, before))
        before += r.n
    spark.createDataFrame(rows, "part int, before long").coalesce(1).write.parquet(f"{path}/parts")


def read_batches(lengths: bytes, digest: Callable[[bytes], int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, lookup = canonical(np.frombuffer(lengths, dtype=np.uint8))
        for batch in batches:
            rows = batch.to_pylist()
            for at in range(0, len(rows), 16):  # bounded memory
                some = rows[at : at + 16]
                decoded = unpack([r["bits"] for r in some], [np.asarray(r["checkpoints"], dtype=np.int64) for r in some], [r["n_ids"] for r in some], lookup)
                ids_out, starts, sizes, payload = [], [], [], []
                for r, ids in zip(some, decoded):
                    raw, offset = ids.astype("<u4").tobytes(), 0
                    for doc_id, n in zip(r["doc_ids"], r["doc_tokens"]):
                        own = raw[4 * offset : 4 * (offset + n)]
                        ids_out.append(doc_id)
                        starts.append(r["start"] + offset)
                        sizes.append(n)
                        payload.append(own if digest is None else digest(own))
                        offset += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids_out, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(payload, pa.binary() if digest is None else pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids" if digest is None else "ids_crc32"],
                )

    return run


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of a file set: doc_id, start, n_tokens and ids (little-endian 32-bit) or, with ``digest``, their crc32."""
    book = spark.read.parquet(f"{path}/codes").collect()  # one row per vocabulary entry
    lengths = np.zeros(max((r.id for r in book), default=-1) + 1, dtype=np.uint8)
    for r in book:
        lengths[r.id] = r.n_bits
    last = "ids_crc32 long" if digest else "ids binary"
    parts = F.broadcast(spark.read.parquet(f"{path}/parts"))  # one row for each task that wrote
    blocks = spark.read.parquet(f"{path}/blocks").join(parts, "part").withColumn("start", F.col("before") + F.col("local_start"))
    return blocks.select("start", "n_ids", "doc_ids", "doc_tokens", "checkpoints", "bits").mapInArrow(read_batches(lengths.tobytes(), zlib.crc32 if digest else None), f"doc_id long, start long, n_tokens long, {last}")


def new_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/panelcast/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Action, stages: encode, write, read back; doc_id, start, n_tokens, ids_crc32 of each document."""
    spark = docs.sparkSession
    path = new_folder(spark)
    width = id_bytes(tokenizer)
    write(stage(encode_texts(docs, tokenizer, end_id, width)), path, width=width)
    return read(spark, path, digest=True)
