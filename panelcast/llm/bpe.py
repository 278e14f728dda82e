"""Byte-level BPE by a monoid tree.

A text is halved until leaves of at most 512 characters are left; leaves are encoded by the
library and neighbours are joined up the tree.  A join re-encodes a window around the seam that
grows until it ends, on both sides, where the tokens outside provably stay: at a blank or line end
behind a letter or digit.  No match of the split pattern holds white space behind another character,
so such a place is a match border in whatever text surrounds it, and the matches before it end the
same way whether the text goes on or not: the encoding of a text is the encodings of both sides one
after the other.  Where there is no such place the window grows to the whole half.  Encodings under
this join are a monoid with the empty text as identity, so any tree gives the same tokens.  Decoding
concatenates the bytes of tokens up the tree.

Defined cases: null or empty text has no tokens.  Repeated rows and null doc_ids are encoded like
others, other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import text_batches

LEAF = 512
#: Characters on either side of a seam in the first window; doubled until both ends are stable.
WINDOW = 32


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def is_border(text: str, p: int) -> bool:
    """Is position p a match border whatever surrounds the text?"""
    return text[p] in " \n" and text[p - 1].isalnum()


class Codec:
    """Encoder and decoder of one rank file; ``pattern`` must have no match with white space behind another character."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        self.leaf, self.window = leaf, window
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.n_bytes = np.zeros(max(self.bytes_of, default=-1) + 1, dtype=np.int64)
        for rank, token in self.bytes_of.items():
            self.n_bytes[rank] = len(token)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_ordinary(text), dtype=np.uint32)

    def encode(self, text: str) -> np.ndarray:
        return self.plain(text) if len(text) <= self.leaf else self.tree(text, 0, len(text))

    def tree(self, text: str, begin: int, end: int) -> np.ndarray:
        if end - begin <= self.leaf:
            return self.plain(text[begin:end])
        seam = (begin + end) // 2
        return self.join(text, begin, seam, end, self.tree(text, begin, seam), self.tree(text, seam, end))

    def join(self, text: str, begin: int, seam: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Encoding of text[begin:end] from those of text[begin:seam] and text[seam:end]."""
        a, b = self.stable_before(text, begin, seam), self.stable_after(text, seam, end)
        kept_left = self.tokens_in(left[::-1], text[a:seam])
        kept_right = self.tokens_in(right, text[seam:b])
        return np.concatenate([left[: len(left) - kept_left], self.plain(text[a:b]), right[kept_right:]])

    def stable_before(self, text: str, begin: int, seam: int) -> int:
        width = self.window
        while seam - width > begin:
            for p in range(seam - width, max(seam - 2 * width, begin), -1):
                if is_border(text, p):
                    return p
            width *= 2
        return begin

    def stable_after(self, text: str, seam: int, end: int) -> int:
        width = self.window
        while seam + width < end:
            for p in range(seam + width, min(seam + 2 * width, end)):
                if is_border(text, p):
                    return p
            width *= 2
        return end

    def tokens_in(self, ids: np.ndarray, text: str) -> int:
        """How many of the first ids spell the bytes of ``text``, whose end is a token border."""
        wanted = len(text.encode())
        upto = np.cumsum(self.n_bytes[ids[:wanted]])
        return int(np.searchsorted(upto, wanted)) + 1 if wanted else 0

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def id_batches(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(load_ranks(ranks_path), pattern)
        for batch in batches:
            for first, texts in text_batches(batch, "text"):
                part = batch.slice(first, len(texts))
                ids = [codec.encode(t.decode()).astype("<u4").tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def text_of_ids(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(load_ranks(ranks_path), pattern)
        for batch in batches:
            texts = [codec.decode(np.frombuffer(x.as_py() or b"", dtype="<u4")) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.binary())], names=["doc_id", "ids", "bytes"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Lazy: (doc_id, ids as little-endian unsigned 32-bit integers)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(id_batches(ranks_path, pattern), "doc_id long, ids binary")


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Lazy: (doc_id, ids, bytes); the bytes are the concatenated tokens, UTF-8 for whole encodings."""
    return tokens.select("doc_id", "ids").mapInArrow(text_of_ids(ranks_path, pattern), "doc_id long, ids binary, bytes binary")


def coded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Lazy: doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of each document, from its encoded ids and what they decode to."""
    found = decode(encode(docs, ranks_path, pattern), ranks_path, pattern)
    n = F.expr("cast(octet_length(ids) div 4 AS long)")
    return found.select("doc_id", n.alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Lazy: doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    return coded(docs, ranks_path, pattern).drop("ids")
