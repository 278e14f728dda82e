"""Secrets by fixed patterns and by dictionary-primed compression novelty.

Base spans come from three patterns, each leftmost and non-overlapping over the whole text: an
assignment to a sensitive name, an access key id, a long hex run; a match that is too short is dropped
after it has used up its characters.

The method adds strings that no pattern knows.  A candidate is a token of at least ``LEAST`` characters
of the alphabets of keys, with at least two of lower case, upper case and digits, that overlaps no base
span and stands behind a sensitive word: at most ``REACH`` characters before it on its line.  Its
novelty is what it adds to the compressed size of its surroundings: zstandard, primed with the
corpus's identifier parts, packs the ``AROUND`` characters on either side once with the candidate and once without
it, all in lower case.  Copies of the candidate in the surroundings are taken out first, so a secret on
repeated lines stays new.  A string that costs at least ``NOVEL`` bytes a character is reported: names, paths and
versions made of known parts cost a few bytes in all, random strings nearly one a character.

The identifier dictionary counts, over all documents, in how many a part occurs (a run of lower-case
letters with or without a capital, or of capitals, put in lower case; ``PART`` characters at least) and holds the
``PARTS`` most frequent, the most frequent last, where they are cheapest to refer to.  Parts hold no digits and break where the case
changes, so that thousands of copies of one secret do not turn it into a known identifier.  The driver
takes those ``PARTS`` strings of at most ``LONGEST`` characters and no other rows.

Defined cases: null or empty text has no spans.  A very long text is searched whole; windows around
candidates have a bounded size.  Spans that start together are ordered as the kinds are listed, then
by end; parts of equal count by their letters.  Bytes that are not UTF-8 count as one replacement
character each.  Repeated rows and null doc_ids are treated like others; other columns are ignored,
whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import text_batches

# The three base patterns with the least length of what they have to match.
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "novel")

# Words that make a context sensitive, in any case, also inside a name.
SENSITIVE = r"(?ai:passw|pwd|secret|token|key|credential|auth|bearer|private|signature|session|cookie|login|account)"
TOKEN_CHARACTERS = r"[A-Za-z0-9+/_.=~$-]*"
TOKEN = TOKEN_CHARACTERS[:-1] + "+"
PART_PATTERN = r"[A-Z]?[a-z]+|[A-Z]+"

LEAST = 12
REACH = 48
AROUND = 512
NOVEL = 0.7
PART, LONGEST, PARTS = 3, 32, 8192
#: Tasks in which the most frequent parts are picked first.
BUCKETS = 32
#: Distinct parts a task holds before it hands on its counts.
HELD = 200_000
BATCH_BYTES = 1 << 20
LEVEL = 3

Span = tuple[int, int, int]  # start, kind's number, end


def base_spans(text: str) -> list[Span]:
    """All matches of the fixed patterns, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text) if m.end() - m.start() >= ACCESS_LEAST]
    # a run of hex digits has its greatest length at its leftmost match, so too short runs need not be stepped through
    out += [(m.start(), 2, m.end()) for m in re.finditer(HEX[:-1] + f"{{{HEX_LEAST},}}", text)]
    return sorted(out)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """(start, end) of key-like tokens in sensitive context that overlap no base span."""
    found: dict[tuple[int, int], None] = {}
    taken = sorted((s, e) for s, _, e in base)
    for word in re.finditer(SENSITIVE, text):
        line = text.find("\n", word.end(), word.end() + REACH)
        reach = word.end() + REACH if line < 0 else line
        for m in re.compile(TOKEN).finditer(text, word.end()):
            if m.start() > reach:
                break
            start, end = m.span()
            if start == word.end():  # the rest of the sensitive name, up to its assignment
                cut = re.search(r"=(?=.)", m[0])
                if not cut:
                    continue
                start += cut.end()
            while start < end and text[start] in "=./":
                start += 1
            while end > start and text[end - 1] in "./":
                end -= 1
            token = text[start:end]
            kinds = bool(re.search("[a-z]", token)) + bool(re.search("[A-Z]", token)) + bool(re.search("[0-9]", token))
            if len(token) >= LEAST and kinds >= 2 and not any(s < end and start < e for s, e in taken):
                found[start, end] = None
    return sorted(found)


class Novelty:
    """Marginal compressed bytes of a string among its surroundings, given an identifier dictionary."""

    def __init__(self, parts: list[str]):
        import zstandard

        primed = " ".join(reversed(parts)).encode()  # the most frequent last
        dictionary = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(primed) >= 8 else None
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def bytes_of(self, text: str, start: int, end: int) -> int:
        token = text[start:end]
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        if start > AROUND:  # a window holds whole tokens only, so that no part of a copy stays
            before = before[re.match(TOKEN_CHARACTERS, before).end() :]
        if end + AROUND < len(text):
            after = after[: len(after) - re.match(TOKEN_CHARACTERS, after[::-1]).end()]
        around = [part.replace(token, "").lower().encode("utf-8", "replace") for part in (before, after)]
        return len(self.pack(around[0] + token.lower().encode() + around[1])) - len(self.pack(around[0] + around[1]))


def spans_of(text: str, novelty: Novelty) -> list[tuple[int, int, int, int | None]]:
    """(start, kind's number, end, marginal bytes or None) of all spans, by start, kind, end."""
    base = base_spans(text)
    out: list[tuple[int, int, int, int | None]] = [(*span, None) for span in base]
    for start, end in candidates(text, base):
        cost = novelty.bytes_of(text, start, end)
        if cost >= NOVEL * (end - start):
            out.append((start, 3, end, cost))
    return sorted(out, key=lambda s: s[:3])


def part_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find, counts = re.compile(PART_PATTERN.encode()).findall, Counter()

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([p.decode() for p in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["part", "n"])
        counts.clear()
        return out

    for batch in parts:
        for _, texts in text_batches(batch, "text", BATCH_BYTES):
            for text in texts:
                counts.update({p.lower() for p in find(text) if PART <= len(p) <= LONGEST})
                if len(counts) >= HELD:
                    yield flushed()
    yield flushed()


def identifiers(docs: DataFrame, parts: int = PARTS) -> list[str]:
    """Action: the most frequent identifier parts of all documents, most frequent first; ties by letters."""
    counts = docs.select(F.col("text")).mapInArrow(part_counts, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    # the best of every bucket first, so that what reaches the driver does not grow with the number of tasks
    best = Window.partitionBy(F.pmod(F.xxhash64("part"), F.lit(BUCKETS))).orderBy(F.desc("n"), "part")
    few = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= parts)
    return [r.part for r in few.orderBy(F.desc("n"), "part").limit(parts).collect()]


def scan(docs: DataFrame, parts: list[str]) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive, marginal bytes of novel ones) of every row."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(parts)
        for batch in rows:
            ids = batch.column("doc_id")
            for at, texts in text_batches(batch, "text", BATCH_BYTES):
                spans = [
                    [{"kind": KINDS[kind], "start": start, "end": end, "bytes": cost} for start, kind, end, cost in spans_of(t.decode("utf-8", "replace"), novelty)]
                    for t in texts
                ]
                fields = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bytes", pa.int64())]))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), pa.array(spans, fields)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(batches, "doc_id long, spans array<struct<kind: string, start: long, end: long, bytes: long>>")


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """Numbers of spans of each base kind, the digest of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] != "novel")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(number(k) for k in KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
