"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary (bytes).  The probability
of a word is the sum over all its segmentations into pieces, computed by the forward algorithm;
a text's log-probability is the sum over its words (lower-cased runs of letters, a blank before each).
The language with the highest sum wins; the score is its posterior under equal priors.

Learning: expected piece counts over all segmentations (forward-backward), a few rounds, from at most
about ``FIT_DOCS`` documents per language taken by a hash of doc_id; every single byte keeps a share
of the mass, so any text has a probability.  Words of a batch are scored once each and in step.

Defined cases: null text, or text without a letter, is ``und`` with score 0; so is everything when
nothing could be learned.  Rows with null ``lang`` or ``doc_id`` are predicted but not learned from.
Ties go to the smallest language name.  A very long
text is scored whole.  Other columns are ignored, or carried along by ``keep_determined``, whatever their names; an empty table
gives an empty result.  Repeated rows get equal predictions.
"""

from __future__ import annotations

import base64
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import text_batches
from panelcast.sources.staging import stage

UNDETERMINED = "und"
FIT_DOCS = 2000
ROUNDS = 3
LONGEST_PIECE = 16
#: Words up to this many bytes are scored in step, longer ones one by one.
LONGEST_TOGETHER = 64
BYTE_SHARE = 0.04
#: Bytes of a long word between two rescalings.
RESCALED = 8
#: Probabilities are multiplied by this per byte while summing, so that long words stay in range.
LIFT = 8.0
LETTERS = re.compile(r"[^\W\d_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str) -> list[bytes]:
    """Pieces of a rank file that can occur in lower-cased letters with a blank before them, and all single bytes."""
    pieces = {bytes([b]) for b in range(256)}
    with open(path, "rb") as f:
        for token in (base64.b64decode(line.split()[0]) for line in f):
            bare = token[1:] if token[:1] == b" " else token
            text = bare.decode("utf-8", "ignore")
            if bare and len(token) <= LONGEST_PIECE and text == text.lower() and (text.isalpha() or not text):
                pieces.add(token)
    return sorted(pieces)


class Pieces:
    """Vocabulary as sorted hashes; piece numbers start at 1, 0 is no piece."""

    def __init__(self, pieces: list[bytes]):
        hashes = np.array([hash_bytes(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], (order + 1).astype(np.int32)
        self.of = {p: i + 1 for i, p in enumerate(pieces)}
        self.lengths = np.array([0] + [len(p) for p in pieces])
        self.size = len(pieces) + 1
        self.taken = np.zeros(1 << 20, dtype=bool)  # leading bits of the hashes: rules out most of what is no piece
        self.taken[(hashes >> np.uint64(44)).astype(np.int64)] = True
        self.longest = max(len(p) for p in pieces)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, piece numbers) of the hashes that are a piece's."""
        where = np.flatnonzero(self.taken[(wanted >> np.uint64(44)).astype(np.int64)])
        some = wanted[where]
        at = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
        right = self.hashes[at] == some
        return where[right], self.numbers[at[right]]


def hash_bytes(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def same_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in ``words``, bytes as a matrix) for each length up to ``LONGEST_TOGETHER``."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for where in np.split(order, cuts) if len(order) else []:
        n = int(sizes[where[0]])
        if n <= LONGEST_TOGETHER:
            yield where, np.frombuffer(b"".join([words[i] for i in where]), dtype=np.uint8).reshape(-1, n)


def found_pieces(vocabulary: Pieces, data: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """(begin, end), ascending end → rows whose bytes [begin, end) are a piece, and which."""
    n = data.shape[1]
    sums = np.zeros((n + 1, len(data)), dtype=np.uint64)
    powers = np.array([pow(int(BASE), k, 1 << 64) for k in range(n + 1)], dtype=np.uint64)
    for j in range(n):
        sums[j + 1] = sums[j] * BASE + data[:, j].astype(np.uint64) + np.uint64(1)
    return {(i, j): vocabulary.find(sums[j] - sums[i] * powers[j - i]) for j in range(1, n + 1) for i in range(max(0, j - vocabulary.longest), j)}


def forward(found: dict, n: int, rows: int, lifted: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of each prefix: (n + 1, rows, languages)."""
    sums = np.zeros((n + 1, rows, lifted.shape[1]))
    sums[0] = 1.0
    for (i, j), (at, number) in found.items():
        sums[j][at] += sums[i][at] * lifted[number]
    return sums


def log_of_long(word: bytes, vocabulary: Pieces, lifted: np.ndarray) -> np.ndarray:
    """As ``forward`` for one word of any length, rescaled as it goes."""
    recent, shift = [np.ones(lifted.shape[1])], np.zeros(lifted.shape[1])
    for j in range(1, len(word) + 1):
        total = np.zeros(lifted.shape[1])
        for k in range(1, min(vocabulary.longest, j) + 1):
            number = vocabulary.of.get(word[j - k : j])
            if number:
                total += recent[-k] * lifted[number]
        recent = [*recent[-vocabulary.longest :], total]
        if j % RESCALED == 0:  # each language by its own factor, up or down
            factor = np.max(recent, axis=0)
            factor[factor == 0] = 1.0
            recent = [r / factor for r in recent]
            shift += np.log(factor)
    return np.log(recent[-1]) + shift - len(word) * np.log(LIFT)


def lift(probabilities: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """(pieces, languages) with the factor per byte; row 0, no piece, is 0."""
    out = probabilities * LIFT ** vocabulary.lengths[:, None]
    out[0] = 0.0
    return out


def log_probabilities(words: list[bytes], vocabulary: Pieces, lifted: np.ndarray) -> np.ndarray:
    """(words, languages): log of the sum over all segmentations of each word."""
    out = np.empty((len(words), lifted.shape[1]))
    for where, data in same_length(words):
        n = data.shape[1]
        for at in range(0, len(where), 1 << 13):  # bounded memory
            some = data[at : at + (1 << 13)]
            sums = forward(found_pieces(vocabulary, some), n, len(some), lifted)
            out[where[at : at + (1 << 13)]] = np.log(sums[n]) - n * np.log(LIFT)
    for i, word in enumerate(words):
        if len(word) > LONGEST_TOGETHER:
            out[i] = log_of_long(word, vocabulary, lifted)
    return out


def words_of(text: bytes) -> list[str]:
    """Lower-cased runs of letters (signs like ² may stand in one); none if the text has no letter at all."""
    words = LETTERS.findall(text.decode("utf-8", "replace").lower())
    return words if any(any(map(str.isalpha, w)) for w in words) else []


# --- learning -------------------------------------------------------------------------------------------------------

def word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in text_batches(batch, "text"):
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").slice(first, len(texts)).to_pylist(), texts):
                counts.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, word, n) for lang, c in counts.items() for word, n in c.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"]
            )


def expected_counts(words: list[bytes], times: np.ndarray, vocabulary: Pieces, probabilities: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations of the words."""
    lifted = lift(probabilities[:, None], vocabulary)
    out = np.zeros(vocabulary.size)
    for where, data in same_length(words):
        n, rows = data.shape[1], len(data)
        found = found_pieces(vocabulary, data)
        ahead = forward(found, n, rows, lifted)[:, :, 0]
        behind = np.zeros((n + 1, rows))
        behind[n] = times[where] / ahead[n]
        for (i, j), (at, number) in sorted(found.items(), key=lambda x: -x[0][1]):
            behind[i][at] += behind[j][at] * lifted[number, 0]
        for (i, j), (at, number) in found.items():
            out += np.bincount(number, ahead[i][at] * lifted[number, 0] * behind[j][at], vocabulary.size)
    for word, n in zip(words, times):
        if len(word) > LONGEST_TOGETHER:
            add_counts_of_long(out, word, n, vocabulary, probabilities)
    return out


def add_counts_of_long(out: np.ndarray, word: bytes, times: float, vocabulary: Pieces, probabilities: np.ndarray) -> None:
    """As ``expected_counts`` for one word of any length, in logarithms."""
    n = len(word)
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0.0
    ends: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of each end: begins, piece numbers, logarithms
    for j in range(1, n + 1):
        found = [(i, number) for i in range(max(0, j - vocabulary.longest), j) if (number := vocabulary.of.get(word[i:j])) and probabilities[number] > 0]
        begins, numbers = np.array([f[0] for f in found], dtype=np.int64), np.array([f[1] for f in found], dtype=np.int64)
        logs = np.log(probabilities[numbers])
        ends.append((begins, numbers, logs))
        if found:
            ahead[j] = np.logaddexp.reduce(ahead[begins] + logs)
    if ahead[n] == -np.inf:
        return
    for j in range(n, 0, -1):
        begins, numbers, logs = ends[j - 1]
        behind[begins] = np.logaddexp(behind[begins], behind[j] + logs)
        np.add.at(out, numbers, times * np.exp(ahead[begins] + logs + behind[j] - ahead[n]))


def expectation_batches(pieces_path: str, model: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Pieces(load_pieces(pieces_path))
        uniform = np.full(vocabulary.size, 1.0 / vocabulary.size)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            words = [b" " + w.encode() for w in batch.column("word").to_pylist()]
            times = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            for lang in set(langs):
                at = np.flatnonzero(langs == lang)
                got = expected_counts([words[i] for i in at], times[at], vocabulary, model.get(lang, uniform))
                total[lang] = total.get(lang, 0.0) + got
        for lang, counts in total.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used], pa.float64())], names=["lang", "piece", "n"]
            )

    return run


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, fit_docs: int) -> DataFrame:
    """Labelled rows to learn from: all of a language with at most ``fit_docs``, else about so many by a hash of doc_id."""
    may = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r.lang: r.n for r in may.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not sizes:
        return may.select("lang", "text").limit(0)
    shares = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, fit_docs / n))) for k, n in sizes.items()))
    drawn = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return may.where(drawn < shares[F.col("lang")]).select("lang", "text")


def fit(docs: DataFrame, pieces_path: str, fit_docs: int = FIT_DOCS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Action, stages: (languages, probabilities of pieces × languages)."""
    counts = sample(docs, fit_docs).mapInArrow(word_batches, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = stage(counts)
    vocabulary = Pieces(load_pieces(pieces_path))
    single = (vocabulary.lengths == 1) / 256.0
    model: dict[str, np.ndarray] = {}
    for _ in range(rounds):
        step = counts.mapInArrow(expectation_batches(pieces_path, model), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        sums: dict[str, np.ndarray] = {}
        for r in step.toLocalIterator():  # at most languages × vocabulary rows
            sums.setdefault(r.lang, np.zeros(vocabulary.size))[r.piece] = r.n
        model = {k: (1 - BYTE_SHARE) * v / v.sum() + BYTE_SHARE * single for k, v in sums.items() if v.sum() > 0}
    langs = sorted(model)
    return langs, np.stack([model[k] for k in langs], axis=1) if langs else np.zeros((vocabulary.size, 0))


# --- prediction -----------------------------------------------------------------------------------------------------

def predict_batches(pieces_path: str, langs: list[str], probabilities: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Pieces(load_pieces(pieces_path))
        lifted = lift(probabilities, vocabulary)
        for batch in batches:
            for first, texts in text_batches(batch, "text", 8 << 20):
                numbers: dict[str, int] = defaultdict(count().__next__)
                of_text = [np.fromiter(map(numbers.__getitem__, words_of(t)), dtype=np.int64) for t in texts]
                score = log_probabilities([b" " + w.encode() for w in numbers], vocabulary, lifted) if langs else None
                names, scores = [], []
                for found in of_text:
                    if not langs or not len(found):
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    total = score[found].sum(axis=0)
                    best = int(total.argmax())
                    names.append(langs[best])
                    scores.append(float(1.0 / np.exp(total - total[best]).sum()))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], pieces_path: str) -> DataFrame:
    """Lazy: doc_id, held_out, lang_pred, score of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(predict_batches(pieces_path, *model), "doc_id long, held_out boolean, lang_pred string, score double")


def reject_batches(pieces_path: str, langs: list[str], probabilities: np.ndarray, least: float, text_at: int):
    score = predict_batches(pieces_path, langs, probabilities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(text_at)
            only = pa.RecordBatch.from_arrays([pa.nulls(len(text), pa.int64()), pa.nulls(len(text), pa.bool_()), text], names=["doc_id", "held_out", "text"])
            at = 0
            for found in score(iter([only])):
                good = [p != UNDETERMINED and s >= least for p, s in zip(found.column("lang_pred").to_pylist(), found.column("score").to_pylist())]
                yield batch.slice(at, found.num_rows).filter(pa.array(good, pa.bool_()))
                at += found.num_rows

    return run


def keep_determined(docs: DataFrame, pieces_path: str, least: float = 0.5, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Rows whose language is determined with a posterior of at least ``least``; columns unchanged, no shuffle."""
    model = fit(docs, pieces_path, fit_docs)
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # any column name, also one with a dot
    kept = plain.mapInArrow(reject_batches(pieces_path, *model, least, docs.columns.index("text")), plain.schema)
    return kept.toDF(*docs.columns)
