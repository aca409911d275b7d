"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of the word itself, so a misspelling
shares most of its vectors with the word it hides.  A window of words is the mean of its words, and
a linear softmax scores it; a text has the score of its worst window, so that a few words count
in a text of any length.  Labels are those of whole texts: training starts with the mean over the
text and goes on with the window that the model itself finds worst.
"""

from __future__ import annotations

import re
import zlib
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm import text as tx
from palisade.llm.language_id import held_out

#: Numbers of letters of the n-grams, hash buckets of their vectors, and the vectors' length.
GRAMS, BUCKETS, SIZE = (3, 4, 5), 1 << 17, 8
#: Words of a window.
WINDOW = 2
#: Bounds of the sample that the model is fitted on: documents of label 0 and of label 1, drawn by
#: hash (as many are expected, twice as many at most), and the characters for each of these documents. They are
#: a total of the label: texts are read whole where the total holds them, else the longest give hashed pieces.
SAMPLE_DOCUMENTS, SAMPLE_CHARACTERS, PIECE = (1600, 800), 4000, 500
#: Characters from which a word is read as several: its parts between symbols, and overlapping pieces of long parts.
LONG_WORD, WORD_PIECE = 39, 12
MEAN_EPOCHS, WINDOW_EPOCHS, RATE = 15, 45, 0.05
THRESHOLD = 0.7
CACHE_ENTRIES = 300_000
_SYMBOLS = re.compile(r"[\W_]+")
#: ASCII characters that are no letter and no digit, those at which Python's ``split`` parts words besides white
#: space, and the table of CRC-32 by its public polynomial.
_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())
_SPLITTERS = re.compile(rb"[\x1c-\x1f]")
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


class Model(NamedTuple):
    gains: np.ndarray  # per bucket: its vector times the difference of the softmax rows
    bias: float


def subwords(word: str) -> list[int]:
    """Buckets of a word's n-grams and of the word; marks at its ends, symbols around it dropped."""
    core = word.lower()
    a, b = 0, len(core)
    while a < b and not core[a].isalnum():
        a += 1
    while b > a and not core[b - 1].isalnum():
        b -= 1
    core = f"<{core[a:b]}>"
    if len(core) == 2:
        return []
    parts = [core, *(core[i : i + n] for n in GRAMS for i in range(len(core) - n + 1))]
    return [zlib.crc32(x.encode()) % BUCKETS for x in parts]


def _words(text: str | None) -> list[str]:
    found = (text or "").split()
    if max(map(len, found), default=0) < LONG_WORD:
        return found
    return [x for w in found for x in ([w] if len(w) < LONG_WORD else _pieces(w))]


def _pieces(word: str) -> list[str]:
    """Words that a long word is read as; together they hold every n-gram inside it."""
    step = WORD_PIECE - max(GRAMS) + 1
    return [
        part[i : i + WORD_PIECE] if len(part) >= LONG_WORD else part
        for part in _SYMBOLS.split(word)
        if part
        for i in (range(0, len(part) - WORD_PIECE + step, step) if len(part) >= LONG_WORD else (0,))
    ]


def _worst(gains: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean gain, first word, words) of the worst window of each text that has words."""
    counts = np.diff(offsets)
    span = np.minimum(counts, WINDOW)
    some = np.flatnonzero(counts)
    score, first = np.zeros(len(counts)), offsets[:-1].copy()
    # Windows of a text start at its words but the last span - 1; all words have a place here, the others never win.
    sums = np.zeros(len(gains) + 1)
    np.cumsum(gains, out=sums[1:])
    wide = np.repeat(span, counts).astype(np.int8)
    ends = np.minimum(np.arange(len(gains), dtype=np.int64) + wide, len(gains))
    means = (sums[ends] - sums[:-1]) / np.maximum(wide, 1)
    del ends, sums
    for back in range(1, WINDOW):
        late = offsets[1:][some] - back
        means[late[span[some] > back]] = -np.inf
    if len(some):
        best = np.maximum.reduceat(means, offsets[:-1][some])
        score[some] = best
        hit = np.flatnonzero(means == np.repeat(best, counts[some]))
        rows, at = np.unique(np.searchsorted(offsets, hit, "right") - 1, return_index=True)
        first[rows] = hit[at]
    return score, first, span


def train(texts: list[str], labels: list[int], seed: int = 13) -> Model:
    """Model fitted by Adam over the whole sample; both labels weigh the same."""
    # One text at a time, into arrays: the driver never holds all words as strings.
    vocabulary: dict[str, int] = {}
    numbers, counts, buckets, grams = array("i"), array("i"), array("i"), array("i")
    for text in texts:
        words = _words(text)
        counts.append(len(words))
        for word in words:
            number = vocabulary.setdefault(word, len(vocabulary))
            if number == len(grams):
                parts = subwords(word) or [0]
                grams.append(len(parts))
                buckets.extend(parts)
            numbers.append(number)
    del vocabulary
    flat = np.frombuffer(numbers, np.int32)
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.int32), dtype=np.int64)])
    sizes = np.frombuffer(grams, np.int32)
    begins = np.cumsum(sizes) - sizes
    used, bucket = np.unique(np.frombuffer(buckets, np.int32), return_inverse=True)
    bucket = bucket.astype(np.int32)
    target = np.array(labels, np.float64)
    weight = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum()))
    rng = np.random.default_rng(seed)
    values = [rng.normal(0, 0.1, (len(used), SIZE)), rng.normal(0, 0.1, (2, SIZE)), np.zeros(2)]
    first, second = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]
    for step in range(1, MEAN_EPOCHS + WINDOW_EPOCHS + 1):
        vectors, rows, bias = values
        direction = rows[1] - rows[0]
        words = np.add.reduceat((vectors @ direction)[bucket], begins) / sizes
        gains = words[flat]
        if step <= MEAN_EPOCHS:
            start, span = offsets[:-1], np.diff(offsets)
            score = np.bincount(tx.spread(span), gains, len(span)) / np.maximum(span, 1)
        else:
            score, start, span = _worst(gains, offsets)
        chance = 1 / (1 + np.exp(-np.clip(score + bias[1] - bias[0], -40, 40)))
        error = (chance - target) * weight
        owner = tx.spread(span)
        at = np.repeat(start, span) + np.arange(len(owner)) - np.repeat(np.cumsum(span) - span, span)
        by_word = np.bincount(flat[at], (error / np.maximum(span, 1))[owner], len(sizes)) / sizes
        by_bucket = np.bincount(bucket, np.repeat(by_word, sizes), len(used))
        pull = by_bucket @ vectors
        gradients = (
            by_bucket[:, None] * direction + 1e-5 * vectors,
            np.stack([-pull, pull]),
            np.array([-error.sum(), error.sum()]),
        )
        for k, gradient in enumerate(gradients):
            first[k] += 0.1 * (gradient - first[k])
            second[k] += 0.001 * (gradient**2 - second[k])
            scale = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            values[k] = values[k] - scale * first[k] / (np.sqrt(second[k]) + 1e-9)
    vectors, rows, bias = values
    gains = np.zeros(BUCKETS, np.float32)
    gains[used] = vectors @ (rows[1] - rows[0])
    return Model(gains, float(bias[1] - bias[0]))


def _level(lengths: list[int], total: int) -> int:
    """Largest length to cut texts to, so that they have ``total`` characters at most."""
    rest = sorted(lengths)
    for i, n in enumerate(rest):
        if n * (len(rest) - i) > total:
            return total // (len(rest) - i)
        total -= n
    return rest[-1] if rest else 0


def _sampled(most: Column) -> Column:
    """The text, or if it is longer than ``most`` hashed pieces of it, one from each of as many equal parts."""
    count = F.greatest(F.floor(most / PIECE), F.lit(1)).cast("int")
    part = F.floor(F.length("text") / count).cast("int")
    free = F.greatest(part - PIECE, F.lit(1))
    piece = lambda i: F.col("text").substr(i * part + 1 + F.pmod(F.xxhash64("doc_id", i), free).cast("int"), F.lit(PIECE))
    return F.when(F.length("text") <= most, F.col("text")).otherwise(
        F.array_join(F.transform(F.sequence(F.lit(0), count - 1), piece), " ")
    )


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Model for ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``; None without both labels.

    Held-out documents are never read.  The drawn ids are bounded, so they are broadcast to the texts.
    """
    known = labels.where(~F.coalesce(held_out(), F.lit(True)) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.xxhash64("doc_id", F.lit(7)).cast("double") / 2.0**64 + 0.5
    # The hash alone decides, so tasks send what is drawn and no more; the limit only bounds chance.
    drawn = [
        known.where((F.col("toxic") == label) & (place * sizes.get(label, 0) < most)).orderBy(place, "doc_id").limit(2 * most)
        for label, most in enumerate(SAMPLE_DOCUMENTS)
    ]
    texts = docs.where(F.length("text") > 0).select("doc_id", "text")
    chosen = texts.join(F.broadcast(drawn[0].union(drawn[1])), "doc_id")
    lengths = chosen.select("doc_id", "toxic", F.length("text").alias("n"))
    found = lengths.orderBy("doc_id", "n", "toxic").limit(4 * sum(SAMPLE_DOCUMENTS)).collect()
    civil, toxic = (
        _level([r["n"] for r in found if r["toxic"] == label], most * SAMPLE_CHARACTERS)
        for label, most in enumerate(SAMPLE_DOCUMENTS)
    )
    rows = (
        chosen.select(_sampled(F.when(F.col("toxic") == 1, toxic).otherwise(civil)).alias("text"), "toxic", "doc_id")
        .orderBy("doc_id", "text", "toxic")
        .limit(4 * sum(SAMPLE_DOCUMENTS))
        .collect()
    )
    if {row["toxic"] for row in rows} != {0, 1}:
        return None
    return train([row["text"] for row in rows], [row["toxic"] for row in rows])


class _Scorer:
    """Gains of words, remembered; a full generation replaces the one before."""

    def __init__(self, model: Model):
        self.model = model
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _slow(self, run: bytes) -> bytes:
        """Gains of the words of a run of any characters: none of a lone mark, several of a long word."""
        found = [subwords(w) for w in _words(run.decode("utf-8", "replace"))]
        return array("d", [float(self.model.gains[x].mean(dtype=np.float64)) if x else 0.0 for x in found]).tobytes()

    def _fast(self, runs: list[bytes]) -> np.ndarray:
        """Gain of each ASCII run that is one word: the same hashes, a byte of all n-grams at a time."""
        cores = [b"<" + run.lower().strip(_MARKS) + b">" for run in runs]
        lengths = np.fromiter(map(len, cores), np.int64, len(cores))
        data = np.frombuffer(b"".join(cores) + bytes(max(GRAMS)), np.uint8)
        n = int(lengths.sum())
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
        word = np.repeat(np.arange(len(cores)), lengths)
        sums = self.model.gains[[zlib.crc32(c) % BUCKETS for c in cores]].astype(np.float64)
        total = np.ones(len(cores))
        crc = np.full(n, 0xFFFFFFFF, np.uint32)
        for size in range(1, max(GRAMS) + 1):
            crc = _CRC[(crc ^ data[size - 1 : size - 1 + n]) & 0xFF] ^ (crc >> np.uint32(8))
            if size in GRAMS:
                whole = np.flatnonzero(left >= size)
                bucket = (crc[whole] ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)
                sums += np.bincount(word[whole], self.model.gains[bucket], len(cores))
                total += np.bincount(word[whole], minlength=len(cores))
        return np.where(lengths > 2, sums / total, 0.0)

    def gains(self, runs: list[bytes]) -> list[bytes]:
        """Gains of the words of runs without ASCII white space."""
        if len(self.new) >= CACHE_ENTRIES:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        found = list(map(new.get, runs))
        unknown = []
        for i, known in enumerate(found):
            if known is None:
                run = runs[i]
                known = old.get(run)
                if known is None and run.isascii() and len(run) < LONG_WORD and not _SPLITTERS.search(run):
                    unknown.append(i)
                    continue
                found[i] = known = self._slow(run) if known is None else known
                if len(run) < 200:
                    new[run] = known
        if unknown:
            each = self._fast([runs[i] for i in unknown]).tobytes()
            for place, i in enumerate(unknown):
                found[i] = new[runs[i]] = each[8 * place : 8 * place + 8]
        return found

    def score(self, texts: list[str | None] | pa.Array) -> np.ndarray:
        words = tx.words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        codes = tx.coded(words)
        gains, behind = tx.expanded(np.asarray(codes.indices), self.gains(codes.dictionary.to_pylist()), np.float64)
        worst, _, _ = _worst(gains, np.concatenate([[0], behind])[words.offsets])
        return 1 / (1 + np.exp(-np.clip(worst + self.model.bias, -40, 40)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on), from ``text`` alone.

    All words of a text count.  Null and empty texts score the bias.  Without a model all scores are 0.
    Other columns pass through; those named like a result are replaced.
    """
    docs = docs.drop("score", "predicted")
    columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    if model is None:
        scored = docs.withColumn("score", F.lit(0.0))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            scorer = _Scorer(shared.value)
            for batch in batches:
                texts = tx.string_column(batch, "text")
                for a, b in tx.chunks(texts):
                    found = scorer.score(texts.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays(
                        [*batch.slice(a, b - a).columns, pa.array(found)], names=[*columns, "score"]
                    )

        scored = docs.mapInArrow(run, f"{schema}, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
