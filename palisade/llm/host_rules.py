"""Quality rules by host: failures per rule are counted by host, their rates are shrunken towards an
empirical beta prior, and hosts whose shrunken rate is over a limit lose all their documents.

Numbers of each text come from one pass in numpy.  Only a narrow table of them is grouped and joined.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm import text as tx
from palisade.session import stored

WINDOW = 5
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED, MOST_SYMBOLS, MOST_DUPLICATE_LINES = 10, 20, 50, 30
#: A host whose shrunken rate of failures of a rule is over this share is rejected.
HOST_LIMIT = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _numbers(texts: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each text."""
    rows = len(texts)
    words = tx.words(texts)
    counts, data = words.counts(), words.data
    owner = tx.spread(counts)
    bounds, _ = tx._bounds(texts)
    bounds = bounds - bounds[0]

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    # Code points: bytes that do not continue one.
    characters = per_text((data & 0xC0 != 0x80) & ~tx._SPACE[data])
    # Lines end at a line end or with their text.
    cuts = np.flatnonzero(data == 10)
    starts = np.concatenate([bounds[:-1], cuts + 1])
    ends = np.concatenate([bounds[1:], cuts])
    starts, ends = np.sort(starts, kind="stable"), np.sort(ends, kind="stable")
    line_of = np.sort(np.concatenate([np.arange(rows), np.searchsorted(bounds[1:], cuts, "right")]), kind="stable")
    worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    lane = tx.LANES[0]
    lines = tx._runs(lane.letters[data], starts, ends, lane.byte_base, small=True)
    order = np.lexsort((lines[worded], line_of[worded]))
    of, line = line_of[worded][order], lines[worded][order]
    again = np.zeros(len(of), bool)
    again[1:] = (of[1:] == of[:-1]) & (line[1:] == line[:-1])
    # Words in windows that occur twice or more in their text.
    grams = tx.windows(words.hashes(), WINDOW)
    left = np.repeat(words.offsets[1:], counts) - np.arange(len(owner))
    at = np.flatnonzero(left >= WINDOW)
    order = at[np.lexsort((grams[at], owner[at]))]
    same = (owner[order][1:] == owner[order][:-1]) & (grams[order][1:] == grams[order][:-1])
    twice = np.zeros(len(owner), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    steps = np.zeros(len(owner) + 1, np.int64)
    steps[:-1] += twice
    steps[WINDOW:] -= twice[: max(0, len(steps) - WINDOW)]
    covered = np.cumsum(steps[:-1]) > 0
    return [
        counts,
        characters,
        per_text(_SYMBOL[data]),
        np.bincount(line_of[worded], minlength=rows),
        np.bincount(of[again], minlength=rows),
        np.bincount(owner[covered], minlength=rows),
    ]


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text`` but with the numbers of its texts; null and empty texts have zeros.

    ``n_lines`` counts lines with a word, ``n_dup_lines`` those equal to an earlier line of the text.
    Other columns pass through; those named like a number are replaced.
    """
    docs = docs.drop(*NUMBERS)
    carried = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            texts = tx.string_column(batch, "text")
            for a, b in tx.chunks(texts):
                part = batch.slice(a, b - a)
                found = [pa.array(x.astype(np.int64)) for x in _numbers(texts.slice(a, b - a))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found], names=[*carried, *NUMBERS])

    kept = docs.select(*carried, "text")
    schema = "".join(f"`{c}` {kept.schema[c].dataType.simpleString()}, " for c in carried)
    return kept.mapInArrow(run, schema + ", ".join(f"{n} long" for n in NUMBERS))


#: Failures that are counted by host, as conditions over the numbers.
RULES = {
    "short": f"n_words < {LEAST_WORDS}",
    "repeated": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
    "symbols": f"100 * n_symbols > {MOST_SYMBOLS} * n_words",
    "duplicate_lines": f"100 * n_dup_lines > {MOST_DUPLICATE_LINES} * n_lines",
}
#: Rules that a document must pass itself.
BASE = ("short", "repeated")


def host_rates(measured: DataFrame) -> DataFrame:
    """``host, rule, n_docs, n_failed, rate``: shrunken rate of failures of each rule and host.

    The beta prior of a rule has the mean and the variance of its rates over hosts (method of moments); a
    rule whose rates vary not at all, or more than a beta can, gets the strength of one host of mean size.
    """
    hosts = stored(
        measured.where("host is not null")
        .groupBy("host")
        .agg(F.count("*").alias("n_docs"), *(F.count_if(F.expr(c)).alias(r) for r, c in RULES.items()))
    )
    row = hosts.agg(
        F.avg("n_docs").alias("size"),
        *(F.avg(F.col(r) / F.col("n_docs")).alias(f"{r}_mean") for r in RULES),
        *(F.var_pop(F.col(r) / F.col("n_docs")).alias(f"{r}_var") for r in RULES),
    ).first()
    parts = []
    for rule in RULES:
        mean, spread = row[f"{rule}_mean"] or 0.0, row[f"{rule}_var"] or 0.0
        strength = mean * (1 - mean) / spread - 1 if 0 < spread < mean * (1 - mean) else row["size"] or 1.0
        parts.append(
            hosts.select(
                "host",
                F.lit(rule).alias("rule"),
                "n_docs",
                F.col(rule).alias("n_failed"),
                ((F.col(rule) + mean * strength) / (F.col("n_docs") + strength)).alias("rate"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def host_verdicts(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, text, host)`` without text, with their numbers, ``base_failed``, ``host_rate`` and ``kept``.

    ``base_failed``: under 10 words, or over 20 % of the words in repeated windows.  ``kept``: not
    ``base_failed``, and no rule's shrunken rate of the host is over ``HOST_LIMIT``.  A null host has no
    verdict: its documents are judged by themselves.
    """
    measured = stored(measure(docs.drop("base_failed", "host_rate", "kept")))
    worst = host_rates(measured).groupBy("host").agg(F.max("rate").alias("host_rate"))
    base = reduce(lambda a, b: a | b, (F.expr(RULES[r]) for r in BASE))
    return (
        measured.join(stored(worst), "host", "left")
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= HOST_LIMIT))
    )
