"""Phrase collocations, counted by tries over the whole corpus.

Words are counted first.  Then, level by level, the texts are sequences of states: the number of the frequent phrase of k
words that starts at a position, 0 where none does.  A phrase of k + 1 words can only be frequent where the states of a
position and of the next one both accept (Apriori), so occurrences of such neighbours are summed over the shards
of the text, and the neighbours that come to the threshold go into a double-array trie.  The tries are broadcast,
numpy advances the states of all positions of a shard by one level at once and counts the accepting states
with a bincount; these arrays, summed over shards, are the frequencies.

An edge of the trie leads from a phrase by the phrase that starts one word later, which stands for the word it adds: the
two together name the longer phrase.  Positions without a state only separate, so sequences shrink from level to level and
every level reads the sequences of the level before alone.

A list of words holds ``SHARD`` entries at most, a trie about twice as many; where a level has more, it is cut by hash, and
the sequences pass through one trie after the other.  So what is broadcast has a fixed bound at any size of the corpus, and no
candidate is left out.  Words themselves are compared, not hashes of them.  What a pass has written is removed as soon as
the next one is written.

A task holds little at any size of its input: sequences are rows of about ``ROW`` states, cut where neighbours
are apart anyway, and tables are read, and handed to Python and back, ``ROWS`` or ``SENT`` rows at a time.

Null texts are empty, a null ``lang`` is ``und``.  Rows count one by one, whatever ``doc_id`` they share; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palisade.llm.text import chunks, string_column, words_between
from palisade.session import remove_table, stored, stored_in

UNKNOWN = "und"
#: Entries of one broadcast word list, half of those of a trie, and bytes of the words of one list.
SHARD = 1 << 19
SHARD_BYTES = 32 << 20
#: Numbers are given in buckets of at most this many.
BUCKET = 1 << 15
#: Text bytes that are read at once, and neighbours that are counted at once.
CHUNK = 2 << 20
PAIRS = 1 << 20
#: States of a row, rows that are read and handed to Python at once, and rows of numbers that come back at once.
ROW = 1 << 14
ROWS = 256
SENT = 1 << 17
#: Values of a digit of a trie's labels, and slots whose counts are one row.
RADIX = 256
BLOCK = 1 << 13

_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x09, *b".,;:!?", *range(0x0A, 0x0E)]] = True
_PIECE = _CUT.copy()
_PIECE[[0x20, 0x09]] = False


# ── words ───────────────────────────────────────────────────────────────────────


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-case words, whether each begins a piece, and the first word of each text (and the end)."""
    array = texts.fill_null("")
    bounds = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    found = words_between(data, bounds - bounds[0], _CUT)
    letters = data[~_CUT[data]]
    ends = np.zeros(len(found.starts) + 1, np.int64)
    np.cumsum(found.ends - found.starts, out=ends[1:])
    words = pa.LargeStringArray.from_buffers(len(found.starts), pa.py_buffer(ends), pa.py_buffer(letters))
    piece = np.cumsum(_PIECE[data])[found.starts]
    new = np.ones(len(words), bool)
    new[1:] = piece[1:] != piece[:-1]
    firsts = found.offsets[:-1]
    new[firsts[firsts < len(words)]] = True
    return words, new, found.offsets


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside read their input ``ROWS`` rows at a time."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(name) for name in names]
    try:
        for name in names:
            spark.conf.set(name, str(ROWS))
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """Texts of each language, over all batches, about ``CHUNK`` bytes at a time."""
    waiting: dict[str, list[pa.Array]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        texts = string_column(batch, "text")
        for lang, rows in _by_language(batch):
            own = texts.take(pa.array(rows))
            waiting.setdefault(lang, []).append(own)
            sizes[lang] = sizes.get(lang, 0) + own.nbytes
            full = list(waiting) if sum(sizes.values()) >= 4 * CHUNK else [lang] if sizes[lang] >= CHUNK else []
            for known in full:
                del sizes[known]
                yield known, pa.concat_arrays(waiting.pop(known))
    for lang, own in waiting.items():
        yield lang, pa.concat_arrays(own)


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Rows of each language of a batch, in runs of about ``CHUNK`` text bytes."""
    codes = string_column(batch, "lang").dictionary_encode()
    texts = string_column(batch, "text")
    for code, lang in enumerate(codes.dictionary.to_pylist()):
        rows = np.flatnonzero(np.asarray(codes.indices) == code)
        for a, b in chunks(texts.take(pa.array(rows)), CHUNK):
            yield lang, rows[a:b]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each word; a null word stands for all words of the language."""
    for lang, texts in _texts(batches):
        words = _words(texts)[0].dictionary_encode()
        counts = np.bincount(np.asarray(words.indices), minlength=len(words.dictionary))
        names = pa.concat_arrays([words.dictionary, pa.nulls(1, pa.large_string())]).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(names)), names, pa.array(np.append(counts, len(words)))], names=["lang", "word", "n"]
        )


def _compact(states: np.ndarray, new: np.ndarray | None = None) -> np.ndarray:
    """States with one 0 wherever neighbours are not neighbours in the text; ``new`` marks first words of pieces."""
    kept = np.flatnonzero(states)
    apart = kept[1:] != kept[:-1] + 1
    if new is not None:
        apart |= new[kept[1:]]
    at = np.arange(len(kept))
    at[1:] += np.cumsum(apart)
    out = np.zeros(at[-1] + 1 if len(at) else 0, np.int32)
    out[at] = states[kept]
    return out


def _rows(states: np.ndarray) -> Iterator[np.ndarray]:
    """A sequence in rows of about ``ROW`` states, cut at its zeros only."""
    zeros, start = np.flatnonzero(states == 0), 0
    while start < len(states):
        cut = np.searchsorted(zeros, start + ROW)
        end = zeros[cut] if cut < len(zeros) else len(states)
        yield states[start:end]
        start = end + 1


def _numbered_words(shared, last: bool):
    """Texts with the numbers of the words of one list added; after the last list, sequences of numbers."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = shared.value
        for batch in batches:
            texts, before = string_column(batch, "text"), batch.column(batch.schema.get_field_index("states"))
            out: list[bytes | None] = [None] * batch.num_rows
            for lang, rows in _by_language(batch):
                words, new, offsets = _words(texts.take(pa.array(rows)))
                old = b"".join(x or b"" for x in before.take(pa.array(rows)).to_pylist())
                states = np.frombuffer(old, np.int32).copy() if old else np.zeros(len(words), np.int32)
                if lang in lists and len(words):
                    known, ids = lists[lang]
                    codes = words.dictionary_encode()
                    found = pc.index_in(codes.dictionary, value_set=known)
                    own = np.where(np.asarray(found.is_valid()), ids[np.asarray(found.fill_null(0))], 0)
                    states = np.maximum(states, own[np.asarray(codes.indices)].astype(np.int32))
                if last:
                    for row in _rows(_compact(states, new)):
                        yield pa.RecordBatch.from_arrays([pa.array([row.tobytes()], pa.binary())], names=["states"])
                else:
                    for row, a, b in zip(rows.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                        out[row] = states[a:b].tobytes()
            if not last:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["lang", "text", "states"]
                )

    return number


# ── tries ───────────────────────────────────────────────────────────────────────


class Trie(NamedTuple):
    """Double array over the digits of labels: the edge from node i by digit d leads to slot base[i] + d if check
    holds i there; target is the next node, after the last digit the state that the edge leads to."""

    nodes: np.ndarray  #: sorted states that have edges; their places are the numbers of the first nodes
    labels: np.ndarray  #: sorted states that are labels; their places are spelled in ``digits`` digits
    digits: int
    base: np.ndarray
    check: np.ndarray
    target: np.ndarray

    def step(self, states: np.ndarray) -> np.ndarray:
        """Slot that each position but the last comes to by its next one's state, -1 for none."""
        slots = np.full(len(states), -1, np.int64)
        at = np.flatnonzero((states[:-1] > 0) & (states[1:] > 0))
        node = np.searchsorted(self.nodes, states[at]).clip(max=len(self.nodes) - 1)
        label = np.searchsorted(self.labels, states[at + 1]).clip(max=len(self.labels) - 1)
        good = (self.nodes[node] == states[at]) & (self.labels[label] == states[at + 1])
        at, node, label = at[good], node[good], label[good]
        slot = node
        for place in reversed(range(self.digits)):
            slot = self.base[node] + (label // RADIX**place) % RADIX
            good = self.check[slot] == node
            at, label, slot = at[good], label[good], slot[good]
            node = self.target[slot]
        slots[at] = slot
        return slots


def _places(counts: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """Base of each node such that no two edges have one slot.  Nodes with most edges come first.  Nodes of equally many
    edges are tried together at random bases (of a fixed seed), and each that meets no other stays; those that find no
    room get new slots.  Nodes with one edge take what is free."""
    rng = np.random.default_rng(1)
    starts = np.concatenate([[0], np.cumsum(counts)])
    base = np.zeros(len(counts), np.int64)
    taken = np.zeros(int(1.5 * len(digits)) + 4 * RADIX, bool)
    for c in np.unique(counts)[::-1].tolist():
        todo = np.flatnonzero(counts == c)
        own = digits[starts[todo][:, None] + np.arange(c)]
        if c == 1:
            free = np.flatnonzero(~taken[RADIX:-RADIX])[: len(todo)] + RADIX
            new = len(taken) + np.arange(len(todo) - len(free))
            taken = np.concatenate([taken, np.zeros(len(new) + RADIX, bool)])
            base[todo] = np.concatenate([free, new]) - own[:, 0]
            break
        for _ in range(40 if c < RADIX // 4 else 0):
            if not len(todo):
                break
            tries = rng.integers(0, len(taken) - RADIX, len(todo))
            slots = tries[:, None] + own
            fits = np.flatnonzero(~taken[slots].any(1))
            first = np.zeros((len(fits), c), bool)
            first.ravel()[np.unique(slots[fits].ravel(), return_index=True)[1]] = True
            fits = fits[first.all(1)]
            base[todo[fits]] = tries[fits]
            taken[slots[fits]] = True
            left = np.ones(len(todo), bool)
            left[fits] = False
            todo, own = todo[left], own[left]
        base[todo] = len(taken) + RADIX * np.arange(len(todo))
        taken = np.concatenate([taken, np.zeros(RADIX * len(todo), bool)])
        taken[base[todo][:, None] + own] = True
    return base


def build_trie(prefixes: np.ndarray, suffixes: np.ndarray, ids: np.ndarray) -> Trie:
    """Trie of edges (prefix, suffix) to ids."""
    nodes, node = np.unique(prefixes, return_inverse=True)
    labels, label = np.unique(suffixes, return_inverse=True)
    order = np.lexsort((label, node))
    node, label, ids = node[order], label[order], ids[order]
    places = max(1, -(-(len(labels) - 1).bit_length() // (RADIX.bit_length() - 1)))
    parents, digits, targets, known = [], [], [], len(nodes)
    for place in reversed(range(places)):
        digit = (label // RADIX**place) % RADIX
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (digit[1:] != digit[:-1])
        child = known + np.cumsum(new) - 1
        parents.append(node[new])
        digits.append(digit[new])
        targets.append(child[new] if place else ids)
        known += int(new.sum()) if place else 0
        node = child
    parents, digits, targets = (np.concatenate(x) for x in (parents, digits, targets))
    base = _places(np.bincount(parents, minlength=known), digits).astype(np.int32)  # parents ascend
    slots = base[parents] + digits
    check = np.full(int(base.max(initial=0)) + RADIX, -1, np.int32)
    target = np.zeros(len(check), np.int32)
    check[slots], target[slots] = parents, targets
    return Trie(nodes, labels, places, base, check, target)


def _advanced(shared, last: bool):
    """Sequences one level on, and after all of them how often each slot accepted, ``BLOCK`` slots to a row, in as
    few bytes a slot as the largest count of the row takes.

    ``states`` are the level before; ``longer`` what earlier tries of the level found, position by position."""

    def row(states=None, longer=None, block=None, counts=None):
        return pa.RecordBatch.from_arrays(
            [pa.array([states], pa.binary()), pa.array([longer], pa.binary()), pa.array([block], pa.int32()), pa.array([counts], pa.binary())],
            names=["states", "longer", "block", "counts"],
        )

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: Trie = shared.value
        counts = np.zeros(-(-len(trie.check) // BLOCK) * BLOCK, np.int64)
        for batch in batches:
            for old, longer in zip(batch.column(0), batch.column(1), strict=True):
                states = np.frombuffer(old.as_py(), np.int32)
                slots = trie.step(states)
                hit = slots >= 0
                np.add.at(counts, slots[hit], 1)
                found = np.zeros(len(states), np.int32) if longer.as_py() is None else np.frombuffer(longer.as_py(), np.int32).copy()
                found[hit] = trie.target[slots[hit]]
                if not last:
                    yield row(states.tobytes(), found.tobytes())
                elif found.any():
                    yield row(_compact(found).tobytes())
        for block, part in enumerate(counts.reshape(-1, BLOCK)):
            if part.any():
                yield row(block=block, counts=part.astype(np.min_scalar_type(part.max())).tobytes())

    return advance


def _summed(shared):
    """Sums of the counts of equal blocks, which follow one another, as the states' frequencies."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, now, total = shared.value.target, None, np.zeros(BLOCK, np.int64)

        def out():
            used = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(target[now * BLOCK + used]), pa.array(total[used])], names=["id", "f"])

        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if now is not None and block != now:
                    yield out()
                    total[:] = 0
                now = block
                own = counts.as_py()
                total += np.frombuffer(own, f"u{len(own) // BLOCK}").astype(np.int64)
        if now is not None:
            yield out()

    return sums


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a state and the next position's state stand side by side, as one long of both."""
    waiting: list[np.ndarray] = []

    def counted() -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(waiting or [np.zeros(0, np.int64)]), return_counts=True)
        waiting.clear()
        for a in range(0, len(keys), SENT):
            part = [pa.array(x[a : a + SENT], pa.int64()) for x in (keys, n)]
            yield pa.RecordBatch.from_arrays(part, names=["pair", "n"])

    size = 0
    for batch in batches:
        for row in batch.column(0):
            states = np.frombuffer(row.as_py(), np.int32).astype(np.int64)
            at = np.flatnonzero((states[:-1] > 0) & (states[1:] > 0))
            waiting.append(states[at] << 32 | states[at + 1])
            size += len(at)
            if size >= PAIRS:
                yield from counted()
                size = 0
    yield from counted()


# ── levels ──────────────────────────────────────────────────────────────────────


def _numbered(rows: DataFrame, keys: list[str], size: Column, shard: int) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` with a positive int ``id`` each, stored, and their parts of at most ``shard`` rows and
    ``SHARD_BYTES`` of ``size``.  ``keys`` tell rows apart; hashes of them spread the rows over buckets."""
    spark = rows.sparkSession
    with _few_rows(spark):
        rows, folder = stored_in(rows)
    n, volume = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = max(1, -(-2 * n // shard), -(-2 * volume // SHARD_BYTES)) if n else 0
    buckets = max(64, -(-2 * n // BUCKET), parts)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    place = F.row_number().over(W.partitionBy("bucket").orderBy(*keys))
    numbered = stored(
        rows.withColumn("bucket", bucket).withColumn("place", place).withColumn(
            "id", F.when(F.col("place") < BUCKET, F.col("bucket") * BUCKET + F.col("place")).otherwise(
                F.raise_error(F.lit("more rows in a bucket than numbers"))
            )
        ).drop("place")
    )
    remove_table(spark, folder)
    return numbered.drop("bucket"), [numbered.where(F.col("bucket") % parts == p) for p in range(parts)]


def _sequences(docs: DataFrame, lists: list[DataFrame]) -> tuple[DataFrame, str]:
    """Sequences of the numbers of frequent words, and their folder."""
    spark = docs.sparkSession
    context = spark.sparkContext
    rows, folder = docs.withColumn("states", F.lit(None).cast("binary")), None
    for place, part in enumerate(lists):
        words = part.select("lang", "word", "id").toArrow()  # at most SHARD rows
        by_lang = {}
        for lang in words["lang"].unique().to_pylist():
            own = words.filter(pc.equal(words["lang"], lang))
            by_lang[lang] = (own["word"].combine_chunks().cast(pa.large_string()), np.asarray(own["id"]))
        last = place == len(lists) - 1
        shared = context.broadcast(by_lang)
        schema = "states binary" if last else "lang string, text string, states binary"
        read = folder
        with _few_rows(spark):
            rows, folder = stored_in(rows.mapInArrow(_numbered_words(shared, last), schema))
        if read:
            remove_table(spark, read)
        shared.unpersist()
    return rows, folder


def _next_states(states: DataFrame, folder: str, parts: list[DataFrame]) -> tuple[DataFrame, str, DataFrame]:
    """Sequences one level on, their folder, and ``id, f`` of the level's phrases.  ``folder``, of ``states``, is removed."""
    spark = states.sparkSession
    context = spark.sparkContext
    rows, sums = states.select("states", F.lit(None).cast("binary").alias("longer")), []
    for place, part in enumerate(parts):
        edges = part.select("prefix", "suffix", "id").toArrow()  # at most SHARD rows
        shared = context.broadcast(build_trie(*(np.asarray(edges[c]) for c in ("prefix", "suffix", "id"))))
        read = folder
        with _few_rows(spark):
            passed, folder = stored_in(
                rows.mapInArrow(
                    _advanced(shared, place == len(parts) - 1), "states binary, longer binary, block int, counts binary"
                )
            )
            remove_table(spark, read)
            rows = passed.where("block is null").select("states", "longer")
            blocks = passed.where("block is not null").select("block", "counts")
            sums.append(
                stored(blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_summed(shared), "id int, f bigint"))
            )
        shared.unpersist()
    return rows.select("states"), folder, reduce(DataFrame.unionByName, sums)


def phrases(docs: DataFrame, least: int = 30, longest: int = 4) -> tuple[DataFrame, list[DataFrame]]:
    """``lang, n`` of all words, and a table of the frequent phrases of each length from one word on.

    ``phrase`` occurs ``f`` times; ``heads`` and ``tails`` are the frequencies of its first and last words, cut after
    1, 2, … words; ``prefix`` and ``suffix`` are its first and last k - 1 words in the table before.
    """
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string"))
    with _few_rows(docs.sparkSession):
        counted = stored(
            docs.mapInArrow(_word_counts, "lang string, word string, n bigint")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= least))
        )
    totals = counted.where("word is null").select("lang", "n")
    words, lists = _numbered(counted.where("word is not null"), ["lang", "word"], F.octet_length("word") + 16, SHARD)
    none = F.array().cast("array<bigint>")
    nothing = F.lit(None).cast("int")
    level = words.select(
        "id", "lang", F.col("word").alias("phrase"), F.col("word").alias("final"), F.col("n").alias("f"),
        none.alias("heads"), none.alias("tails"), nothing.alias("prefix"), nothing.alias("suffix"),
    )
    levels = [level]
    if not lists:
        return totals, levels
    states, folder = _sequences(docs, lists)
    for _ in range(longest - 1):
        pairs = (
            states.mapInArrow(_neighbours, "pair bigint, n bigint")
            .groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        )
        edges, parts = _numbered(
            pairs.select(
                F.shiftright("pair", 32).cast("int").alias("prefix"),
                F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")).cast("int").alias("suffix"),
            ),
            ["prefix", "suffix"], F.lit(12), 4 * SHARD,
        )
        if not parts:
            break
        states, folder, sums = _next_states(states, folder, parts)
        head = level.select(
            F.col("id").alias("prefix"), "lang", F.col("phrase").alias("first"),
            F.concat("heads", F.array("f")).alias("heads"),
        )
        tail = level.select(F.col("id").alias("suffix"), "final", F.concat(F.array("f"), "tails").alias("tails"))
        level = stored(
            edges.join(sums, "id").join(head, "prefix").join(tail, "suffix").select(
                "id", "lang", F.concat_ws(" ", "first", "final").alias("phrase"), "final", "f",
                "heads", "tails", "prefix", "suffix",
            )
        )
        levels.append(level)
    return totals, levels


#: Score of each cut as exact integers; the lowest counts, then the earliest.
LOWEST_CUT = """array_min(transform(sequence(1, size(heads)), k -> struct(
    cast({scale} as decimal(10,0)) * cast(a as decimal(20,0))
      div (cast(heads[k - 1] as decimal(20,0)) + cast(tails[k - 1] as decimal(20,0))) as score,
    k, heads[k - 1] as l, tails[k - 1] as r)))"""


def collocations(
    docs: DataFrame, least: int = 30, longest: int = 4, within: int = 80, scale: int = 2_000_000, first: int = 2000
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``first`` phrases of 2 to ``longest`` words of each language.

    A phrase is dropped if a longer one that holds it is at least ``within`` percent as frequent.  That a phrase one word
    longer is looked at is enough: what a still longer one holds, one of its parts one word longer holds as often.
    """
    totals, levels = phrases(docs, least, longest)
    found = []
    for level, longer in zip(levels[1:], [*levels[2:], None], strict=False):
        rows = level.withColumnRenamed("f", "a")
        if longer is not None:
            holders = longer.select(F.col("prefix").alias("id"), "f").unionByName(longer.select(F.col("suffix").alias("id"), "f"))
            rows = rows.join(holders.groupBy("id").agg(F.max("f").alias("cover")), "id", "left").where(
                f"cover is null or 100 * cast(cover as decimal(20,0)) < {within} * cast(a as decimal(20,0))"
            )
        found.append(rows.select("lang", "phrase", "a", F.expr(LOWEST_CUT.format(scale=scale)).alias("cut")))
    if not found:
        found = [
            levels[0].limit(0).select(
                "lang", "phrase", F.col("f").alias("a"),
                F.expr("named_struct('score', 0L, 'k', 0, 'l', 0L, 'r', 0L)").alias("cut"),
            )
        ]
    rows = reduce(DataFrame.unionByName, found).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may hold a third of all phrases: ranks inside parts of it leave few rows for the last ranking.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*best)))
    rows = rows.where(F.col("rank") <= first).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)))
    return rows.where(F.col("rank") <= first).join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
