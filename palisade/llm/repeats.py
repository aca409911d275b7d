"""Removal of passages that an earlier document already holds (seed and extend).

Seed: every document's word 26-grams are winnowed (the smallest hash of each 25 neighbours is an
anchor), so any two equal runs of 50 words share an anchor at the same place of the run.  Documents
are joined on their anchors by way of a pre-aggregated table of the anchors that two documents hold.
Extend: each shared anchor is extended to both sides to the windows whose least gram it is; a window is the
least gram's in every document that holds it, so no other window around the anchor can repeat.  The windows go, as 128-bit hashes, to a minimum over document ids, so the members
of a group never meet in pairs, however large the group is.  Neighbouring windows merge into maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm import text as tx
from palisade.session import cut_lineage, stored

_FARTHEST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _least(values: np.ndarray, span: int, best=np.minimum) -> np.ndarray:
    """best over values[i : i + span] for each i with a whole span."""
    width, out = 1, values
    while width * 2 <= span:
        out = best(out[:-width], out[width:])
        width *= 2
    rest = span - width
    return best(out[:-rest], out[rest:]) if rest else out


def _grams(words: tx.Words, size: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window at each word, and whether it lies in one text."""
    counts = words.counts()
    out = np.full(len(words.starts), _FARTHEST)
    found = tx.windows(words.hashes(lane), size, lane)
    out[: len(found)] = found
    left = np.repeat(words.offsets[1:], counts) - np.arange(len(out))
    return out, left >= size


def _anchors(words: tx.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash at each word, whether it is an anchor, and the least gram of the window at each word."""
    grams, whole = _grams(words, gram)
    span = window - gram + 1
    padded = np.concatenate([np.where(whole, grams, _FARTHEST), np.full(span, _FARTHEST)])
    least = _least(padded, span)
    # A gram is chosen if it is the least of one of the spans it lies in.
    led = _least(np.concatenate([np.zeros(span - 1, np.uint64), least]), span, np.maximum)
    return grams, whole & (grams == led[: len(grams)]), least[: len(grams)]


def _marked(at: np.ndarray, n: int, before: int, behind: int) -> np.ndarray:
    """Which of n places lie in [p - before, p + behind] for a marked p."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.maximum(np.flatnonzero(at) - before, 0), 1)
    np.add.at(steps, np.minimum(np.flatnonzero(at) + behind + 1, n), -1)
    return np.cumsum(steps[:n]) > 0


def _once(owner: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """First place of each distinct (owner, keys)."""
    order = np.lexsort((*keys, owner))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for x in (owner, *keys):
            new[1:] |= x[order][1:] != x[order][:-1]
    return order[new]


def _given(lists: pa.Array, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the hash lists of a batch."""
    lists = lists.cast(pa.large_list(pa.int64()))
    flat = np.asarray(lists.flatten()).view(np.uint64)
    sizes = np.asarray(lists.value_lengths().fill_null(0).cast(pa.int64()))
    return np.repeat(np.arange(rows), sizes), flat


def _among(owner: np.ndarray, hashes: np.ndarray, rows: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Which (owner, hash) are among the given (row, hash).  Owner and hash are mixed to one key."""
    salt = np.uint64(0x9E3779B97F4A7C15)
    return np.isin(
        tx.mix(hashes + owner.astype(np.uint64) * salt), tx.mix(given + rows.astype(np.uint64) * salt)
    )


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in tx.chunks(tx.string_column(batch, "text")):
            yield batch.slice(a, b - a)


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``.

    Removed is each word covered by a window of ``window`` consecutive words whose word sequence also
    starts in a document with a smaller ``doc_id``.  ``kept_text`` joins the kept words by one space.

    Null and empty texts have no words: counts 0, ``kept_text`` ''.  Rows with a null ``doc_id`` have no
    place in the order: they are kept whole and remove nothing.  Rows that share a ``doc_id`` do not
    remove from each other.  Other columns pass through; those named like a result are replaced.
    """
    if window < 4:
        raise ValueError("window must be 4 words at least")
    gram = window // 2 + 1
    results = ("n_words", "n_removed", "kept_text")
    docs = docs.drop(*results)
    columns = docs.columns
    numbered = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    digest = F.sha2(F.col("text").cast("binary"), 256)

    def seeds(batches):
        for batch in _slices(batches):
            words = tx.words(tx.string_column(batch, "text"))
            grams, chosen, _ = _anchors(words, window, gram)
            at = np.flatnonzero(chosen)
            owner = tx.spread(words.counts())[at]
            first = _once(owner, grams[at])
            yield pa.RecordBatch.from_arrays(
                [tx.pick(batch.column(0), owner[first]), pa.array(grams[at][first].view(np.int64))],
                names=["doc_id", "anchor"],
            )

    def extensions(batches):
        for batch in _slices(batches):
            words = tx.words(tx.string_column(batch, "text"))
            _, _, least = _anchors(words, window, gram)
            owner = tx.spread(words.counts())
            first_lane, whole = _grams(words, window)
            second_lane, _ = _grams(words, window, 1)
            places = np.flatnonzero(whole)
            later, first = (
                _among(owner[places], least[places], *_given(batch.column(i), batch.num_rows)) for i in (2, 3)
            )
            at, late = places[later | first], later[later | first]
            once = _once(owner[at], first_lane[at], second_lane[at])
            at, late = at[once], late[once]
            yield pa.RecordBatch.from_arrays(
                [
                    tx.pick(batch.column(0), owner[at]),
                    pa.array(first_lane[at].view(np.int64)),
                    pa.array(second_lane[at].view(np.int64)),
                    pa.array(late),
                ],
                names=["doc_id", "first_hash", "second_hash", "later"],
            )

    def cut(batches):
        for batch in _slices(batches):
            part = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            words = tx.words(tx.string_column(batch, "text"))
            counts = words.counts()
            owner = tx.spread(counts)
            rows, given = _given(part[hashes_of], batch.num_rows)
            seen = np.zeros(len(owner), bool)
            if len(given):
                hashes, whole = _grams(words, window)
                at = np.flatnonzero(whole & np.isin(owner, rows))
                seen[at] = _among(owner[at], hashes[at], rows, given)
            gone = _marked(seen, len(owner), 0, window - 1)
            copies = np.asarray(part[copy_of].fill_null(False).to_numpy(zero_copy_only=False), bool)
            gone |= (copies & (counts >= window))[owner]
            kept = [
                words.string(i, ~gone[words.offsets[i] : words.offsets[i + 1]]).decode()
                for i in range(batch.num_rows)
            ]
            found = (counts, np.bincount(owner[gone], minlength=batch.num_rows), kept)
            yield pa.RecordBatch.from_arrays(
                [*(part[c] for c in columns), *(pa.array(x) for x in found)],
                names=[*columns, *results],
            )

    def shared(found: DataFrame, *keys: str) -> DataFrame:
        """Keys that two documents hold, with the first of these.  Written, so that the join that
        follows shuffles both sides itself and can split a key that very many documents hold."""
        groups = found.groupBy(*keys).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        return cut_lineage(groups.where("first_doc < last_doc").drop("last_doc"))

    hashes_of, firsts_of, copies_of, copy_of = (free_name(docs, x) for x in ("hashes", "firsts", "copies", "copy"))

    def marks(hashes: DataFrame) -> DataFrame:
        """Per document its hashes that an earlier document holds and those it is the first to hold, and
        the digests of those of its rows that copy an earlier one."""
        both = hashes.select("doc_id", "hash", "later", F.lit(None).cast("string").alias("digest")).unionByName(
            copies.select("doc_id", F.lit(None).cast("long").alias("hash"), F.lit(True).alias("later"), "digest")
        )
        return both.groupBy("doc_id").agg(
            F.collect_set(F.when(F.col("later"), F.col("hash"))).alias(hashes_of),
            F.collect_set(F.when(~F.col("later"), F.col("hash"))).alias(firsts_of),
            F.collect_set("digest").alias(copies_of),
        )

    texts = numbered.select("doc_id", digest.alias("digest"))
    copies = cut_lineage(
        texts.join(shared(texts, "digest"), "digest").where("first_doc < doc_id").select("doc_id", "digest")
    )
    is_copy = F.array_contains(copies_of, digest)

    seeded = numbered.mapInArrow(seeds, f"doc_id {kind}, anchor long")
    later = (F.col("first_doc") < F.col("doc_id")).alias("later")
    anchored = seeded.join(shared(seeded, "anchor"), "anchor").select("doc_id", F.col("anchor").alias("hash"), later)
    extended = stored(
        numbered.join(marks(anchored), "doc_id")
        .where(~is_copy)
        .select("doc_id", "text", hashes_of, firsts_of)
        .mapInArrow(extensions, f"doc_id {kind}, first_hash long, second_hash long, later boolean")
    )
    keys = ("first_hash", "second_hash")
    # A window around an anchor that its document is the first to hold is in no earlier document.
    seen = (
        extended.where("later").drop("later").join(shared(extended, *keys), list(keys))
        .where("first_doc < doc_id")
        .select("doc_id", F.col("first_hash").alias("hash"), F.lit(True).alias("later"))
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return (
        docs.join(marks(seen), "doc_id", "left")
        .select(*columns, hashes_of, is_copy.alias(copy_of))
        .mapInArrow(cut, f"{schema}, n_words long, n_removed long, kept_text string")
    )
