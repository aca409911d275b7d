"""Packing of documents into sequences of bounded length by hierarchical residual best fit.

Pieces are spread evenly over partitions.  Each partition packs its own, longest first, each into the
bin with the least room that takes it, and emits the bins that are nearly full.  The underfull bins are
the items of the next round, in fewer partitions, and so on up a tree; what they hold moves
with them.  Partitions are sized by a number of items, so no task gets more as the input grows, and
rounds go on while they still merge bins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.word_tokens import encoded_batches
from palisade.session import stored

CAPACITY = 2048
#: Items of a partition; best fit on so many leaves little to gain from more.
PARTITION_ITEMS = 100_000
#: A bin with at most this share of room left is emitted at once.
NEARLY_FULL = 1 / 256


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: longest first, each into the fullest bin that takes it.

    Open bins are kept by room; one integer has a bit for each room that some bin has."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            found = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, found = capacity, opened
            opened += 1
        bins[item], offsets[item] = found, capacity - room
        left = room - length
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(found)
    return bins, offsets


def pack(items: DataFrame, capacity: int = CAPACITY, partition_items: int = PARTITION_ITEMS) -> DataFrame:
    """``item, sequence_id, offset`` of ``items (item, length)``: distinct longs with lengths from 1 to ``capacity``.

    A bin is named by its smallest-placed item, so names are unique without a counter.  Items that
    fill a bin alone never move.
    """

    def round_of(batches):
        parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
        if not parts:
            return
        item, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(item, kind="stable")  # the same bins whichever order the rows came in
        item, length = item[order], length[order]
        bins, offsets = best_fit(length, capacity)
        names = np.zeros(len(item), np.int64)
        names[bins[offsets == 0]] = item[offsets == 0]
        fill = np.bincount(bins, length, len(item)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (item, names[bins], offsets, fill[bins])], names=["item", "bin", "at", "fill"]
        )

    rounds, left = [], items.select("item", F.col("length").cast("long"))
    count = left.where(F.col("length") < capacity).count()
    while True:
        partitions = max(1, -(-count // partition_items))
        packed = stored(
            left.where(F.col("length") < capacity)
            .repartition(partitions, F.xxhash64("item", F.lit(len(rounds))))
            .mapInArrow(round_of, "item long, bin long, at long, fill long")
        )
        rounds.append(packed)
        under = packed.where((F.col("at") == 0) & (F.col("fill") < capacity * (1 - NEARLY_FULL)))
        left = under.select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        before, count = count, left.count()
        merged = before - packed.where("at = 0").count()
        if partitions == 1 or not merged:
            break
    whole = items.where(F.col("length") >= capacity)
    placed = whole.select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    inner = rounds[-1].select("item", "bin", "at")
    for outer in reversed(rounds[:-1]):
        moved = inner.select(F.col("item").alias("bin"), F.col("bin").alias("into"), F.col("at").alias("behind"))
        inner = outer.join(moved, "bin", "left").select(
            "item", F.coalesce("into", "bin").alias("bin"), (F.col("at") + F.coalesce("behind", F.lit(0))).alias("at")
        )
    return placed.unionByName(inner.select("item", F.col("bin").alias("sequence_id"), F.col("at").alias("offset")))


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs (doc_id, text)`` and their places:
    ``doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset``.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut, into pieces of
    ``capacity`` ids, the last may be shorter.  ``ids`` are little-endian unsigned 32-bit integers.
    Null and empty texts are the end id only.  Every row is packed, also with a null or repeated ``doc_id``.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def cut(batches):
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for part, encoded in encoded_batches(batches, tokenizer):
            pieces = [(i, n, x[n * step : (n + 1) * step]) for i, x in enumerate(e + end for e in encoded) for n in range(-(-len(x) // step))]
            row, number, ids = zip(*pieces, strict=True) if pieces else ((),) * 3
            length = [len(x) // 4 for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(row, pa.int64())),
                    pa.array(number, pa.int32()),
                    pa.array([n * capacity for n in number], pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids", "ids_crc32"],
            )

    cut_up = rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary, ids_crc32 long")
    pieces = stored(cut_up.withColumn("item", F.monotonically_increasing_id()))
    return pieces.join(pack(pieces.select("item", "length"), capacity), "item").drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids`` of each sequence: its pieces' ids by offset.  A sequence is bounded by the capacity."""
    parts = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda ids, x: F.concat(ids, x["ids"]))
    return parts.select("sequence_id", "n_tokens", joined.alias("ids"))
