r"""Token ids in files of length-delimited binary records, with a separate index of offsets.

A shard is a file of records in ascending ``doc_id`` order; shards are in order by name.  A record is

    length    8 bytes  little-endian, of the payload
    check     4 bytes  masked CRC-32 of the 8 length bytes
    payload            8 bytes doc_id (signed), 1 byte flags, then the ids
    check     4 bytes  masked CRC-32 of the payload
    end       1 byte   \n

Flag 1: ids are 4 bytes wide instead of 2.  Flag 2: the document has no doc_id (null).  A check is
masked (rotated by 15 bits, plus a constant) so that data that holds checks does not check itself.

Spark's text writer puts the records into files: its commit protocol leaves whole shards of the
attempts that succeeded, on any file system that Spark can write, and executors may be lost.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm.word_tokens import encoded_batches

SHARD_BYTES = 32 << 20
_MASK = 0xA282EAD8
_LENGTH, _CHECK, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qB")
_WIDE, _NULL = 1, 2


def masked(data) -> int:
    check = zlib.crc32(data)
    return ((check >> 15 | check << 17) + _MASK) & 0xFFFFFFFF


def framed(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record without its end byte."""
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    flags = _WIDE * wide | _NULL * (doc_id is None)
    payload = _HEAD.pack(doc_id or 0, flags) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = _LENGTH.pack(len(payload))
    return length + _CHECK.pack(masked(length)) + payload + _CHECK.pack(masked(payload))


def parsed(shard: memoryview, at: int = 0):
    """(offset, length of the record, doc_id, ids) of each record from ``at`` on; a record that fails a check raises."""
    while at < len(shard):
        length = shard[at : at + 8]
        (size,) = _LENGTH.unpack(length)
        if _CHECK.unpack(shard[at + 8 : at + 12])[0] != masked(length):
            raise ValueError(f"damaged length at byte {at}")
        payload = shard[at + 12 : at + 12 + size]
        if len(payload) < size or _CHECK.unpack(shard[at + 12 + size : at + 16 + size])[0] != masked(payload):
            raise ValueError(f"damaged record at byte {at}")
        doc_id, flags = _HEAD.unpack(payload[: _HEAD.size])
        ids = np.frombuffer(payload[_HEAD.size :], "<u4" if flags & _WIDE else "<u2")
        yield at, size + 17, None if flags & _NULL else doc_id, ids
        at += size + 17


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes the ids of ``docs (doc_id, text)``, each document's followed by ``end_id``, to ``folder``.

    Texts are range-partitioned by ``doc_id`` before they are encoded, so the sort's sample reads only the
    table; a shard holds about ``shard_bytes`` of text.  Null and empty texts have the end id only.
    Null ids come first; rows that share a ``doc_id`` are all written, next to each other.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.repartitionByRange(size // shard_bytes + 1, "doc_id").sortWithinPartitions("doc_id")

    def frame(batches):
        for part, encoded in encoded_batches(batches, tokenizer):
            end = np.array([end_id], "<u4")
            records = [
                framed(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]))
                for doc_id, ids in zip(part.column(0).to_pylist(), encoded, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    records = ordered.mapInArrow(frame, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.mode("overwrite").text(f"{folder}/shards")
    index_records(docs.sparkSession, folder).write.mode("overwrite").parquet(f"{folder}/index")


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .load(f"{folder}/shards")
        .select(F.regexp_extract("path", "[^/]+$", 0).alias("shard"), "content")
    )


def index_records(spark: SparkSession, folder: str) -> DataFrame:
    """``shard, record, offset, length, doc_id, n_tokens`` of each record, from the files themselves."""

    def index(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0), batch.column(1), strict=True):
                found = [(o, n, d, len(ids)) for o, n, d, ids in parsed(memoryview(content.as_buffer()))]
                offset, length, doc_id, n_tokens = zip(*found, strict=True) if found else ((),) * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard.as_py()] * len(found), pa.string()),
                        *(pa.array(x, pa.int64()) for x in (range(len(found)), offset, length, doc_id, n_tokens)),
                    ],
                    names=["shard", "record", "offset", "length", "doc_id", "n_tokens"],
                )

    return _shards(spark, folder).mapInArrow(
        index, "shard string, record long, offset long, length long, doc_id long, n_tokens long"
    )


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids, shard, record`` of each record, checks verified.

    ``start`` counts the ids of all records before it.  ``ids``: little-endian unsigned 32-bit integers.
    """

    def read(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0), batch.column(1), strict=True):
                before, rows = 0, []
                for record, (_, _, doc_id, ids) in enumerate(parsed(memoryview(content.as_buffer()))):
                    rows.append((doc_id, before, len(ids), ids.astype("<u4").tobytes(), shard.as_py(), record))
                    before += len(ids)
                    if len(rows) == 1000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    inside = _shards(spark, folder).mapInArrow(
        read, "doc_id long, before long, n_tokens long, ids binary, shard string, record long"
    )
    totals = spark.read.parquet(f"{folder}/index").groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # One row per shard goes through this window, not one per record.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("shard_start"))
    return inside.join(F.broadcast(starts), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids", "shard", "record"
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64())
    columns = zip(*rows, strict=True) if rows else ((),) * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)],
        names=["doc_id", "before", "n_tokens", "ids", "shard", "record"],
    )


def shuffled_records(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """The records in a pseudo-random order that ``seed`` fixes: ``place`` (the sort key), ``doc_id``, ``ids``.

    The order is decided on the narrow index; each shard is opened once, at the offsets the index names.
    """
    wanted = spark.read.parquet(f"{folder}/index").groupBy("shard").agg(
        F.collect_list(F.struct(F.xxhash64(F.lit(seed), "shard", "record").alias("place"), "offset")).alias("wanted")
    )

    def pick(batches):
        for batch in batches:
            for content, wanted in zip(batch.column(0), batch.column(1), strict=True):
                shard = memoryview(content.as_buffer())
                for row in wanted.as_py():
                    _, _, doc_id, ids = next(parsed(shard, row["offset"]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["place"]], pa.int64()),
                            pa.array([doc_id], pa.int64()),
                            pa.array([ids.astype("<u4").tobytes()], pa.binary()),
                        ],
                        names=["place", "doc_id", "ids"],
                    )

    picked = _shards(spark, folder).join(wanted, "shard").select("content", "wanted")
    return picked.mapInArrow(pick, "place long, doc_id long, ids binary").orderBy("place")
