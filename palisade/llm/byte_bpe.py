"""Byte-level BPE with the encoding as a monoid: halves are encoded and joined up a tree.

A token sequence is the BPE encoding of its bytes if and only if every two neighbours are the
encoding of their own bytes: merges go by rank, then place, so the first merge that crosses a
boundary would also cross it when the two tokens stand alone, and the other way round.  Two encoded
halves are therefore joined by encoding a window around their seam anew, and by doubling it on the
side where the window's outer token and its outside neighbour do not stand; where both stand, no
token outside the window can change.  Decoding concatenates up the same kind of tree.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm import text as tx

#: Bytes that are merged directly; longer runs are halved.
LEAF_BYTES = 24
#: Ids that are decoded directly.
LEAF_IDS = 4096
#: Entries of each cache of a Python worker; a full generation replaces the one before.
CACHE_ENTRIES = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: per line a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.matches = regex.compile(pattern)
        self.new: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self._stand: dict[tuple[int, int], bool] = {}

    # One match of the pattern.

    def merged(self, data: bytes) -> list[int]:
        """Merges by rank, then place: the definition, for short runs by repeated search."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        if len(data) > 4 * LEAF_BYTES:
            return self._merged_by_heap(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[x] for x in parts]

    def _merged_by_heap(self, parts: list[bytes]) -> list[int]:
        ranks, n = self.ranks, len(parts)
        behind, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, 1, 1) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = behind[i]
            if not alive[i] or j >= n or len(parts[i]) != left or len(parts[j]) != right:
                continue
            parts[i] += parts[j]
            alive[j] = False
            behind[i] = k = behind[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]), len(parts[b])))
        return [ranks[x] for x, there in zip(parts, alive, strict=True) if there]

    def stands(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes is just these two tokens."""
        known = self._stand.get((a, b))
        if known is None:
            if len(self._stand) > CACHE_ENTRIES:
                self._stand.clear()
            known = self._stand[a, b] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of two encodings."""
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            window = self.merged(b"".join(map(self.tokens.__getitem__, left[-i:] + right[:j])))
            left_stands = i >= len(left) or self.stands(left[-i - 1], window[0])
            right_stands = j >= len(right) or self.stands(window[-1], right[j])
            if left_stands and right_stands:
                return left[:-i] + window + right[j:]
            i = i if left_stands else 2 * i
            j = j if right_stands else 2 * j

    def encode_match(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return self._encode_tree(data) if whole is None else [whole]

    def _encode_tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self._encode_tree(data[:half]), self._encode_tree(data[half:]))

    # Whole texts.

    def _encode_part(self, part: str) -> bytes:
        ids = [x for match in self.matches.findall(part) for x in self.encode_match(match.encode())]
        return np.array(ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of a space and a chunk; None if white space touches the space, so that it can't stand alone."""
        known = self.old.get(chunk, self)
        if known is self:
            alone = chunk and not chunk[0].isspace() and not chunk[-1].isspace()
            known = self._encode_part(" " + chunk) if alone else None
        if len(self.new) >= CACHE_ENTRIES:
            self.old, self.new = self.new, {}
        if len(chunk) < 200:
            self.new[chunk] = known
        return known

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.  A match starts at each space that stands alone
        between other characters, so what lies between such spaces is encoded once and remembered."""
        first, *chunks = text.split(" ")
        found = [self.new[c] if c in self.new else self._chunk(c) for c in chunks]
        if None in found or first[-1:].isspace():
            return self._encode_part(text)
        return self._encode_part(first) + b"".join(found)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids``: little-endian unsigned 32-bit integers, and ``n_tokens``.

    The ids are those of each match of ``pattern`` in ``text`` by itself; no special tokens.  The file at
    ``ranks_path`` must be readable on every executor.  A null or empty text has no ids.  Other columns
    pass through; those named like a result are replaced.
    """
    docs = docs.drop("ids", "n_tokens")
    columns = docs.columns

    def encode(batches):
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            texts = tx.string_column(batch, "text")
            for a, b in tx.chunks(texts, 4 * tx.CHUNK_BYTES):
                ids = [coder.encode(x or "") for x in texts.slice(a, b - a).to_pylist()]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array(ids, pa.binary()), counts],
                    names=[*columns, "ids", "n_tokens"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(encode, f"{schema}, ids binary, n_tokens long")


def decode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs`` with ``decoded``: the bytes of ``ids``.  Null ids decode to no bytes.  An id outside the
    vocabulary fails.  Other columns pass through; one named like the result is replaced."""
    docs = docs.drop("decoded")
    columns = docs.columns

    def decode(batches):
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            ids = batch.column(columns.index("ids"))
            for i in range(0, batch.num_rows, 500):
                blobs = ids.slice(i, 500).to_pylist()
                decoded = [coder.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in blobs]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, 500).columns, pa.array(decoded, pa.binary())], names=[*columns, "decoded"]
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(decode, f"{schema}, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Digests of ids and of what they decode to."""
    encoded = encode_documents(docs.select("doc_id", "text"), ranks_path, pattern).drop("text")
    return decode_documents(encoded, ranks_path, pattern).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
