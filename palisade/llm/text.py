"""Words and word windows of whole Arrow batches as hashes, computed with numpy.

A word is a run of ``[^\\x20\\x09-\\x0D]``.  A batch's bytes are hashed once as prefix sums of a
polynomial modulo the prime 2**61 - 1, so the hash of any word, and of any run of words, is one subtraction and
one multiplication.  Over a field two different runs of n bytes are equal for n of the 2**61 bases at most (modulo a
power of two there are strings that are equal for every base).  Two lanes (different constants) give 122 bits where
equality must hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that are hashed at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: The field that hashes are computed in.
PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)


class _Lane(NamedTuple):
    letters: np.ndarray  #: a number below 2**31 for each byte
    byte_base: int
    word_base: int


def _lane(seed: int) -> _Lane:
    rng = np.random.default_rng(seed)
    bases = rng.integers(1 << 32, PRIME - 1, 2)
    return _Lane(rng.choice((1 << 31) - 1, 256, replace=False).astype(np.uint64) + np.uint64(1), int(bases[0]), int(bases[1]))


LANES = (_lane(20_011), _lane(77_003))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, for 64-bit numbers."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray, small: bool = False) -> np.ndarray:
    """Product modulo the prime of numbers below it (``small``: b below 2**31), from halves of 31 bits."""
    high, low = a >> _31, a & _LOW31
    if small:
        middle, rest = high * b, low * b
    else:
        b_high, b_low = b >> _31, b & _LOW31
        middle = high * b_low + low * b_high
        rest = low * b_low + ((high * b_high) << np.uint64(1))  # 2**62 is 2
    # middle * 2**31: its upper part stands for multiples of 2**61, which is 1.
    return _reduced(rest + (middle >> _30) + ((middle & _LOW30) << _31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo the prime; tables up to the chunk size are kept."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.ones(1, np.uint64)
        while len(known) < max(n, 1 << 16):
            known = np.concatenate([known, _times(known, np.full(1, pow(base, len(known), PRIME), np.uint64))])
        if n <= 4 * CHUNK_BYTES:
            _POWERS[base] = known
    return known[:n]


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, small: bool = False) -> np.ndarray:
    """Hash of values[start:end] for each pair, the same wherever the run stands (``small``: values below 2**31)."""
    terms = _times(_powers(base, len(values)), values if small else _reduced(values), small)
    high, low = np.zeros(len(values) + 1, np.uint64), np.zeros(len(values) + 1, np.uint64)
    np.cumsum(terms >> _31, out=high[1:])
    np.cumsum(terms & _LOW31, out=low[1:])
    upper = _times(_reduced(high[ends] - high[starts]), np.full(1, 1 << 31, np.uint64))
    inverse = _powers(pow(base, -1, PRIME), len(values) + 1)[starts]
    return mix(_times(_reduced(upper + _reduced(low[ends] - low[starts])), inverse))


class Words(NamedTuple):
    """Words of a chunk of texts."""

    starts: np.ndarray  #: first byte of each word in ``data``
    ends: np.ndarray  #: byte behind each word
    offsets: np.ndarray  #: words of text i are offsets[i] … offsets[i + 1]
    data: np.ndarray  #: bytes of all texts

    def hashes(self, lane: int = 0) -> np.ndarray:
        it = LANES[lane]
        return _runs(it.letters[self.data], self.starts, self.ends, it.byte_base, small=True)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def string(self, text: int, keep: np.ndarray) -> bytes:
        """Kept words of one text, joined by one space."""
        a, b = self.offsets[text], self.offsets[text + 1]
        data = self.data.tobytes() if len(self.offsets) == 2 else None
        starts, ends = self.starts[a:b][keep], self.ends[a:b][keep]
        if data is None:
            data = self.data[starts[0] : ends[-1]].tobytes() if len(starts) else b""
            shift = starts[0] if len(starts) else 0
            starts, ends = starts - shift, ends - shift
        return b" ".join([data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` text bytes."""
    sizes = np.asarray(texts.cast(pa.large_binary()).is_valid()) * np.diff(_bounds(texts)[0])
    total, first = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def _bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    array = texts.fill_null("").cast(pa.large_binary())
    _, ends, data = array.buffers()
    bounds = np.frombuffer(ends, np.int64)[array.offset : array.offset + len(array) + 1]
    if not len(bounds):
        bounds = np.zeros(1, np.int64)
    return bounds, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def words(texts: pa.Array) -> Words:
    """Words of all texts of an array; null is a text without words."""
    bounds, data = _bounds(texts)
    return words_between(data[bounds[0] : bounds[-1]], bounds - bounds[0], _SPACE)


def words_between(data: np.ndarray, bounds: np.ndarray, cuts: np.ndarray) -> Words:
    """Runs of bytes that are not ``cuts`` (a flag per byte value), in texts data[bounds[i]:bounds[i + 1]]."""
    inside = ~cuts[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, bounds), data)


def coded(words: Words, cuts: np.ndarray = _SPACE) -> pa.DictionaryArray:
    """The words themselves as bytes, each distinct one once; ``cuts`` are those they were found by."""
    offsets = np.zeros(len(words.starts) + 1, np.int64)
    np.cumsum(words.ends - words.starts, out=offsets[1:])
    letters = words.data[~cuts[words.data]]
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.starts), buffers).dictionary_encode()


def expanded(codes: np.ndarray, values: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers (of ``kind``) of the words with the given codes one after the other, and where each word's end."""
    size = np.dtype(kind).itemsize
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // size
    flat = np.frombuffer(b"".join(values), kind)
    begins = np.cumsum(sizes) - sizes
    counts = sizes[codes]
    behind = np.cumsum(counts)
    at = np.repeat(begins[codes] - behind + counts, counts) + np.arange(behind[-1] if len(behind) else 0)
    return flat[at], behind


def windows(hashes: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` words; entry i starts at word i."""
    n = max(0, len(hashes) - size + 1)
    at = np.arange(n)
    return _runs(hashes, at, at + size, LANES[lane].word_base) if n else np.zeros(0, np.uint64)


def spread(counts: np.ndarray) -> np.ndarray:
    """Text number of each word."""
    return np.repeat(np.arange(len(counts)), counts)


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())


def pick(values: pa.Array, at: np.ndarray) -> pa.Array:
    """Values at the given rows."""
    return values.take(pa.array(at, pa.int64()))


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows of each run of equal values in the first ``keys`` columns (longs) of sorted batches."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not rows.num_rows:
            continue
        values = [np.asarray(rows.column(i)) for i in range(keys)]
        new = np.zeros(rows.num_rows - 1, bool)
        for x in values:
            new |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield rows.slice(a, b - a)
        rest = rows.slice(cuts[-1])
    if rest is not None:
        yield rest
