"""Near-duplicate classes by DartMinHash signatures (Christiani, 2020).

A text is a weighted set of word shingles.  Darts are hashed into each element's region, its weight
times a range of ranks; the darts of an element are the same in every set, a larger weight only
uncovers more of them.  Every dart names one coordinate of the signature, and the earliest dart per
coordinate stays, so two signatures agree in a coordinate with the probability of their weighted
Jaccard similarity.  About K·ln K darts are thrown per set, however many elements it has.

Signatures are joined in bands.  A shared band only proposes; exact similarity of the shingle sets
decides.  Equal sets are folded first.  Buckets are never paired out.  First each set is tested with the
leader it shares most buckets with.  Pairs inside one class need no test, and every pair of two classes
has a set outside its bucket's main class, the largest one.  So from then on only those outsiders look for
partners: in a few rounds among delegates, a bounded number per bucket, drawn anew each round; at last
among all members of their buckets, in blocks, the only round that compares two sides in full.  For that round the
shingles that no other undecided set holds are counted: two sets share no more than the smaller number of the
rest, and a set with too few of these has no partner at all, so near copies that are just too far apart drop out singly.
Pairs are then held against bitmaps in which each shingle flips a bit: two bitmaps differ in no more bits than the sets
differ in shingles, so this leaves out no pair that is similar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm import text as tx
from palisade.llm.components import components, merged
from palisade.session import stored

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: 27 bands of 6: a pair at 0.8 shares no band with probability 3e-4, at 0.85 with 3e-6.
BANDS, ROWS = 27, 6
#: Pairs whose signatures agree this many standard deviations below the threshold are not read in full.
DEVIATIONS = 5
#: Delegates of a bucket's main class, and of its outsiders, and the rounds in which outsiders meet them.
DELEGATES, ROUNDS = 4, 2
#: Members of a bucket that are compared at once in the last round, and pairs whose signatures are compared at once.
BLOCK, PAIRS = 1024, 1 << 16
#: Shingles that are handed to Spark at once, and what rounding may take from a bound.
SPELLED, ROUNDING = 1 << 18, 1e-6
#: Bits of the bitmap of a set.
BITS = 4096

_STEP, _LAYER, _COORDINATE, _HEIGHT = (
    np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
)


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] by hash."""
    return ((tx.mix(x) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53


def signatures(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, sets: int, size: int) -> np.ndarray:
    """``sets`` signatures of ``size`` 64-bit values.

    ``owner, elements, weights`` are the members of all sets: set number, 64-bit hash, weight over 0.
    A set without members has a signature of ones only.  Layer 0 of an element is the weight range
    [0, 1), layer m the range [2**(m - 1), 2**m); arrivals along the rank axis are a Poisson process.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(sets * size, empty)
    if not len(owner):
        return out.reshape(sets, size)
    total = np.bincount(owner, weights, sets)
    layers = np.where(weights <= 1, 0, np.ceil(np.log2(np.maximum(weights, 1)))).astype(np.int64) + 1
    at = np.repeat(np.arange(len(owner)), layers)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(layers) - layers, layers)
    low = np.where(layer == 0, 0.0, 2.0 ** (layer - 1))
    extent = np.where(layer == 0, 1.0, low)
    seed = tx.mix(elements[at] + layer.astype(np.uint64) * _LAYER)
    owner, weight = owner[at], weights[at]
    clock, thrown = np.zeros(len(at)), np.zeros(len(at), np.int64)
    limit = np.zeros(sets)
    filled = total > 0
    limit[filled] = size * (math.log(size) + 3) / total[filled]
    due = np.arange(len(at))
    while len(due):
        # Elements that expect many darts get them in large blocks, the others in small ones.
        many = limit[owner[due]] * extent[due] > 8
        for live, block in ((due[~many], 4), (due[many], 64)):
            clock, thrown = np.zeros(len(live)), 0
            while len(live):
                number = np.arange(thrown, thrown + block, dtype=np.uint64)
                base = seed[live][:, None] + number * _STEP
                gaps = -np.log(_unit(base)) / extent[live][:, None]
                # Sums run on from the clock, so arrivals are the same for any block size.
                arrival = np.add.accumulate(np.concatenate([clock[:, None], gaps], 1), 1)[:, 1:]
                early = arrival <= limit[owner[live]][:, None]
                height = low[live][:, None] + extent[live][:, None] * _unit(base + _HEIGHT)
                hit = early & (height <= weight[live][:, None])
                dart = tx.mix(base[hit] + _COORDINATE)
                slot = owner[live][np.nonzero(hit)[0]] * size + (dart % np.uint64(size)).astype(np.int64)
                rank = arrival[hit].view(np.uint64) & ~np.uint64((1 << 24) - 1)
                np.minimum.at(out, slot, rank | dart >> np.uint64(40))
                whole = early[:, -1]
                live, clock, thrown = live[whole], arrival[whole, -1], thrown + block
        # A coordinate without a dart: the set's elements are thrown again, up to twice the rank.
        bare = (out.reshape(sets, size) == empty).any(1) & filled
        limit = np.where(bare, limit * 2, limit)
        due = np.flatnonzero(bare[owner])
    return out.reshape(sets, size)


def shingles(words: tx.Words, weighted: bool, lane: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of each text's distinct shingles; a text of one to four words is one shingle."""
    counts = words.counts()
    hashes = words.hashes(lane)
    grams = tx.windows(hashes, SHINGLE_WORDS, lane)
    owner = tx.spread(counts)
    left = np.repeat(words.offsets[1:], counts) - np.arange(len(owner))
    at = np.flatnonzero(left >= SHINGLE_WORDS)
    owner, found = owner[at], grams[at]
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS)):
        short = hashes[words.offsets[i] : words.offsets[i + 1]]
        owner, found = np.append(owner, i), np.append(found, tx.windows(short, len(short), lane))
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(owner)))
    return owner[first], found[first], times.astype(np.float64) if weighted else np.ones(len(first))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in tx.chunks(tx.string_column(batch, "text"), tx.CHUNK_BYTES // 2):
            yield batch.slice(a, b - a)


def _blobs(owner: np.ndarray, values: np.ndarray, rows: int) -> list[bytes]:
    bounds = np.searchsorted(owner, np.arange(rows + 1)) * values.itemsize
    data = values.tobytes()
    return [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _table(blobs: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), np.uint8).reshape(len(blobs), width)


def _multiset(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Element i of weight n as n elements, so that weighted similarity is that of plain sets."""
    times = weights.astype(np.int64)
    copy = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return tx.mix(np.repeat(hashes, times) + copy.astype(np.uint64) * _STEP)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """``doc_id, class_id, n_shingles`` for each row of ``docs (doc_id, text)``.

    Documents whose sets of five-word shingles have a Jaccard similarity of ``similarity`` or more are
    linked; a class is what links reach, named by its smallest ``doc_id``.  ``weighted`` counts
    repeated shingles, by sums of smaller over sums of larger counts.

    A text of one to four words is one shingle.  Null texts and texts without words are alone in
    their class.  Rows that share a ``doc_id`` share its class.  A null ``doc_id`` has a null class.
    """
    size = BANDS * ROWS
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    wide = size + 8 * BANDS
    slack = similarity - DEVIATIONS * math.sqrt(similarity * (1 - similarity) / size)

    def sign(batches):
        for batch in _slices(batches):
            rows = batch.num_rows
            words = tx.words(tx.string_column(batch, "text"))
            owner, found, weights = shingles(words, weighted)
            signed = signatures(owner, found, weights, rows, size)
            digests = []
            for lane in (0, 1):
                _, other, times = shingles(words, weighted, lane)
                total = np.zeros(rows, np.uint64)
                np.add.at(total, owner, tx.mix(other + times.astype(np.uint64) * _STEP))
                digests.append(total.view(np.int64))
            sizes = np.bincount(owner, weights, rows).astype(np.int64)
            bands = np.zeros((rows, BANDS), np.uint64)
            for i in range(ROWS):
                bands = tx.mix(bands + signed.reshape(rows, BANDS, ROWS)[:, :, i] + _STEP)
            bands = tx.mix(bands + np.arange(BANDS, dtype=np.uint64) * _LAYER).view(np.int64)
            marks = (tx.mix(signed) & np.uint64(255)).astype(np.uint8)
            some = sizes > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(digests[0], mask=~some),
                    pa.array(digests[1], mask=~some),
                    pa.array(sizes),
                    pa.array(list(bands), pa.list_(pa.int64())),
                    # Per coordinate a byte, then the bands' hashes.
                    pa.array([x.tobytes() + y.tobytes() for x, y in zip(marks, bands, strict=True)], pa.binary()),
                ],
                names=["doc_id", "digest", "digest_2", "n_shingles", "bands", "marks"],
            )

    def sets_of(batches):
        for batch in _slices(batches):
            rows = batch.num_rows
            owner, found, weights = shingles(tx.words(tx.string_column(batch, "text")), weighted)
            if weighted:
                owner, found = np.repeat(owner, weights.astype(np.int64)), _multiset(found, weights)
                order = np.lexsort((found, owner))
                owner, found = owner[order], found[order]
            total = pa.array(np.bincount(owner, minlength=rows).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), total, pa.array(_blobs(owner, found, rows), pa.binary())],
                names=["doc_id", "total", "members"],
            )

    def promising(batches):
        for batch in batches:
            part = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            low, high = (np.asarray(part[c]) for c in ("n_a", "n_b"))
            near = np.minimum(low, high) >= similarity * np.maximum(low, high)
            left, right = (_table(part[c], wide)[:, :size] for c in ("marks_a", "marks_b"))
            agree = (left == right).sum(1)
            at = np.flatnonzero(near & (agree >= slack * size))
            names = ("a", "b", "class_b")
            yield pa.RecordBatch.from_arrays(
                [*(tx.pick(part[c], at) for c in names), pa.array(agree[at])], names=[*names, "agree"]
            )

    def crossing(_: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Promising pairs of an outsider of one block and a member of another class in one block of a bucket.  A
        pair is named in the first band that it shares; there its classes are apart as well."""
        part = {name: rows.column(name).combine_chunks() for name in rows.column_names}
        bucket, n, common = part["bucket"][0].as_py(), np.asarray(part["n"]), np.asarray(part["common"])
        of = np.asarray(part["class"].dictionary_encode().indices)
        bits = _table(part["bits"], BITS // 8).view(np.uint64)
        table = _table(part["marks"], wide)
        marks, shared = table[:, :size], np.ascontiguousarray(table[:, size:]).view(np.int64)
        seeks = np.asarray(part["seeks"].to_numpy(zero_copy_only=False), bool)
        left, right = np.flatnonzero(seeks), np.flatnonzero(~seeks)
        found = []
        for i in left:
            near = right[(of[right] != of[i]) & (np.minimum(n[right], n[i]) >= similarity * np.maximum(n[right], n[i]))]
            most = np.minimum(common[near], common[i])
            near = near[most * (1 + similarity) >= similarity * (n[near] + n[i]) - ROUNDING]
            for k in range(0, len(near), PAIRS):
                b = near[k : k + PAIRS]
                b = b[(marks[b] == marks[i]).sum(1) >= slack * size]
                apart = np.bitwise_count(bits[b] ^ bits[i]).sum(1)
                b = b[apart * (1 + similarity) <= (1 - similarity) * (n[b] + n[i]) + ROUNDING]
                first = (shared[b] == shared[i]).argmax(1)
                b = b[shared[b, first] == bucket]
                found.append((np.full(len(b), i), b))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": tx.pick(part["doc_id"], a), "b": tx.pick(part["doc_id"], b)})

    def elements(batches):
        """Names, owners and shingles of some sets at once."""
        for batch in batches:
            behind = np.cumsum(np.asarray(batch.column(1)))
            cuts = np.unique(np.searchsorted(behind, np.arange(0, behind[-1], SPELLED))) if batch.num_rows else []
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                owner = np.repeat(np.arange(part.num_rows), np.asarray(part.column(1)))
                yield part.column(0), owner, np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint64)

    def spelled(batches):
        for ids, owner, found in elements(batches):
            yield pa.RecordBatch.from_arrays([tx.pick(ids, owner), pa.array(found.view(np.int64))], names=["set", "shingle"])

    def flipped(batches):
        for ids, owner, found in elements(batches):
            for a in range(0, len(ids), 1024):
                mine = slice(*np.searchsorted(owner, (a, a + 1024)))
                place = (owner[mine] - a) * BITS + (tx.mix(found[mine]) % np.uint64(BITS)).astype(np.int64)
                rows = min(1024, len(ids) - a)
                bits = np.packbits(np.bincount(place, minlength=rows * BITS).astype(np.uint8).reshape(rows, BITS) & 1, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, rows), pa.array([x.tobytes() for x in bits], pa.binary())], names=["set", "bits"]
                )

    def exact(batches):
        for batch in batches:
            part = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            keep = []
            for x, y in zip(part["left"], part["right"], strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([tx.pick(part[c], at) for c in ("a", "b")], names=["a", "b"])

    signed = stored(docs.mapInArrow(sign, f"doc_id {kind}, digest long, digest_2 long, n_shingles long, bands array<long>, marks binary"))
    key = ["digest", "digest_2"]
    named = signed.where("doc_id is not null and digest is not null")
    distinct = stored(
        named.groupBy(*key).agg(F.min(F.struct("doc_id", "n_shingles", "bands", "marks")).alias("it")).select(*key, "it.*")
    )
    # Buckets are counted and joined with ids alone; what is wider follows for those that are still apart.
    placed = distinct.select("doc_id", F.explode("bands").alias("bucket"))
    full = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("doc_id").alias("leader")).where("size > 1")
    member = stored(placed.join(stored(full.select("bucket", "leader")), "bucket"))
    marks = distinct.select("doc_id", F.col("n_shingles").alias("n"), "marks")
    ids = stored(member.select("doc_id").distinct())
    sets = stored(docs.join(ids, "doc_id").mapInArrow(sets_of, f"doc_id {kind}, total long, members binary"))

    def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
        """``a, b, class_b, agree``: promising pairs of different classes that share a bucket."""
        one, two = (
            t.select("bucket", *(F.col(c).alias(f"{c}_{side}") for c in t.columns if c != "bucket"))
            for t, side in ((left, "a"), (right, "b"))
        )
        pairs = one.join(two, "bucket").where("class_a != class_b")
        return pairs.select(
            F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"), "class_b", "n_a", "n_b", "marks_a", "marks_b"
        ).mapInArrow(promising, f"a {kind}, b {kind}, class_b {kind}, agree long")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs whose sets are similar."""
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("left")), "a").join(
            sets.select(F.col("doc_id").alias("b"), F.col("members").alias("right")), "b"
        )
        return stored(both.mapInArrow(exact, f"a {kind}, b {kind}"))

    def divided(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(members, outsiders) ``bucket, doc_id, class`` of buckets that hold several classes; outsiders are
        those of other classes than the bucket's largest."""
        now = member.join(labels, F.col("doc_id") == F.col("node"), "left").select(
            "bucket", "doc_id", F.coalesce("component", "doc_id").alias("class")
        )
        sizes = now.groupBy("bucket", "class").agg(F.count("*").alias("size"))
        mains = sizes.groupBy("bucket").agg(F.max(F.struct("size", "class")).alias("it"), F.count("*").alias("classes"))
        mains = mains.where("classes > 1").select("bucket", F.col("it.class").alias("main"))
        split = stored(now.join(stored(mains), "bucket"))
        return split.drop("main"), stored(split.where("class != main").drop("main"))

    led = member.where("doc_id != leader").groupBy("doc_id", "leader").agg(F.count("*").alias("shared"))
    chosen = led.groupBy(F.col("doc_id").alias("a")).agg(F.max(F.struct("shared", "leader")).alias("it"))
    labels = components(verified(chosen.select("a", F.col("it.leader").alias("b"))))
    for number in range(ROUNDS):
        split, outside = divided(labels)
        drawn = F.xxhash64("doc_id", F.lit(number))
        slots = split.join(outside.select("bucket", "doc_id", F.lit(True).alias("out")), ["bucket", "doc_id"], "left")
        chosen = slots.groupBy("bucket", "out", F.pmod(drawn, F.lit(DELEGATES)).alias("slot")).agg(
            F.min(F.struct(drawn.alias("rank"), "doc_id", "class")).alias("it")
        )
        delegates = stored(chosen.select("bucket", "it.doc_id", "it.class").join(marks, "doc_id"))
        pairs = candidates(stored(outside.join(marks, "doc_id")), delegates)
        best = pairs.groupBy("a", "class_b").agg(F.max(F.struct("agree", "b")).alias("it"))
        labels = merged(labels, verified(best.select("a", F.col("it.b").alias("b"))))

    # The last round: outsiders in blocks meet all members in blocks, whoever is of another class.
    split, outside = divided(labels)
    undecided = sets.join(split.select("doc_id").distinct(), "doc_id")
    undecided = stored(undecided.select(F.monotonically_increasing_id().alias("set"), "total", "members", "doc_id"))
    held = undecided.mapInArrow(spelled, "set long, shingle long")
    lone = held.groupBy("shingle").agg(F.count("*").alias("sets"), F.min("set").alias("set")).where("sets = 1")
    lone = lone.groupBy("set").agg(F.count("*").alias("lone"))
    bits = undecided.mapInArrow(flipped, "set long, bits binary")
    # Rows that share an id are several sets; each of their marks meets each of their bounds.
    bounds = undecided.select("set", "doc_id", "total").join(bits, "set").join(lone, "set", "left")
    bounds = bounds.select("doc_id", "bits", (F.col("total") - F.coalesce("lone", F.lit(0))).alias("common"))
    able = stored(marks.join(bounds, "doc_id").where(F.col("common") >= similarity * F.col("n") - ROUNDING))
    split, outside = (stored(t.join(able.select("doc_id").distinct(), "doc_id").select(*t.columns)) for t in (split, outside))
    blocks = F.ceil(F.count("*") / BLOCK)
    shape = stored(
        split.groupBy("bucket").agg(blocks.alias("right"))
        .join(outside.groupBy("bucket").agg(blocks.alias("left")), "bucket")
    )

    def dealt(table: DataFrame, mine: str, other: str, seeks: bool) -> DataFrame:
        """Rows of a side once for each block of the other side."""
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        placed = table.join(shape, "bucket").withColumn("own", F.pmod(F.xxhash64("doc_id"), mine)).withColumn("met", every)
        return placed.select(
            "bucket", F.col("own" if seeks else "met").alias("seeker"), F.col("met" if seeks else "own").alias("block"),
            "doc_id", "class", F.lit(seeks).alias("seeks"),
        )

    met = stored(dealt(outside, "left", "right", True).unionByName(dealt(split, "right", "left", False)))
    pairs = met.join(able, "doc_id").groupBy("bucket", "seeker", "block").applyInArrow(crossing, f"a {kind}, b {kind}")
    labels = merged(labels, verified(pairs))

    first = distinct.select(*key, F.col("doc_id").alias("first"))
    classes = first.join(labels, F.col("first") == F.col("node"), "left").select(
        *key, F.coalesce("component", "first").alias("class_id")
    )
    return (
        signed.select("doc_id", "n_shingles", *key)
        .join(stored(classes), key, "left")
        .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_shingles")
    )
