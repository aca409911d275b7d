"""Lloyd's clustering of integer vectors with heap-ordered bounds.

A vector that was compared with all centroids knows its gap: how much farther its second centroid is than its
own.  While centroids move, the gap shrinks by no more than its cluster's drift, the way of its own centroid plus the
longest way of any other.  Each cluster therefore keeps its vectors in the order of ``key`` = gap + drift summed up so
far, and a round pops those whose key the summed drift has reached: they alone are compared with all centroids again,
exactly.  All others provably keep their centroid.

The heaps are sorted runs in the shared folder.  Round r writes what it popped, with new keys, as run r, sorted by
(cluster, key); popping is a range predicate that Parquet's statistics answer, and a row of an older run is alive as long
as its key is above the drift its cluster had when the last round ended.  So a run is never rewritten, a
round reads only what expires, and a lost executor repeats a task.  Sums of members are corrected by the popped vectors
that changed their cluster, in exact integers.

Rows whose vector is null, has another number of components, or holds a null or non-finite one, are left out;
rows with a null ``vec_id`` are clustered, but start no centroid.  Rows that share a ``vec_id`` are vectors of their own; of
them the smaller vector starts a centroid first.  With fewer than ``k`` vectors there are as many centroids.  Other columns are
not read.  A vector whose squared distances do not fit in 64 bits ends the job with an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.session import stored

#: Share and floor by which a bound is widened, far above what rounding of square roots can cost.
SLACK = 1e-9


def integer_components(scale: int) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))


def is_finite() -> Column:
    """No component is null, NaN or infinite; null for a null vector."""
    return ~F.exists(
        F.col("embedding").cast("array<double>"),
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )


def checked(x: np.ndarray, terms: int) -> np.ndarray:
    """``x``, if ``terms`` products of two of its numbers stay in 64 bits."""
    largest = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    if terms * largest**2 >= 1 << 63:
        raise ValueError(f"components up to {largest} do not fit: their products pass 64 bits")
    return x


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to each centroid."""
    both = checked(np.concatenate([x, centroids]), 4 * centroids.shape[1])
    if 4 * both.shape[1] * int(np.abs(both).max(initial=0)) ** 2 < 1 << 53:  # all terms are exact as doubles
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def _matrix(parts: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(parts.to_pylist()), np.int32).reshape(-1, dim).astype(np.int64)


def _fresh_run(centroids: np.ndarray, totals: np.ndarray, dim: int):
    """Vectors compared with all centroids: their cluster, and the drift at which that must be done again."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1 << 14):
                rows = batch.slice(first, 1 << 14)
                found = squares(_matrix(rows.column(1), dim), centroids)
                at = np.arange(len(found))
                own = found.argmin(1)  # the first of equals
                least = found[at, own].astype(np.float64)
                found[at, own] = np.iinfo(np.int64).max
                upper, lower = np.sqrt(least), np.sqrt(found.min(1).astype(np.float64))
                key = lower - upper - SLACK * (lower + upper + 1) + totals[own]
                if found.shape[1] == 1:
                    key[:] = np.inf
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:2], pa.array(own, pa.int32()), pa.array(key), rows.column(2)],
                    names=["vec_id", "parts", "cluster", "key", "before"],
                )

    return assign


def _changes(dim: int):
    """Per task, one row a cluster: members and component sums that it gained since the run before."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, to, of = _matrix(batch.column(0), dim), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            moved = to != of
            x = np.concatenate([np.ones((len(x), 1), np.int64), x], 1)[moved]
            for sign, side in ((1, to[moved]), (-1, of[moved])):
                for c in np.unique(side[side >= 0]).tolist():
                    sums[c] = sums.get(c, 0) + sign * x[side == c].sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))],
            names=["cluster", "sums"],
        )

    return add


def _distances(centroids: np.ndarray, dim: int):
    """Squared distance of each vector to its own centroid."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _matrix(batch.column(1), dim), np.asarray(batch.column(2))
            checked(np.concatenate([x, centroids]), 4 * dim)
            found = ((x - centroids[own]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found)], names=["vec_id", "cluster", "distance"]
            )

    return measure


def _seeds(rows: DataFrame, k: int) -> np.ndarray:
    """Vectors with the smallest SHA-256 of ``1:<vec_id>``, in that order; at most ``k`` rows come to the driver."""
    first = (
        rows.where("vec_id is not null")
        .select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "whole")
        .orderBy("h", "whole")
        .limit(k)
        .collect()
    )
    return np.array([r.whole for r in first], np.int64)


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each kept vector.

    ``rounds`` times all vectors go to the nearest centroid and each non-empty centroid becomes the floor of its
    vectors' mean; then vectors are assigned once more.  Ties go to the smaller centroid number.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    kept = vectors.where((F.size("embedding") == dim) & is_finite()).select(
        "vec_id", integer_components(scale).alias("whole")
    )
    centroids = _seeds(kept, k)
    names = f"vec_id {kind}, cluster int, distance bigint"
    if not len(centroids):
        rest = "cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], f"{names}, {rest}")
    k = len(centroids)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            x = checked(np.asarray(lists.flatten()), 4 * dim).astype(np.int32).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(np.full(len(x), -1, np.int32))],
                names=["vec_id", "parts", "before"],
            )

    run_schema = f"vec_id {kind}, parts binary, cluster int, key double, before int"

    def new_run(rows: DataFrame) -> DataFrame:
        return stored(
            rows.mapInArrow(_fresh_run(centroids, totals.copy(), dim), run_schema).sortWithinPartitions("cluster", "key")
        )

    def within(limits: np.ndarray) -> Column:
        """The cluster's drift has reached the key."""
        return reduce(
            lambda a, b: a | b, [(F.col("cluster") == c) & (F.col("key") <= float(t)) for c, t in enumerate(limits)]
        )

    def alive(run: int, after: int) -> DataFrame:
        rows = runs[run]
        return rows.where(~within(ends[after])) if after > run else rows

    totals = np.zeros(k)
    runs = [new_run(kept.mapInArrow(packed, f"vec_id {kind}, parts binary, before int"))]
    ends = [totals.copy()]
    sums = [[0] * (dim + 1) for _ in range(k)]
    for number in range(1, rounds + 1):
        changes = (
            runs[-1].select("parts", "cluster", "before").mapInArrow(_changes(dim), "cluster int, sums array<bigint>")
            .select("cluster", F.posexplode("sums").alias("at", "x"))
            .groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        )
        for r in changes.collect():  # k * (dim + 1) rows
            sums[r.cluster][r.at] += int(r.x)
        moved = np.array([[x // n for x in s] if n else list(c) for (n, *s), c in zip(sums, centroids.tolist(), strict=True)])
        ways = [math.dist(a, b) * (1 + SLACK) for a, b in zip(moved.tolist(), centroids.tolist(), strict=True)]
        centroids = moved
        totals = totals + np.array([w + max([0.0, *ways[:c], *ways[c + 1 :]]) for c, w in enumerate(ways)])
        expired = [
            alive(run, number - 1).where(within(totals)).select("vec_id", "parts", F.col("cluster").alias("before"))
            for run in range(number)
        ]
        runs.append(new_run(reduce(DataFrame.unionByName, expired)))
        ends.append(totals.copy())

    live = reduce(DataFrame.unionByName, [alive(run, rounds) for run in range(rounds + 1)])
    found = stored(live.select("vec_id", "parts", "cluster").mapInArrow(_distances(centroids, dim), names))
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    clusters = vectors.sparkSession.createDataFrame(
        [(c, s, sum(inertia.values()), digests[c]) for c, s in sorted(inertia.items())],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    return found.join(F.broadcast(clusters), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
