"""Exact top-k search by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it.  The distances of a pivot are cut into annuli, and the
vectors of an annulus into chunks.  For a query q and a vector x of an annulus [low, high] of pivot p, the triangle
inequality gives |q - x| >= max(0, low - |q - p|, |q - p| - high), and 2 q·x = |q|² + |x|² - |q - x|², so the annulus has an
upper bound of the score; |q| |x| is another.  A block of queries visits the annuli in the order of that bound,
first few, then four times as many in each round.  What has a bound under the query's k-th score so far is never
read, and a query is done when that holds for all annuli that are left.  Bounds are kept on the safe side of
rounding, and an annulus that could only tie is visited too, because ties go to the smaller ``vec_id``.

The directory (at most ``PIVOTS`` x ``ANNULI`` rows of five numbers) and the pivots are all that every task gets.  Queries
and vectors meet in joins of blocks with chunks.  Equal vectors are one row of the index that keeps the ``vec_id`` that
can be among k results: a vector that a third of all rows hold is compared once.

Rows whose vector is null or holds a null or non-finite component take no part; vectors of different lengths are not compared.
A row's own are all rows with its ``vec_id``.  Every query row gets its results, also if it is repeated; a null
``vec_id`` comes last among equals.  A vector whose products do not fit in 64 bits ends the job with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palisade.llm.centroids import checked, integer_components, is_finite
from palisade.session import stored

#: Bounds of the directory, and the vectors that pivots are drawn from (by hash, the same ones in every run).
PIVOTS, ANNULI, SAMPLE = 64, 64, 1024
#: Vectors of a chunk and queries of a block, on average.
CHUNK, BLOCK = 512, 128
#: Vectors that a query may visit in the first round; each later round allows ``GROWTH`` times as many.
FIRST_VISIT, GROWTH = 4096, 4
#: Share by which a bound is raised above what doubles compute.
SLACK = 1e-9

NO_ID = np.iinfo(np.int64).max


def _by_length(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each vector length, and their vectors as a matrix."""
    sizes = np.asarray(lists.value_lengths())
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        own = lists if len(rows) == len(lists) else lists.take(pa.array(rows))
        yield rows, checked(np.asarray(own.flatten()).reshape(len(rows), size), max(1, 4 * size))


def _distances(x: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    """Distance of each row to each pivot; the shorter of two counts as filled up with zeros."""
    out = np.empty((len(x), len(pivots)))
    for i, p in enumerate(pivots):
        n = min(len(p), x.shape[1])
        out[:, i] = np.sqrt(((x[:, :n] - p[:n]).astype(np.float64) ** 2).sum(1) + (x[:, n:].astype(np.float64) ** 2).sum(1) + float((p[n:].astype(np.float64) ** 2).sum()))
    return out


def choose_pivots(sample: list[np.ndarray], most: int) -> list[np.ndarray]:
    """Farthest-first: each pivot is the vector of the sample that lies farthest from those before."""
    if not sample:
        return []
    width = max(map(len, sample))
    x = np.stack([np.pad(v, (0, width - len(v))) for v in sample])
    chosen, away = [0], _distances(x, [x[0]])[:, 0]
    while len(chosen) < most and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _distances(x, [x[chosen[-1]]])[:, 0])
    return [sample[i] for i in chosen]


def _keyed(pivots: list[np.ndarray], vector: int):
    """Adds nearest pivot, distance and squared norm; ``vector`` is the place of the vector among the columns."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            pivot, distance, norm = np.zeros(n, np.int32), np.zeros(n), np.zeros(n)
            for rows, x in _by_length(batch.column(vector)):
                found = _distances(x, pivots)
                pivot[rows] = found.argmin(1)
                distance[rows] = found.min(1)
                norm[rows] = (x.astype(np.float64) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pivot), pa.array(distance), pa.array(norm)],
                names=[*batch.schema.names, "pivot", "distance", "norm"],
            )

    return key


def _visits(pivots: list[np.ndarray], directory: np.ndarray, allowed: int):
    """Chunks that each block visits next.  ``directory`` has, per cell, its pivot, lowest and highest distance, largest
    squared norm, vectors and chunks; ``done`` is how many cells of its order a block has behind it."""
    at, low, high, norms, sizes, parts = directory.T
    at, parts = at.astype(np.int64), parts.astype(np.int64)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, vectors, least = batch.column(2)[i].values.flatten()[1:4]
                done = batch.column(1)[i].as_py()
                bounds = np.empty((len(vectors), len(at)))
                for rows, x in _by_length(vectors):
                    away = _distances(x, pivots)[:, at]
                    own = (x.astype(np.float64) ** 2).sum(1)[:, None]
                    gap = np.maximum(0, np.maximum(low - away, away - high) * (1 - SLACK) - SLACK * (away + high))
                    bounds[rows] = np.minimum((own + norms - gap**2) / 2, np.sqrt(own * norms)) + SLACK * (own + norms) + 1e-6
                order = np.lexsort((np.arange(len(at)), -bounds.max(0)))[done:]
                floor = np.asarray(least.cast(pa.float64()).fill_null(-np.inf))
                needed = np.flatnonzero((bounds[:, order] >= floor[:, None]).any(0))
                if not len(needed):
                    continue
                within = np.searchsorted(np.cumsum(sizes[order][needed]), allowed) + 1
                cells = order[needed[:within]]
                after = done + (int(needed[within - 1]) + 1 if within <= len(needed) else len(order))
                chunk = np.concatenate([np.arange(parts[c]) for c in cells])
                cell = np.repeat(cells, parts[cells])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(cell), pa.int64()), pa.array([after] * len(cell), pa.int32()),
                     pa.array(cell, pa.int32()), pa.array(chunk, pa.int32())],
                    names=["block", "after", "cell", "chunk"],
                )

    return choose


def _scored(k: int):
    """For each block and chunk that meet: candidates that can be among the block's results."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, query, vectors, least = batch.column(1)[i].values.flatten()[:4]
                copies, others = batch.column(2)[i].values.flatten()[:2]
                floor = np.asarray(least.fill_null(np.iinfo(np.int64).min))
                row, query = np.asarray(row), np.asarray(query.fill_null(NO_ID))
                starts = np.concatenate([[0], np.cumsum(np.asarray(copies.value_lengths()))])
                ids = copies.flatten()
                ids, known = np.asarray(ids.fill_null(NO_ID)), np.asarray(ids.is_valid())
                theirs = dict((x.shape[1], (rows, x)) for rows, x in _by_length(others))
                for rows, q in _by_length(vectors):
                    if q.shape[1] not in theirs:
                        continue
                    cols, x = theirs[q.shape[1]]
                    if q.shape[1] * int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) < 1 << 53:
                        found = (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)  # exact
                    else:
                        found = q @ x.T
                    most = min(k + 1, found.shape[1])  # one may be the query's own
                    lowest = np.maximum(np.partition(found, -most, axis=1)[:, -most], floor[rows])
                    a, b = np.nonzero(found >= lowest[:, None])
                    scores, a, b = found[a, b], rows[a], cols[b]
                    n = starts[b + 1] - starts[b]
                    place = np.repeat(starts[b] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    a, scores = np.repeat(a, n), np.repeat(scores, n)
                    other = ~known[place] | (ids[place] != query[a])
                    a, scores, place = a[other], scores[other], place[other]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(a), batch.column(0)[i].as_py()), pa.int64()), pa.array(row[a]), pa.array(query[a]),
                         pa.array(scores), pa.array(ids[place], mask=~known[place])],
                        names=["block", "row", "query_id", "score", "vec_id"],
                    )

    return score


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` holds, the ``k`` other rows with the highest inner
    product of floor(scale * x); all, if there are fewer."""
    spark = vectors.sparkSession
    table = stored(
        vectors.where(is_finite()).select(
            F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"),
            integer_components(scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"),
        )
    )
    # Equal vectors, with the k + 1 smallest vec_id of each and up to k rows of one vec_id.
    rank = F.row_number().over(W.partitionBy("v").orderBy(F.asc_nulls_last("vec_id")))
    distinct = (
        table.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
        .withColumn("rank", rank).where(F.col("rank") <= k + 1)
        .groupBy("v").agg(F.flatten(F.collect_list(F.array_repeat("vec_id", F.col("n")))).alias("copies"))
    )
    distinct = stored(distinct.select("copies", "v", F.xxhash64("v").alias("spread")))
    n = distinct.count()
    cells = max(1, min(PIVOTS * ANNULI, n // CHUNK))
    most = max(1, min(PIVOTS, round(cells**0.5)))
    annuli = max(1, min(ANNULI, cells // most))
    sample = distinct.orderBy("spread", "v").limit(SAMPLE).select("v").collect()
    pivots = choose_pivots([np.array(r.v, np.int64) for r in sample], most)
    result = "query_id bigint, rank bigint, vec_id bigint, score bigint"
    if not pivots:
        return spark.createDataFrame([], result)

    key = ", pivot int, distance double, norm double"
    index = stored(distinct.mapInArrow(_keyed(pivots, 1), "copies array<bigint>, v array<bigint>, spread bigint" + key))
    cuts = index.groupBy("pivot").agg(
        F.array_distinct(F.percentile_approx("distance", [i / annuli for i in range(1, annuli)] or [1.0], 10_000)).alias("cuts")
    )
    cuts = spark.createDataFrame(cuts.collect(), cuts.schema)  # a row a pivot
    index = index.join(F.broadcast(cuts), "pivot").withColumn(
        "annulus", F.size(F.filter("cuts", lambda c: c < F.col("distance")))
    ).drop("cuts")
    found = (
        index.groupBy("pivot", "annulus")
        .agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.max("norm").alias("norm"), F.count("*").alias("n"))
        .orderBy("pivot", "annulus").collect()  # PIVOTS * (ANNULI + 1) rows at most
    )
    directory = np.array([(r.pivot, r.low, r.high, r.norm, r.n, -(-r.n // CHUNK)) for r in found])
    cell_of = spark.createDataFrame(
        [(r.pivot, r.annulus, i, -(-r.n // CHUNK)) for i, r in enumerate(found)], "pivot int, annulus int, cell int, parts int"
    )
    chunks = stored(
        index.join(F.broadcast(cell_of), ["pivot", "annulus"])
        .groupBy("cell", F.pmod("spread", "parts").cast("int").alias("chunk"))
        .agg(F.collect_list(F.struct("copies", "v")).alias("vectors"))
    )
    # Blocks of queries that are near the same pivot.
    asked = stored(table.where("asks").select("row", "vec_id", "v").mapInArrow(
        _keyed(pivots, 2), "row bigint, vec_id bigint, v array<bigint>" + key
    ))
    sizes = {r.pivot: r["count"] for r in asked.groupBy("pivot").count().collect()}
    parts = F.element_at(F.create_map(*[F.lit(int(x)) for p, s in sizes.items() for x in (p, -(-s // BLOCK))] or [F.lit(0), F.lit(1)]), F.col("pivot"))
    block = F.shiftleft(F.col("pivot").cast("bigint"), 40) + F.pmod(F.xxhash64("row"), parts)
    asked = stored(asked.select(block.alias("block"), "row", "vec_id", "v"))

    best = spark.createDataFrame([], "block bigint, row bigint, query_id bigint, score bigint, vec_id bigint")
    done = None
    allowed = FIRST_VISIT
    order = W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    while True:
        limits = best.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        blocks = stored(
            asked.join(limits, "row", "left").groupBy("block")
            .agg(F.collect_list(F.struct("row", "vec_id", "v", "least")).alias("queries"))
        )
        start = blocks.withColumn("done", F.lit(0)) if done is None else blocks.join(done, "block")
        visits = stored(
            start.select("block", "done", "queries")
            .mapInArrow(_visits(pivots, directory, allowed), "block bigint, after int, cell int, chunk int")
        )
        if visits.isEmpty():
            break
        met = visits.join(blocks, "block").join(chunks, ["cell", "chunk"]).select("block", "queries", "vectors")
        new = met.mapInArrow(_scored(k), "block bigint, row bigint, query_id bigint, score bigint, vec_id bigint")
        best = stored(
            best.unionByName(new).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
        )
        done = visits.groupBy("block").agg(F.max("after").alias("done"))  # others have nothing left to visit
        allowed *= GROWTH
    return best.select("query_id", F.row_number().over(order).cast("bigint").alias("rank"), "vec_id", "score")
