"""Pivot-distance search against brute force."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from palisade.llm import pivot_search as ps


def plain(rows, asks, k, scale):
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, v in kept:
        if q is None or q % asks:
            continue
        others = sorted(
            (-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for i, w in kept if i != q and len(w) == len(v)
        )[:k]
        out += [(q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(others, 1)]
    return sorted(map(str, out))


def found(spark, rows, asks=10, k=10, scale=1024):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    table = table.selectExpr("*", "'mine' as row", "1 as score", "2 as block", "3 as v").repartition(4)
    got = ps.top_k(table, F.col("vec_id") % asks == 0, k, scale)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(str(tuple(r)) for r in got.collect())


def clustered(seed, n, dim):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    return [(i, [m * rng.choice([1, 1, 3]) + rng.gauss(0, 0.05) for m in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    """Also with tiny chunks and first visits, so that several rounds and many annuli are needed."""
    if small:
        for name, value in {"CHUNK": 8, "BLOCK": 4, "FIRST_VISIT": 16, "PIVOTS": 6, "ANNULI": 5}.items():
            monkeypatch.setattr(ps, name, value)
    rows = clustered(1, 900, 12)
    assert found(spark, rows) == plain(rows, 10, 10, 1024)


def test_messy_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.5, -0.25, 1.0]) for i in range(0, 120)]  # a vector that many rows hold: ties by vec_id
    rows += [(200, [0.5, 0.5, 0.5])] * 13 + [(205, [0.5, 0.5, 0.5])] * 12  # repeated rows
    rows += [(210, [1.0, 2.0]), (211, [2.0, 1.0]), (220, []), (221, []), (230, [0.0, 0.0, 0.0]), (231, [-1.0, -1.0, -1.0])]
    rows += [(None, [9.0, 9.0, 9.0]), (None, [9.0, 9.0, 9.0]), (None, None), (240, None), (250, [nan, 1.0, 1.0]), (251, [inf, 0.0, 0.0]), (260, [None, 1.0, 1.0])]
    assert found(spark, rows) == plain(rows, 10, 10, 1024)
    assert found(spark, rows, k=3) == plain(rows, 10, 3, 1024)


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (7, [2.0, 2.0])]
    assert found(spark, rows) == plain(rows, 10, 10, 1024) == ["(0, 1, 7, 6291456)"]
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, None)]) == []
    assert found(spark, [(3, [1.0]), (4, [2.0])]) == []


def test_annuli_out_of_reach_are_not_visited(monkeypatch):
    """A block near one pivot leaves the annuli of a far one alone once it has results."""
    import pyarrow as pa

    pivots = [np.array([0, 0]), np.array([10_000, 0])]
    directory = np.array([(0, 0, 50, 2500, 600, 2), (0, 50, 90, 8100, 600, 2), (1, 0, 40, 1.1e8, 600, 2), (1, 40, 70, 1.2e8, 600, 2)], float)
    queries = [[{"row": 1, "vec_id": 1, "v": [10_000, 5], "least": 99_000_000}]]
    kind = pa.list_(pa.struct([("row", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("least", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([4]), pa.array([0], pa.int32()), pa.array(queries, kind)], names=["block", "done", "queries"])
    seen = pa.Table.from_batches(ps._visits(pivots, directory, 10_000)(iter([batch]))).to_pydict()
    assert set(seen["cell"]) == {2, 3} and set(seen["chunk"]) == {0, 1}


def test_large_products(spark):
    rows = [(0, [2.0**17] * 3), (1, [2.0**17 - 3, 5.0, -(2.0**16)]), (2, [1.0, 2.0**17, 3.0])]
    assert found(spark, rows) == plain(rows, 10, 10, 1024)
    with pytest.raises(Exception, match="do not fit"):
        found(spark, [(0, [1e30]), (1, [2.0])])
