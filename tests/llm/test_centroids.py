"""Heap-ordered clustering against plain rounds in exact integers."""

import hashlib
import math
import random

import pytest

from palisade.llm import centroids
from palisade.llm.centroids import cluster_vectors

DIM = 8


def plain(rows, k, rounds, scale):
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == DIM and all(x is not None and math.isfinite(x) for x in v)
    ]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    means = [v for _, v in seeds]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(means)), key=lambda c: (away(v, means[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for c in range(len(means)):
            if members := [v for (_, v), o in zip(kept, own) if o == c]:
                means[c] = [sum(x) // len(members) for x in zip(*members)]
    own = [nearest(v) for _, v in kept]
    each = [away(v, means[o]) for (_, v), o in zip(kept, own)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in means]
    return sorted(
        (-1 if i is None else i, o, d, sum(x for x, y in zip(each, own) if y == o), sum(each), digest[o])
        for (i, _), o, d in zip(kept, own, each)
    )


def rows_of(seed, n, spread):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(DIM)] for _ in range(7)]
    rows = [(i, [m + rng.gauss(0, spread) for m in rng.choice(middles)]) for i in range(n)]
    rows += [(n, rows[0][1])] * 40 + [(n + j, rows[1][1]) for j in range(1, 40)]  # repeated rows, ties
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.5] * (DIM - 1), [0.5] * (DIM + 1), [nan] * DIM, [inf] + [0.0] * (DIM - 1), [None] + [0.1] * (DIM - 1)]
    return rows + [(10_000 + i, v) for i, v in enumerate(odd)] + [(None, [0.25] * DIM), (None, None)]


def found(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    table = table.selectExpr("*", "'mine' as cluster", "1 as distance", "2 as key", "3 as before").repartition(5)
    got = cluster_vectors(table, dim=DIM, **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((-1 if r.vec_id is None else r.vec_id, *r[1:]) for r in got.collect())


@pytest.mark.parametrize(("seed", "spread", "scale", "rounds"), [(1, 0.3, 64, 3), (2, 0.02, 4, 5), (3, 0.6, 3_000_000, 2)])
def test_equals_plain_rounds(spark, seed, spread, scale, rounds):
    rows = rows_of(seed, 400, spread)
    assert found(spark, rows, k=9, rounds=rounds, scale=scale) == plain(rows, 9, rounds, scale)


def test_few_none_and_equal_vectors(spark):
    few = [(3, [0.5] * DIM), (4, [-0.5] * DIM), (4, [-0.5] * DIM)]
    assert found(spark, few, k=16, rounds=3, scale=64) == plain(few, 16, 3, 64)
    assert found(spark, [(1, None), (2, [])], k=16) == []
    same = [(i, [0.1] * DIM) for i in range(50)]
    assert found(spark, same, k=4, rounds=3, scale=64) == plain(same, 4, 3, 64)


def test_rounds_pop_only_what_expired(spark, monkeypatch):
    """Far-apart groups: after the first pass next to nothing is compared again."""
    rng = random.Random(5)
    rows = [(i, [10.0 * (i % 6 == j) + rng.gauss(0, 0.01) for j in range(DIM)]) for i in range(1200)]
    sizes = []
    plain_stored = centroids.stored

    def counted(df):
        out = plain_stored(df)
        if "key" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(centroids, "stored", counted)
    assert found(spark, rows, k=6, rounds=3, scale=64) == plain(rows, 6, 3, 64)
    assert sizes[0] == 1200 and sum(sizes[1:]) < 3 * 1200
    far = [(i, [100.0 * (j == 0) * (i % 2) + rng.gauss(0, 0.01) for j in range(DIM)]) for i in range(600)]
    sizes.clear()
    found(spark, far, k=2, rounds=3, scale=64)
    assert sum(sizes[2:]) < 300


def test_too_large_components(spark):
    with pytest.raises(Exception, match="do not fit"):
        found(spark, [(1, [1e30] * DIM), (2, [0.0] * DIM)])
