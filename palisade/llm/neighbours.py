"""Embedding near-duplicates by NN-descent.

Equal directions are folded to one node.  Every node has a list of its nearest nodes.  The first lists come
from random projection trees: nodes sorted by the signs of projections are cut into leaves, and a leaf's nodes are
compared.  Then lists are refined through neighbours of neighbours: at each node the nodes on its list, and those on
whose list it is, are compared with each other.  A list that holds links only is saturated and gets twice the room
in the next round, without a ceiling.

Lists are cut, links are not: of all links that a comparison meets a spanning forest is kept, which has the same
components and no more rows than nodes.  Comparisons read vectors of half precision; what these leave open at the
threshold is decided in double precision.  An audit holds the components against brute force for a bounded
sample; until it is content, more trees are planted and lists refined again, and if it never is, the job fails.
Inside a component links are counted by comparing its members in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.components import components, merged
from palisade.session import stored

#: Room of a list at first, and how many of a leaf's nearest a tree adds to it.
NEIGHBOURS, FIRST = 8, 4
#: Nodes of a leaf, and the chance that a link at the threshold, and no more, shares no leaf of the first trees.
LEAF, MISS = 128, 0.01
#: Partners of a node that are compared at once; a node with more has several such groups, others in each round.
PARTNERS = 32
#: Components of vectors that are compared in one product.
TENSOR = 1 << 19
#: Rounds of refinement before the first audit, and how often it may ask for more.
ROUNDS, MOST_AUDITS = 2, 4
#: Nodes of an audit (the smallest by hash) that have links and of all, and the recall that contents it.
AUDIT_LINKED, AUDIT_ALL, RECALL = 1024, 2048, 0.999
#: Links of an audited node that are taken from a batch of vectors.
AUDIT_BATCH = 16
#: Members of a component that are compared at once.
BLOCK = 128
#: Entry of a list, link, and pair that half precision leaves open.
_NEAR, _SURE, _OPEN = 0, 1, 2
_MET = "a long, b long, cos float, kind byte"


def _matrix(blobs: pa.Array, size: int, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), kind).reshape(-1, size)


def _halves(blobs: pa.Array, size: int) -> np.ndarray:
    return _matrix(blobs, size, np.float16).astype(np.float32)


def _doubt(size: int) -> float:
    """Largest error of a cosine of unit vectors that were rounded to half precision and multiplied in single:
    2**-11 of each vector's length, what is lost below the smallest normal numbers, and the sum's rounding."""
    return 2.0**-10 + 2.0**-20 + size * 2.0**-23


def _met(nears: list, sures: list, opens: list) -> pa.RecordBatch:
    """Entries (a, b, cos), a spanning forest of the links (a, b), and of the open pairs (a, b) those that it leaves apart."""
    near = [np.concatenate(x) for x in zip(*nears, strict=True)] if nears else [np.zeros(0, np.int64)] * 3
    ends = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (*_sides(sures), *_sides(opens))]
    ids, place = np.unique(np.concatenate(ends), return_inverse=True)
    a, b, left, right = np.split(place, np.cumsum([len(x) for x in ends[:-1]]))
    labels = np.arange(len(ids))
    _merge(labels, a, b)
    joined = np.flatnonzero(labels != np.arange(len(ids)))
    apart = labels[left] != labels[right]
    parts = (
        (near[0], near[1], near[2], _NEAR),
        (ids[joined], ids[labels[joined]], np.ones(len(joined)), _SURE),
        (ids[left[apart]], ids[right[apart]], np.ones(apart.sum()), _OPEN),
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([x[0] for x in parts]), pa.int64()),
            pa.array(np.concatenate([x[1] for x in parts]), pa.int64()),
            pa.array(np.concatenate([x[2] for x in parts]).astype(np.float32)),
            pa.array(np.repeat([x[3] for x in parts], [len(x[0]) for x in parts]), pa.int8()),
        ],
        names=["a", "b", "cos", "kind"],
    )


def _sides(pairs: list) -> tuple[list, list]:
    return [a for a, _ in pairs], [b for _, b in pairs]


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): distinct unit vectors ``node, first_id, copies, size, unit, half`` (the last in half precision), and ``vec_id, key`` of all rows."""

    def normal(batches):
        for batch in batches:
            units = []
            for x in batch.column(1):
                values = x.as_py()
                ok = bool(values) and None not in values
                row = np.array(values if ok else [0], np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    scaled = row / np.abs(row).max() if ok and np.isfinite(row).all() and row.any() else None
                units.append(None if scaled is None else (scaled / np.linalg.norm(scaled) + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary())], names=["vec_id", "unit"])

    kind = dict(vectors.dtypes)["vec_id"]
    found = vectors.select("vec_id", "embedding").mapInArrow(normal, f"vec_id {kind}, unit binary")
    found = stored(found.withColumn("key", F.sha2("unit", 256)))
    folded = (
        found.where("unit is not null and vec_id is not null")
        .groupBy("key")
        .agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    )
    numbered = folded.select(
        F.monotonically_increasing_id().alias("node"), "*", (F.octet_length("unit") / 8).cast("int").alias("size")
    )

    def rounded(batches):
        for batch in batches:
            half = [np.frombuffer(x, np.float64).astype(np.float16).tobytes() for x in batch.column("unit").to_pylist()]
            yield batch.append_column("half", pa.array(half, pa.binary()))

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema)
    return stored(numbered.mapInArrow(rounded, f"{columns}, half binary")), found.select("vec_id", "key")


def forest_shape(nodes: int, threshold: float) -> tuple[int, int]:
    """(bits of a code, trees) for so many nodes: codes hold half a leaf on average."""
    bits = max(1, math.ceil(math.log2(max(2, 2 * nodes / LEAF))))
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    shared = min(max(agree**bits, 1e-9), 1 - 1e-9)
    return bits, math.ceil(math.log(MISS) / math.log1p(-shared))


def _planted(nodes: DataFrame, bits: int, trees: range, threshold: float, seed: int) -> DataFrame:
    """What the leaves of some trees meet: nodes sorted by the signs of their projections, then along one more,
    and cut into leaves.  Equal codes fall into as many leaves as they fill."""

    def project(batches):
        for batch in batches:
            sizes = np.asarray(batch.column(1))
            for size in np.unique(sizes).tolist():
                at = pa.array(np.flatnonzero(sizes == size))
                unit = _halves(batch.column(2).take(at), size)
                for tree in trees:
                    plane = np.random.default_rng((seed, tree, size)).normal(size=(size, bits + 1))
                    side = unit @ plane
                    code = (side[:, :-1] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), tree), pa.int64()),
                            pa.array(np.full(len(at), size), pa.int64()),
                            pa.array(code.astype(np.int64)),
                            pa.array(side[:, -1]),
                            batch.column(0).take(at),
                            batch.column(2).take(at),
                        ],
                        names=["tree", "size", "code", "along", "node", "half"],
                    )

    def leaf(rows: pa.RecordBatch) -> pa.RecordBatch:
        size, ids = int(rows.column(1)[0].as_py()), np.asarray(rows.column(2))
        half = _halves(rows.column(3), size)
        cos = half @ half.T
        np.fill_diagonal(cos, -2)
        most = min(FIRST, len(ids) - 1)
        if most < 1:
            return _met([], [], [])
        row = np.repeat(np.arange(len(ids)), most)
        other = np.argpartition(-cos, most - 1, axis=1)[:, :most].ravel()
        a, b = np.nonzero(np.triu(cos >= threshold + _doubt(size)))
        left, right = np.nonzero(np.triu(np.abs(cos - threshold) < _doubt(size)))
        return _met([(ids[row], ids[other], cos[row, other])], [(ids[a], ids[b])], [(ids[left], ids[right])])

    def leaves(batches):
        rest = None
        for batch in batches:
            rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if not rows.num_rows:
                continue
            kind = [np.asarray(rows.column(i)) for i in (0, 1)]
            cuts = np.flatnonzero((np.diff(kind[0]) != 0) | (np.diff(kind[1]) != 0)) + 1
            start = done = 0
            for end in [*cuts.tolist(), rows.num_rows]:
                last = end if end < rows.num_rows else end - LEAF + 1
                for i in range(start, last, LEAF):
                    yield leaf(rows.slice(i, min(LEAF, end - i)))
                    done = min(i + LEAF, end)
                start = end
            rest = rows.slice(done)
        if rest is not None and rest.num_rows:
            yield leaf(rest)

    placed = nodes.select("node", F.col("size").cast("long"), "half").mapInArrow(
        project, "tree long, size long, code long, along double, node long, half binary"
    )
    order = ("tree", "size", "code", "along", "node")
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "size", "node", "half")
    return stored(ranged.mapInArrow(leaves, _MET))


def _lists(met: DataFrame, before: DataFrame | None, rooms: DataFrame | None, most: int) -> DataFrame:
    """``a, b, cos``: the nearest of each node, as many as it has room for; ``most`` is the largest room."""
    near = met.where(F.col("kind") == _NEAR).select("a", "b", "cos")
    if before is not None:
        near = near.unionByName(before)
    near = near.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "b"))
    ranked = near.withColumn("place", place).where(F.col("place") <= most)
    if rooms is not None:
        ranked = ranked.join(rooms.select(F.col("node").alias("a"), "room"), "a", "left")
        ranked = ranked.where(F.col("place") <= F.coalesce("room", F.lit(NEIGHBOURS)))
    return stored(ranked.select("a", "b", "cos"))


def _rooms(lists: DataFrame, rooms: DataFrame | None, threshold: float) -> DataFrame:
    """``node, room, worst``: a full list of links only gets twice the room; below ``worst`` nothing enters a full list."""
    held = lists.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("held"), F.min("cos").alias("least"))
    if rooms is None:
        held = held.withColumn("had", F.lit(NEIGHBOURS).cast("long"))
    else:
        held = held.join(rooms.select("node", F.col("room").alias("had")), "node", "left").withColumn(
            "had", F.coalesce("had", F.lit(NEIGHBOURS).cast("long"))
        )
    room = F.when((F.col("held") >= F.col("had")) & (F.col("least") >= threshold), F.col("had") * 2).otherwise(F.col("had"))
    worst = F.when(F.col("held") >= F.col("room"), F.col("least")).otherwise(F.lit(-2.0)).cast("float")
    return stored(held.withColumn("room", room).select("node", "room", worst.alias("worst")))


def _tensor(rows: pa.RecordBatch, cuts: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """What groups rows[cuts[i]:cuts[i + 1]] meet; groups of about one size are compared in one product."""
    counts = np.diff(cuts)
    sizes, ids, worst = (np.asarray(rows.column(i)) for i in (3, 2, 5))
    order = np.lexsort((counts, sizes[cuts[:-1]]))
    order = order[counts[order] > 1]
    nears, sures, opens = [], [], []
    for size in np.unique(sizes).tolist():
        mine = order[sizes[cuts[order]] == size]
        step = max(1, TENSOR // (PARTNERS * size))
        for i in range(0, len(mine), step):
            part = mine[i : i + step]
            wide = int(counts[part].max())
            at = cuts[part][:, None] + np.arange(wide)
            real = np.arange(wide) < counts[part][:, None]
            at = np.where(real, at, 0)
            half = _halves(rows.column(4).take(pa.array(at.ravel())), size).reshape(len(part), wide, size)
            cos = half @ half.transpose(0, 2, 1)
            pairs = real[:, :, None] & real[:, None, :] & ~np.eye(wide, dtype=bool)
            who, low = ids[at], worst[at]
            g, a, b = np.nonzero(pairs & (cos > low[:, :, None]))
            nears.append((who[g, a], who[g, b], cos[g, a, b]))
            pairs &= np.triu(np.ones((wide, wide), bool))
            g, a, b = np.nonzero(pairs & (cos >= threshold + _doubt(size)))
            sures.append((who[g, a], who[g, b]))
            g, a, b = np.nonzero(pairs & (np.abs(cos - threshold) < _doubt(size)))
            opens.append((who[g, a], who[g, b]))
    yield _met(nears, sures, opens)


def _refined(lists: DataFrame, rooms: DataFrame, nodes: DataFrame, threshold: float, number: int) -> DataFrame:
    """What is met where, at each node, those on its list and those on whose list it is are compared."""
    forth = lists.select(F.col("a").alias("at"), F.col("b").alias("node"))
    both = stored(forth.union(forth.select("node", "at")).distinct())
    groups = both.groupBy("at").agg(F.ceil(F.count("*") / PARTNERS).alias("groups"))
    spread = both.join(stored(groups), "at").select(
        "at", F.pmod(F.xxhash64("node", F.lit(number)), "groups").alias("part"), "node"
    )
    known = stored(nodes.select("node", F.col("size").cast("long"), "half").join(rooms.select("node", "worst"), "node"))

    def compare(batches):
        rest = None
        for batch in batches:
            rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if not rows.num_rows:
                continue
            at, part = (np.asarray(rows.column(i)) for i in (0, 1))
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(at) != 0) | (np.diff(part) != 0)) + 1])
            yield from _tensor(rows, cuts, threshold)
            rest = rows.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield from _tensor(rest, np.array([0, rest.num_rows]), threshold)

    placed = spread.join(known, "node").select("at", "part", "node", "size", "half", "worst")
    return stored(placed.repartition("at", "part").sortWithinPartitions("at", "part").mapInArrow(compare, _MET))


def _linked(met: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` that have the components of all links that were met; open pairs are decided in double precision."""

    def exact(batches):
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = [float(np.frombuffer(x) @ np.frombuffer(y)) >= threshold for x, y in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    unit = nodes.select("node", "unit")
    doubtful = met.where(F.col("kind") == _OPEN).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end, name in (("a", "left"), ("b", "right")):
        doubtful = doubtful.join(unit.select(F.col("node").alias(end), F.col("unit").alias(name)), end)
    decided = doubtful.select("a", "b", "left", "right").mapInArrow(exact, "a long, b long")
    return stored(met.where(F.col("kind") == _SURE).select("a", "b").union(decided))


def _audit(nodes: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """Some true links ``a, b`` of a bounded sample of nodes, by brute force over all nodes, and whether ``a`` was
    drawn from ``every`` node or from those that have links."""
    place = F.xxhash64("node", F.lit(3))
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    drawn = ends.orderBy(place, "node").limit(AUDIT_LINKED).withColumn("every", F.lit(False)).union(
        nodes.select("node").orderBy(place, "node").limit(AUDIT_ALL).withColumn("every", F.lit(True))
    )
    drawn = drawn.groupBy("node").agg(F.max("every").alias("every"))
    sample = nodes.select("node", "size", "unit").join(drawn, "node").collect()
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for size in {r["size"] for r in sample}:
        mine = [r for r in sample if r["size"] == size]
        by_size[size] = (
            np.array([r["node"] for r in mine]),
            np.array([r["every"] for r in mine]),
            np.stack([np.frombuffer(bytes(r["unit"]), np.float64) for r in mine]),
        )

    def brute(batches):
        for batch in batches:
            sizes = np.asarray(batch.column(1))
            for size, (ids, every, unit) in by_size.items():
                at = np.flatnonzero(sizes == size)
                if len(at):
                    other = np.asarray(batch.column(0))[at]
                    cos = unit @ _matrix(batch.column(2).take(pa.array(at)), size).T
                    linked = (cos >= threshold) & (ids[:, None] != other)
                    # A node with very many links is audited by some of each batch.
                    a, b = np.nonzero(linked & (np.cumsum(linked, axis=1) <= AUDIT_BATCH))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a]), pa.array(other[b]), pa.array(every[a])], names=["a", "b", "every"]
                    )

    return nodes.select("node", "size", "unit").mapInArrow(brute, "a long, b long, every boolean")


def _recall(truth: DataFrame, labels: DataFrame) -> float:
    """Share of an audited node's true links that lead into its own component, on average over nodes with links.

    Nodes known by a link that was met flatter it where links are lone pairs, so those drawn from all nodes,
    whatever is known of them, are also averaged alone.  The lower of the two counts.
    """
    ends = truth.join(labels.select(F.col("node").alias("a"), F.col("component").alias("left")), "a", "left").join(
        labels.select(F.col("node").alias("b"), F.col("component").alias("right")), "b", "left"
    )
    shares = ends.groupBy("a", "every").agg(F.avg(F.coalesce(F.col("left") == F.col("right"), F.lit(False)).cast("int")).alias("share"))
    row = shares.agg(F.avg("share").alias("all"), F.avg(F.when(F.col("every"), F.col("share"))).alias("every")).first()
    return min((x for x in row if x is not None), default=1.0)


def labelled(nodes: DataFrame, threshold: float, seed: int) -> DataFrame:
    """``node, component`` of nodes with links; fails if no audit is content with its recall."""
    bits, trees = forest_shape(nodes.count(), threshold)
    met = _planted(nodes, bits, range(trees), threshold, seed)
    links = [_linked(met, nodes, threshold)]
    lists, rooms, number, most = _lists(met, None, None, NEIGHBOURS), None, 0, NEIGHBOURS
    labels = None
    for audit in range(MOST_AUDITS + 1):
        for _ in range(ROUNDS if audit == 0 else 1):
            rooms, most = _rooms(lists, rooms, threshold), most * 2
            met = _refined(lists, rooms, nodes, threshold, number)
            links.append(_linked(met, nodes, threshold))
            lists, number = _lists(met, lists, rooms, most), number + 1
        fresh = links[0]
        for more in links[1:]:
            fresh = fresh.union(more)
        labels = components(fresh) if labels is None else merged(labels, fresh)
        truth = stored(_audit(nodes, fresh if audit == 0 else labels.select(F.col("node").alias("a"), F.col("component").alias("b")), threshold))
        reached = _recall(truth, labels)
        if reached >= RECALL:
            return labels if reached == 1 else merged(labels, truth)
        met = _planted(nodes, bits, range(trees, 2 * trees), threshold, seed)
        links, trees = [_linked(met, nodes, threshold)], 2 * trees
        lists = _lists(met, lists, rooms, most)
    raise RuntimeError(f"lists met {reached:.4f} of the audited links after {number} rounds; {RECALL} are asked for")


def _dealt(members: DataFrame, key: tuple[str, ...], most: int) -> DataFrame:
    """``members`` with ``block, low, high``: the members of a key fall into blocks, once for each pair of blocks."""
    sizes = members.groupBy(*key).agg(F.ceil(F.count("*") / most).alias("blocks"))
    dealt = members.join(stored(sizes), list(key)).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        *members.columns, "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the labels (each the smallest place reached so far) of linked places."""
    while True:
        left, right = labels[a], labels[b]
        apart = left != right
        if not apart.any():
            return
        a, b, left, right = a[apart], b[apart], left[apart], right[apart]
        np.minimum.at(labels, np.maximum(left, right), np.minimum(left, right))
        while not np.array_equal(further := labels[labels], labels):
            labels[:] = further


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """``node, linked``: vectors (with copies) that each node links to, within its component."""
    pairs = _dealt(members, ("component",), BLOCK)

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, low, high = (x.as_py() for x in key)
        block, ids = np.asarray(table.column("block")), np.asarray(table.column("node"))
        copies = np.asarray(table.column("copies"))
        unit = _matrix(table.column("unit").combine_chunks(), table.column("size")[0].as_py())
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        linked = (unit[left] @ unit[right].T >= threshold) & (ids[left][:, None] != ids[right])
        out = [(ids[left], linked @ copies[right])]
        if low != high:
            out.append((ids[right], linked.T @ copies[left]))
        node, n = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"node": node, "linked": n.astype(np.int64)})

    found = pairs.groupBy("component", "low", "high").applyInArrow(count, "node long, linked long")
    return found.groupBy("node").agg(F.sum("linked").alias("linked"))


def linked_vectors(vectors: DataFrame, threshold: float = 0.95, seed: int = 17) -> DataFrame:
    """``vec_id, n_links, component_id`` for each row of ``vectors (vec_id, embedding)``.

    Two vectors are linked if their cosine, in double precision, is ``threshold`` or more; ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest ``vec_id`` that links reach.  Vectors of different
    length, and those that are null, empty, zero, or hold null or non-finite components, link with nothing:
    0 links, their own id.  Equal rows all count.  A row with a null ``vec_id`` links with nothing; its component is null.
    """
    nodes, members = nodes_of(vectors)
    labels = labelled(nodes, threshold, seed)
    inside = nodes.join(labels, "node")
    counts = _counted(inside.select("component", "node", "copies", "size", "unit"), threshold)
    smallest = inside.groupBy("component").agg(F.min("first_id").alias("smallest"))
    placed = (
        nodes.select("node", "key", "first_id", "copies")
        .join(labels, "node", "left")
        .join(stored(smallest), "component", "left")
        .join(counts, "node", "left")
        .select(
            "key",
            F.coalesce("smallest", "first_id").alias("component_id"),
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    own = F.col("vec_id").isNotNull()
    return members.join(stored(placed), "key", "left").select(
        "vec_id",
        F.when(own, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"),
        F.when(own, F.coalesce("component_id", "vec_id")).alias("component_id"),
    )
