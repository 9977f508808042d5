"""Vector operators: exact distance-threshold joins, connected-component
clustering and its dendrogram, cosine neighbours (C1-C4, L11, J11).

**Exact distance join.**  Reference vectors, from a sample of bounded size, cut the space
into cells: a vector's home is the cell of its nearest reference.  A vector
x whose home is i can only be within t of a vector of cell j if its distance from the plane
between both references, ``(|x - p_j|^2 - |x - p_i|^2) / (2 |p_i - p_j|)``, is t or less, so x is
copied into just those cells.  A pair (a < b) is looked for in the home of b,
where a is at home or has a copy: exactly once.  Within a cell, homes and visitors are dealt
to blocks by the cell's measured size, and every pair of blocks is one product of two
small matrices; pairs near the threshold are then computed component by component.

The number of cells is chosen on the sample: the one with the least work for the copies and the
pairs that meet.  For near-duplicate thresholds few vectors are copied and few pairs meet; when t is as large as the
distance of unrelated vectors no cell can be left out, one cell is best, and the work is that of
all pairs, in blocks over all tasks.

**Single link** at distance t is exactly the connected components of the
graph of pairs within t, found by large-star and small-star rounds
(:mod:`corpusmill.operators.components`).  The minimum spanning forest of that graph
(:func:`spanning_forest`) is the whole dendrogram: its edges up to any smaller distance
have the components of that cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import components
from corpusmill.operators.ranking import top_k
from corpusmill.session import materialize, ship_package


def sq_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, z: acc + z)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, z: acc + z)


def normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / norm)


def _squares(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2.0 * (x @ p.T), 0.0)


def visits(x: np.ndarray, cells: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each row, whether each row is copied into each cell; the home counts)."""
    d = _squares(x, cells)
    home = d.argmin(axis=1)
    apart = np.sqrt(_squares(cells, cells))[home]
    near = d - d[np.arange(len(x)), home][:, None] <= 2.0 * apart * (t * (1 + 1e-9)) + 1e-9
    near[np.arange(len(x)), home] = True
    return home, near


def choose_cells(sample: np.ndarray, n: int, t: float, most: int = 1024, row_cost: float = 200.0) -> np.ndarray:
    """The references with the least estimated work over ``n`` vectors: ``row_cost`` for
    each copy that is shuffled, 1 for each pair that meets."""
    best, work = sample[:1], row_cost * n + 0.5 * float(n) * n
    half = len(sample) // 2
    k = 4
    while k <= min(most, half):
        cells, rest = sample[:k], sample[half:]
        home, near = visits(rest, cells, t)
        share = np.bincount(home, minlength=k) / len(rest)
        got = row_cost * n * near.sum() / len(rest) + 0.5 * float(n) * n * float((near.mean(axis=0) * share).sum())
        if got < work:
            best, work = cells, got
        k *= 4
    return best


def _sample(vecs: DataFrame, n: int, size: int) -> np.ndarray:
    """At most ``size`` different vectors, those with the least hash."""
    h = F.xxhash64("v")
    some = vecs.filter(F.pmod(h, F.lit(1 << 20)) <= F.lit(min(1.0, 2.0 * size / max(n, 1)) * (1 << 20)))
    rows = some.select(h.alias("h"), "v").distinct().orderBy("h", "v").limit(size).collect()
    return np.array([r["v"] for r in rows], float)


def _matrix(column) -> np.ndarray:
    flat = np.asarray(column.flatten(), float)
    return flat.reshape(len(column), -1)


def _placed(cells, t: float, block: int):
    """(id, v, cell, home) rows: the home of each vector and its copies."""
    def run(batches):
        import pyarrow as pa
        points = cells.value
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                home, near = visits(_matrix(part.column(1)), points, t)
                row, cell = np.nonzero(near)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(cell.astype(np.int32)),
                     pa.array(home[row] == cell)], ["id", "v", "cell", "home"])
    return run


def close_pairs(ids_a, a: np.ndarray, ids_b, b: np.ndarray, t: float):
    """Index pairs (i, j) with ``ids_a[i] < ids_b[j]`` and a distance of t or less, and the distance."""
    maybe = _squares(a, b) <= t * t + 1e-9 * (1.0 + t * t)
    maybe &= np.asarray(ids_a)[:, None] < np.asarray(ids_b)[None, :]
    i, j = np.nonzero(maybe)
    dist = np.empty(len(i))
    for at in range(0, len(i), 1 << 14):
        part = slice(at, at + (1 << 14))
        dist[part] = np.sqrt(((a[i[part]] - b[j[part]]) ** 2).sum(axis=1))
    ok = dist <= t
    return i[ok], j[ok], dist[ok]


def least_forest(a: np.ndarray, b: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Which of the edges are in their minimum spanning forest, by distance, then ends: Boruvka rounds on arrays."""
    order = np.lexsort((b, a, dist))
    names, ends = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    u, v = ends[:len(a)], ends[len(a):]
    every, keep, left = np.arange(len(names)), np.zeros(len(a), bool), np.arange(len(a))
    root = every
    while True:
        apart = root[u[left]] != root[v[left]]
        left = left[apart]
        if not len(left):
            return keep
        best = np.full(len(names), len(a))
        for side in (u, v):
            np.minimum.at(best, root[side[left]], left)
        has = np.flatnonzero(best < len(a))
        edge = best[has]
        keep[order[edge]] = True
        parent = every.copy()
        parent[has] = np.where(root[u[edge]] == has, root[v[edge]], root[u[edge]])
        parent = np.where((parent[parent] == every) & (every < parent), every, parent)     # the only cycles have two nodes
        while (parent[parent] != parent).any():
            parent = parent[parent]
        root = parent[root]


def _nearest(ends: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Which edges are among the ``k`` least of their end, or as near as rounding of a cosine to six digits may hide."""
    order = np.lexsort((dist, ends))
    e, d = ends[order], dist[order]
    first = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
    size = np.diff(np.r_[first, len(e)])
    ok = np.empty(len(e), bool)
    ok[order] = d * d <= np.repeat(d[first + np.minimum(size, k) - 1] ** 2, size) + 4e-6
    return ok


def forest_only(a, b, dist):
    """Of a group's pairs the edges of its own minimum spanning forest: those of all groups have the forest and the
    components of all pairs."""
    return least_forest(a, b, dist)


def nearest_only(k: int):
    """Of a group's pairs those that are among the k nearest of either end in the group."""
    def keep(a, b, dist):
        return _nearest(a, dist, k) | _nearest(b, dist, k) if len(a) else np.zeros(0, bool)
    return keep


MEETING = 1024      # rows a side of one product
HELD = 1 << 20      # pairs of a group that are held before the keeper sorts some out


def _met(ids_a, a, ids_b, b, t: float, keeper):
    """(index in a, index in b, distance) of a group's pairs, product after product; all at once and only those that
    ``keeper`` keeps, if there is one."""
    held = [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
    new: list = []
    for at in range(0, len(a), MEETING):
        for to in range(0, len(b), MEETING):
            i, j, d = close_pairs(ids_a[at:at + MEETING], a[at:at + MEETING], ids_b[to:to + MEETING], b[to:to + MEETING], t)
            if not keeper:
                yield i + at, j + to, d
                continue
            new.append((i + at, j + to, d))
            if sum(len(x[2]) for x in new) >= HELD:
                held = _kept(ids_a, ids_b, held, new, keeper)
                new = []
    if keeper:
        yield _kept(ids_a, ids_b, held, new, keeper)


def _kept(ids_a, ids_b, held, new, keeper):
    i, j, d = (np.concatenate([x, *(n[c] for n in new)]) for c, x in enumerate(held))
    ok = keeper(ids_a[i], ids_b[j], d)
    return [i[ok], j[ok], d[ok]]


def _pairs(t: float, keeper=None):
    """Pairs of each group of adjacent rows with equal (cell, lo, hi)."""
    def run(batches):
        import pyarrow as pa
        held: dict = {}
        key = None

        def close():
            sides = []
            for side in (False, True):
                parts = held.get(side)
                if not parts:
                    return
                sides.append((pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))
            (ids_a, a), (ids_b, b) = sides
            numbers = [ids.to_numpy(zero_copy_only=False) for ids in (ids_a, ids_b)]
            for i, j, d in _met(numbers[0], a, numbers[1], b, t, keeper):
                yield pa.RecordBatch.from_arrays([ids_a.take(pa.array(i)), ids_b.take(pa.array(j)), pa.array(d)],
                                                 ["a", "b", "dist"])
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in range(4)], axis=1).astype(np.int64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if lo == hi:
                    continue
                mine = tuple(keys[lo, :3].tolist())
                if key is not None and mine != key:
                    yield from close()
                    held = {}
                key = mine
                part = batch.slice(lo, hi - lo)
                held.setdefault(bool(keys[lo, 3]), []).append((part.column(4), _matrix(part.column(5))))
        if key is not None:
            yield from close()
    return run


def epsilon_pairs(vecs: DataFrame, t: float, sample: int = 4096, block: int | None = None, keeper=None) -> DataFrame:
    """C4: every pair (a < b) with euclidean distance <= t, exactly once,
    with its distance.  ``vecs`` has (id, v array<double> or array<float>) of one length, without nulls; four-byte
    components are shuffled as such and computed as eight-byte ones.

    A cell has at most 16 blocks of a side up to two million vectors, so that each vector is shuffled a bounded number of times;
    ``block`` sets their rows.  With a ``keeper`` (:func:`forest_only`, :func:`nearest_only`) each group of blocks
    returns the pairs that it keeps."""
    spark = vecs.sparkSession
    ship_package(spark)
    kind, numbers = (vecs.schema[c].dataType.simpleString() for c in ("id", "v"))
    n = vecs.count()
    if n < 2:
        return vecs.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("dist")).limit(0)
    block = block or min(max(MEETING, -(-n // 16)), 1 << 17)
    cells = spark.sparkContext.broadcast(choose_cells(_sample(vecs, n, sample), n, t))
    placed = materialize(vecs.select("id", "v").mapInArrow(
        _placed(cells, t, MEETING), f"id {kind}, v {numbers}, cell int, home boolean"), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count_if("home") / block).alias("b"), F.ceil(F.count("id") / block).alias("a"))
    both = placed.join(F.broadcast(sizes), "cell")      # a row per cell: at most ``most`` of them
    number = F.xxhash64("id")

    def side(df, blocks, others, homes):
        mine = F.pmod(number, F.col(blocks)).cast("int")
        other = F.explode(F.sequence(F.lit(0), (F.col(others) - 1).cast("int")))
        lo, hi = ("other", "mine") if homes else ("mine", "other")
        return df.filter((F.col("a") > 0) & (F.col("b") > 0)).select("cell", mine.alias("mine"), other.alias("other"), "id", "v") \
            .select("cell", F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.lit(int(homes)).alias("side"), "id", "v")
    rows = side(both, "a", "b", False).unionByName(side(both.filter("home"), "b", "a", True))
    keys = ["cell", "lo", "hi"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(
        _pairs(t, keeper), f"a {kind}, b {kind}, dist double")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster) where cluster = smallest id of the component; a node
    without an edge is its own cluster.  ``edges`` has (a, b)."""
    comp = components.connected_components(edges)
    return nodes.select("id").join(comp, "id", "left").select(
        "id", F.coalesce("root", "id").alias("cluster"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest (a, b, dist) of the pairs (a, b, dist), by Boruvka rounds: every
    component takes the least edge that leaves it (by distance, then ends, so that no two are equal and no cycle can
    close), and components that are joined become one.  Edges inside a component are dropped, so the table
    shrinks, and the number of rounds is at most the logarithm of the number of nodes."""
    left = materialize(edges.select("a", "b", "dist", F.col("a").alias("ca"), F.col("b").alias("cb")).filter("a <> b"), "boruvka")
    chosen = None
    while left.limit(1).count():
        e = F.struct("dist", "a", "b").alias("e")
        ends = left.select(F.col("ca").alias("c"), F.col("cb").alias("other"), e).unionByName(
            left.select(F.col("cb").alias("c"), F.col("ca").alias("other"), e))
        least = materialize(ends.groupBy("c").agg(F.min_by("other", "e").alias("other"), F.min("e").alias("e")), "boruvka-least")
        took = least.select("e.a", "e.b", "e.dist").distinct()
        chosen = took if chosen is None else chosen.unionByName(took)
        comp = components.connected_components(least, "c", "other")
        left = left.join(comp.select(F.col("id").alias("ca"), F.col("root").alias("ra")), "ca", "left") \
            .join(comp.select(F.col("id").alias("cb"), F.col("root").alias("rb")), "cb", "left") \
            .select("a", "b", "dist", F.coalesce("ra", "ca").alias("ca"), F.coalesce("rb", "cb").alias("cb"))
        left = materialize(left.filter("ca <> cb"), "boruvka")
    return edges.select("a", "b", "dist").limit(0) if chosen is None else chosen


def cuts(nodes: DataFrame, forest: DataFrame, distances: list[float]) -> DataFrame:
    """(t, id, cluster) for every cut distance, from the forest alone."""
    out = None
    for t in distances:
        got = connected_components(nodes, forest.filter(F.col("dist") <= t)).select(F.lit(float(t)).alias("t"), "id", "cluster")
        out = got if out is None else out.unionByName(got)
    return out


def cosine_neighbours(vecs: DataFrame, min_cos: float, k: int) -> DataFrame:
    """For every vector, its k most cosine-similar vectors among those
    with similarity >= ``min_cos`` (an exact epsilon join on the unit
    sphere: cos >= c  <=>  |a - b| <= sqrt(2 - 2c))."""
    unit = vecs.select("id", normalize(F.col("v")).alias("v"))
    t = (2.0 - 2.0 * min_cos) ** 0.5
    pairs = epsilon_pairs(unit, t, keeper=nearest_only(k)).withColumn("cos", F.lit(1.0) - F.col("dist") * F.col("dist") / 2.0)
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "cos").unionByName(
        pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "cos"))
    both = both.withColumn("cos", F.round("cos", 6))
    return top_k(both, ["id"], [F.desc("cos"), F.asc("other")], k, salt_cols=["other"])
