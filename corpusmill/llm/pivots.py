"""Operator 11: embedding near-duplicates by a pivot-permutation index.

1. Reference points (pivots) are vectors of the table, from a sample of bounded
   size, no two closer than ``separation``; a group of near copies gives one.
2. A vector is described by its ``near`` nearest pivots in order.  Equal vectors
   (up to a power of two) are folded into one member with a count.
3. The inverted lists are kept for sets of ``shared`` pivots: a member stands in
   the list of every such set of its nearest pivots, so members that meet
   share at least that many.  Lists of one member go, and of lists with equal members only the
   first stays.  A pair counts in the first list that it shares.
4. A list of many members is dealt to blocks; each pair of blocks is one group.  The groups
   are read in order within a partition, one at a time, and every pair is
   verified by its cosine in double precision; pairs within 1e-12 of the
   threshold are computed again one by one.  A group returns counts and one
   linked root per member, never its pairs.
5. Components of the root links are the classes.

Recall: a pair is missed only if it shares fewer than ``shared`` of its ``near``
pivots; the links found are exact.  The README gives the recall measured.

The work on one group of m different vectors that are all near each other grows
with m^2 (in blocks over all tasks), since its links are to be counted; equal vectors
do not add to it.

Defined cases: null and zero vectors and those with null or non-finite
components link with nothing and are kept; vectors of unlike length never
link; repeated rows are copies and link with each other; rows that share an id but
not the vector are judged apart; null ids count as vectors, but the least id of
a component is among the others (null if there is none); an empty table gives
an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.components import connected_components
from corpusmill.session import materialize

BITS = 20       # of a pivot's number in a list's key


def _vectors(column):
    """(rows, 2-d array) for each length of an Arrow list column: the usable vectors as doubles,
    scaled by a power of two so that the largest component is in [0.5, 1)."""
    valid = np.asarray(column.is_valid())
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = column.values
    null = np.asarray(values.is_null())
    flat = np.asarray(values.fill_null(float("nan"))).astype(np.float64)
    flat[null] = np.nan
    size = np.where(valid, np.diff(offsets), 0)
    for width in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == width)
        v = flat[offsets[:-1][rows][:, None] + np.arange(width)]
        most = np.abs(v).max(axis=1)
        ok = np.isfinite(v).all(axis=1) & (most > 0)
        rows, v = rows[ok], v[ok]
        if len(rows):
            yield rows, np.ldexp(v, -np.frexp(most[ok])[1][:, None]) + 0.0


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def choose_pivots(sample: list[np.ndarray], pivots: int, separation: float, seed: int = 11) -> np.ndarray:
    """Up to ``pivots`` unit vectors of ``sample``, no two with a cosine over
    ``separation``; random directions make up the number."""
    width = max((len(v) for v in sample), default=1)
    out = np.zeros((pivots, width))
    n = 0
    for v in sample:
        if n == pivots:
            return out
        u = np.zeros(width)
        u[:len(v)] = v
        u /= np.sqrt(u @ u)
        if n == 0 or (out[:n] @ u).max() <= separation:
            out[n] = u
            n += 1
    out[n:] = _unit(np.random.default_rng(seed).standard_normal((pivots - n, width)))
    return out


def describe(v: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """The numbers of the ``near`` nearest pivots of each vector, nearest first."""
    width = min(v.shape[1], pivots.shape[1])
    cos = v[:, :width] @ pivots[:, :width].T
    top = np.argpartition(-cos, near - 1, axis=1)[:, :near]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(cos, top, axis=1), axis=1, kind="stable"), axis=1)


def _describe(pivots, near: int, kind: str):
    """``kind``: the numpy type of the stored vectors, that of the table's."""
    def run(batches):
        import pyarrow as pa
        points = pivots.value
        for batch in batches:
            n = batch.num_rows
            key, wide, perm, data = [None] * n, [0] * n, [None] * n, [None] * n
            for rows, v in _vectors(batch.column(1)):
                for at in range(0, len(rows), 4096):
                    part = v[at:at + 4096]
                    order = describe(_unit(part), points, near).tolist()
                    for i, x, p in zip(rows[at:at + 4096].tolist(), part, order, strict=True):
                        data[i] = x.astype(kind).tobytes()
                        key[i] = hashlib.blake2b(data[i], digest_size=16).digest()
                        wide[i], perm[i] = len(x), p
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(key, pa.binary()), pa.array(wide, pa.int32()),
                 pa.array(perm, pa.list_(pa.int32())), pa.array(data, pa.binary())],
                ["id", "key", "width", "pivots", "data"])
    return run


def _sample(vecs: DataFrame, size: int) -> list[np.ndarray]:
    """At most ``size`` vectors, those with the least hash."""
    n = vecs.count()
    h = F.xxhash64(F.col("v"))
    some = vecs.filter(F.pmod(h, F.lit(1 << 20)) <= F.lit(min(1.0, 2.0 * size / max(n, 1)) * (1 << 20)))
    rows = some.select(h.alias("h"), "v").distinct().orderBy("h", "v").limit(size).select("v").toArrow()
    out = [None] * rows.num_rows
    column = rows.column("v").combine_chunks()
    for at, v in _vectors(column) if rows.num_rows else ():
        for i, x in zip(at.tolist(), v, strict=True):
            out[i] = x
    return [x for x in out if x is not None]


def verify(data: np.ndarray, copies: np.ndarray, block: np.ndarray, pivots: np.ndarray, first: tuple,
           cross: bool, threshold: float):
    """(links, roots) of a group's members: for each the rows it is linked
    with, and the first member that is reached.  ``first`` is the list's set of pivots: pairs that
    share an earlier set are counted there."""
    u = _unit(data)
    cos = u @ u.T
    for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-12), strict=True):
        cos[i, j] = float(data[i] @ data[j]) / float(np.sqrt(data[i] @ data[i]) * np.sqrt(data[j] @ data[j]))
    link = cos >= threshold
    if cross:
        link &= block[:, None] != block[None, :]
    np.fill_diagonal(link, False)
    # the set is the least one shared iff no other pivot up to its last is shared
    seen = np.unique(pivots[pivots < first[-1]])
    has = (pivots[:, :, None] == seen[None, None, :]).any(axis=1)[:, ~np.isin(seen, first)].astype(np.float32)
    link &= has @ has.T == 0
    root = np.arange(len(data))
    while True:
        new = np.minimum(root, np.where(link, root[None, :], len(data)).min(axis=1))
        if (new == root).all():
            return link @ copies, root
        root = new


def _verify(threshold: float, shared: int, kind: str):
    """Groups of adjacent rows with equal (width, list, lo, hi)."""
    mask = (1 << BITS) - 1

    def run(batches):
        import pyarrow as pa
        held: list = []
        out: list = []

        def close():
            if not held:
                return
            width, key, lo, hi = held[0][:4]
            rows = sorted(held, key=lambda r: r[5])
            held.clear()
            if len(rows) < 2:
                return
            names = [r[5] for r in rows]
            first = tuple((key >> BITS * i) & mask for i in reversed(range(shared)))
            links, root = verify(np.array([np.frombuffer(r[8], kind) for r in rows], float), np.array([r[6] for r in rows]),
                                 np.array([r[4] for r in rows]), np.array([r[7] for r in rows]), first,
                                 lo != hi, threshold)
            out.extend((names[i], int(links[i]), names[root[i]]) for i in np.flatnonzero(links).tolist())

        def batch_out():
            cols = list(zip(*out, strict=True)) or [[], [], []]
            got = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()),
                                              pa.array(cols[2], pa.binary())], ["key", "links", "root"])
            out.clear()
            return got
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[0][:4] != row[:4]:
                    close()
                held.append(row)
            yield batch_out()
        close()
        yield batch_out()
    return run


def near_vectors(vecs: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.95,
                 pivots: int = 1024, near: int = 8, shared: int = 3, sample: int = 4096, separation: float = 0.6,
                 block: int = 512) -> DataFrame:
    """Per row of ``vecs``: id, n_links (other rows with a cosine of
    ``threshold`` or more) and component_id (the least id that links reach)."""
    spark = vecs.sparkSession
    id_type = vecs.schema[id_col].dataType.simpleString()
    single = vecs.schema[vector].dataType.simpleString() == "array<float>"
    kind = "f4" if single else "f8"
    src = vecs.select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    points = spark.sparkContext.broadcast(choose_pivots(_sample(src.select("v"), sample), pivots, separation))
    rows = materialize(src.mapInArrow(
        _describe(points, near, kind), f"id {id_type}, key binary, width int, pivots array<int>, data binary"), "pivots")
    members = materialize(rows.filter("key is not null").groupBy("key").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("width").alias("width"),
        F.first("pivots").alias("pivots"), F.first("data").alias("data")), "members")
    p = F.col("p")
    sets = [sum((F.element_at(p, i + 1).cast("long") * (1 << BITS * (shared - 1 - at)) for at, i in enumerate(c)), F.lit(0))
            for c in itertools.combinations(range(near), shared)]
    lists = members.select("key", "width", F.array_sort("pivots").alias("p")) \
        .select("key", "width", F.explode(F.array(*sets)).alias("list"))
    sizes = lists.groupBy("width", "list").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("key")).alias("x"),
        F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).filter("m > 1")
    kept = materialize(sizes.groupBy("width", "m", "x", "y").agg(F.min("list").alias("list"))
                       .select("width", "list", "m"), "lists")
    g = F.ceil(F.col("m") / F.lit(block)).cast("int")
    due = lists.join(kept, ["width", "list"]).select("key", F.struct(
        "list", g.alias("g"), F.pmod(F.xxhash64("key", F.lit(2)), g).cast("int").alias("block")).alias("j")) \
        .groupBy("key").agg(F.collect_list("j").alias("js"))
    sent = members.join(due, "key").select("width", "key", "copies", "pivots", "data", F.explode("js").alias("j")) \
        .select("*", F.explode(F.sequence(F.lit(0), F.col("j.g") - 1)).alias("other")) \
        .select("width", "j.list", F.least("j.block", "other").alias("lo"), F.greatest("j.block", "other").alias("hi"),
                "j.block", "key", "copies", "pivots", "data")
    groups = ["width", "list", "lo", "hi"]
    found = materialize(sent.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(
        _verify(threshold, shared, kind), "key binary, links long, root binary"), "vector-links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    comp = connected_components(found, "key", "root").withColumnRenamed("id", "key")
    named = members.select("key", "id", "copies").join(comp, "key", "left").join(links, "key", "left") \
        .withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    per = named.drop("id").join(least, "root").select(
        "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.select("id", "key").join(per, "key", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
