"""Connected components of an edge table by alternating large-star and
small-star steps.

Large-star links every larger neighbour of a node to the least node around
it; small-star does so with the smaller neighbours.  Alternating both ends in
one star per component, in a number of rounds that grows with the logarithm of
the component, so a chain of any length converges; there is no round limit.
Each round is written as a table (the lineage cut).  Minima are aggregated in
every task first, and rows of a node with very many edges only meet in a join
that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialize


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                       F.bit_xor(F.xxhash64("v", "u", F.lit(7)))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): every node of ``edges`` with the least node of its
    component.  Null ends and self loops are dropped."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")) \
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = materialize(e, "edges")
    before = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .filter("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").filter("v <> m") \
            .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")) \
            .unionByName(root.withColumnRenamed("m", "v"))
        e = materialize(small.distinct(), "edges")
        after = _state(e)
        if after == before:
            break
        before = after
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return stars.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
