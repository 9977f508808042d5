"""Operator 9: sharding by best-fit-decreasing bin packing.

Rows with equal texts are one indivisible group; a group's size is the sum of
its rows' sizes (UTF-8 bytes plus a fixed overhead).  Groups are packed into
``shards`` bins of equal capacity, largest first, each into the bin with the
tightest remaining capacity that still holds it (a sorted list of the free
capacities, searched by bisection).  The capacity starts at the mean and grows
in small steps until everything fits, so shards end nearly equal.

Packing runs on a bounded number of parcels, whatever the number of rows: a
group larger than ``total / (shards * parcels)`` is a parcel of its own (there
are fewer than ``shards * parcels`` of them), and smaller groups are put
together by text hash into ``shards * parcels`` parcels.  The plan is at
most ``2 * shards * parcels`` numbers.  Everything else (sizes, groups,
slots) is a join or aggregate.  A group of a third of all rows is one parcel and
pre-aggregated in each task.

Slots are ranks inside a shard by a hash of (id, text).  A shard's rows are
spread over hash buckets, so no task sees a whole shard.

Defined cases: a null text has size ``overhead`` and equals the empty text;
repeated rows get slots of their own; null ids sort first; an empty table gives
no rows.  Groups larger than the mean make their shard that large.  Only
the named columns are read.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import text_of
from corpusmill.operators.ranking import rank_in_group
from corpusmill.session import materialize


def best_fit(sizes: list[tuple[int, int]], bins: int, capacity: int) -> dict[int, int] | None:
    """``{parcel: bin}`` for (size, parcel) pairs, or None if they do not fit."""
    free = [(capacity, b) for b in range(bins)]        # ascending
    out = {}
    for size, parcel in sorted(sizes, key=lambda x: (-x[0], x[1])):
        at = bisect.bisect_left(free, (size, -1))
        if at == len(free):
            return None
        left, b = free.pop(at)
        bisect.insort(free, (left - size, b))
        out[parcel] = b
    return out


def pack(sizes: list[tuple[int, int]], bins: int, step: float = 0.0001) -> dict[int, int]:
    """Best fit decreasing at the least tried capacity that holds everything."""
    if not sizes:
        return {}
    total = sum(s for s, _ in sizes)
    capacity = max(-(-total // bins), max(s for s, _ in sizes))
    while (found := best_fit(sizes, bins, capacity)) is None:
        capacity += max(1, int(capacity * step))
    return found


def shard_by_size(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text: str = "text",
                  overhead: int = 8, parcels: int = 512) -> DataFrame:
    """Per row of ``docs``: id, size, text_crc32, shard and slot."""
    spark = docs.sparkSession
    t = text_of(F.col(text))
    rows = materialize(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(t) + overhead).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"), F.md5(t.cast("binary")).alias("key")), "sizes")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    total = groups.agg(F.sum("size")).first()[0]
    n = shards * parcels
    big = F.col("size") * n > F.lit(total or 0)
    # at most n large groups (each more than 1/n of the total) and n parcels
    large = groups.filter(big).select("key", "size").collect()
    small = groups.filter(~big).groupBy(F.pmod(F.xxhash64("key"), F.lit(n)).alias("parcel")) \
        .agg(F.sum("size").alias("size")).collect()
    plan = pack([(r["size"], r["parcel"]) for r in small] +
                [(r["size"], n + i) for i, r in enumerate(large)], shards)
    schema = T.StructType([T.StructField("parcel", T.LongType()), T.StructField("key", T.StringType()),
                           T.StructField("shard", T.IntegerType())])
    named = spark.createDataFrame([(None, r["key"], plan[n + i]) for i, r in enumerate(large)], schema) \
        .select("key", F.col("shard").alias("own"))
    parcel = spark.createDataFrame([(r["parcel"], None, plan[r["parcel"]]) for r in small], schema) \
        .select("parcel", F.col("shard").alias("shared"))
    placed = rows.join(named, "key", "left") \
        .withColumn("parcel", F.pmod(F.xxhash64("key"), F.lit(n))).join(parcel, "parcel", "left") \
        .select("id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"),
                F.md5(F.concat_ws(":", F.col("id").cast("string"), "key")).alias("h"))
    ranked = rank_in_group(materialize(placed, "placed"), ["shard"], "h", "id", rank_col="slot")
    return ranked.select("id", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"))
