"""Skew-safe ranking primitives shared by sampling, splits and top-k.

A plain ``row_number() OVER (PARTITION BY g ORDER BY x)`` sends a whole group
to one task.  If one label or document holds a third of all rows that task
holds a third of the data.  The helpers here split every group further and
then stitch the pieces back together exactly:

* :func:`rank_in_group` orders rows by a seeded hash.  Rows are bucketed by
  the hash prefix, the small (group, bucket) count table gives each bucket an
  offset, and the row number inside (group, bucket) plus the offset is the
  exact rank within the group.
* :func:`top_k` keeps the k best rows per group in two rounds: first per
  (group, salt), then per group over at most ``salts * k`` survivors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_hash(seed, *cols) -> Column:
    """Deterministic pseudo-random order key: md5 hex of ``seed:col1:col2``.

    md5 exists in Spark and DuckDB with the same output, which lets the
    oracle reproduce every draw."""
    parts = [F.lit(str(seed))]
    for c in cols:
        parts += [F.lit(":"), F.col(c).cast("string") if isinstance(c, str) else c.cast("string")]
    return F.md5(F.concat(*parts))


def rank_in_group(df: DataFrame, group_cols, hash_col: str, tie_col: str,
                  rank_col: str = "rank", prefix_len: int = 4) -> DataFrame:
    """Add the 1-based rank of each row in its group by (hash, tie).

    Exact for any group size; no task sees more than one (group, hash
    prefix) bucket.  ``group_cols`` may be empty for a global order."""
    group_cols = list(group_cols)
    bucket = F.substring(F.col(hash_col), 1, prefix_len)
    b = "__bucket"
    with_b = df.withColumn(b, bucket)
    counts = with_b.groupBy(*group_cols, b).agg(F.count(F.lit(1)).alias("__n"))
    w_off = Window.orderBy(b) if not group_cols else Window.partitionBy(*group_cols).orderBy(b)
    offsets = counts.withColumn(
        "__off",
        F.coalesce(F.sum("__n").over(w_off.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0))).drop("__n")
    w_in = Window.partitionBy(*group_cols, b).orderBy(F.col(hash_col), F.col(tie_col))
    ranked = with_b.withColumn("__rn", F.row_number().over(w_in))
    return (ranked.join(offsets, group_cols + [b])
            .withColumn(rank_col, (F.col("__rn") + F.col("__off")).cast("long"))
            .drop("__rn", "__off", b))


def top_k(df: DataFrame, group_cols, order_cols, k: int, salt_cols,
          salts: int = 32, rank_col: str = "rank") -> DataFrame:
    """Exact top-k rows per group ordered by ``order_cols`` (Columns).

    ``salt_cols`` must identify the row within the group (they feed the salt
    and should also end ``order_cols`` so the order is total)."""
    group_cols = list(group_cols)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(salts))
    w1 = Window.partitionBy(*group_cols, "__salt").orderBy(*order_cols)
    first = (df.withColumn("__salt", salt)
             .withColumn("__r1", F.row_number().over(w1))
             .filter(F.col("__r1") <= k).drop("__r1", "__salt"))
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return (first.withColumn(rank_col, F.row_number().over(w2))
            .filter(F.col(rank_col) <= k))
