"""Feature selection by chi-squared.

The reference scores every (term, subclass) pair.  With n11 the joint count,
d = df(term), s = |class| and N documents, the pair's weighted value
``Pc1 * N (P11 P00 - P10 P01)^2 / (Pt1 Pt0 Pc1 Pc0)`` reduces to
``N (n11/N - d s / N^2)^2 / (Pt1 Pt0 Pc0)``.  Expanding the square:

    chi(t) = N / (Pt1 Pt0) * ( sum over classes with n11 > 0 of
                 ((n11/N)^2 - 2 (n11/N)(d/N)(s/N)) / (1 - s/N)
               + (d/N)^2 * K ),     K = sum over all classes of (s/N)^2 / (1 - s/N)

so only (term, class) pairs that co-occur are ever formed (postings joined
to labels), and K is one scalar for the corpus.  Classes that cover every
document (1 - s/N = 0) have an undefined value and are skipped, as are terms
with df = N (filtered before, F5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import materialize


def class_sizes(doc_labels: DataFrame) -> DataFrame:
    """(label, s): documents per label."""
    return doc_labels.groupBy("label").agg(F.countDistinct("doc_id").alias("s"))


def chi_squared(postings: DataFrame, dfreq: DataFrame, doc_labels: DataFrame,
                n: Column, on: str = "doc_id", sizes: DataFrame | None = None) -> DataFrame:
    """(term, df, chi) for every term of ``dfreq`` with 0 < df < N.

    ``on`` names the column that postings and labels share, where that is not the document; ``sizes`` are then the
    :func:`class_sizes`."""
    sizes = (class_sizes(doc_labels) if sizes is None else sizes).filter(F.col("s") < n)
    pc = F.col("s") / n
    k_const = sizes.select(F.sum(pc * pc / (F.lit(1.0) - pc))).scalar()
    joint = (postings.select("term", on)
             .join(doc_labels.select(on, "label"), on)
             .groupBy("term", "label").agg(F.count(F.lit(1)).alias("n11")))
    p11 = F.col("n11") / n
    pt1 = F.col("df") / n
    pair = (p11 * p11 - F.lit(2.0) * p11 * pt1 * pc) / (F.lit(1.0) - pc)
    s1 = (joint.join(sizes, "label")
          .join(dfreq.select("term", "df"), "term")
          .groupBy("term").agg(F.sum(pair).alias("s1")))
    terms = dfreq.filter((F.col("df") > 0) & (F.col("df") < n))
    pt1 = F.col("df") / n
    chi = n / (pt1 * (F.lit(1.0) - pt1)) * (F.coalesce(F.col("s1"), F.lit(0.0)) + pt1 * pt1 * k_const)
    return terms.join(s1, "term", "left").select("term", "df", chi.alias("chi"))


def chi_squared_old(dfreq: DataFrame, doc_labels: DataFrame, n: Column) -> DataFrame:
    """Sum over classes of (Nt1-E1)^2/E1 + (Nt0-E0)^2/E0 with expected
    counts from the marginals only.  Algebraically each class contributes
    (N - s)^2 / s whatever the term (for 0 < df < N), so the score is one
    corpus constant: the old formula ranks nothing."""
    sizes = class_sizes(doc_labels)
    const = sizes.select(F.sum((n - F.col("s")) * (n - F.col("s")) / F.col("s"))).scalar()
    return (dfreq.filter((F.col("df") > 0) & (F.col("df") < n))
            .select("term", "df", const.alias("chi")))


def top_terms(scores: DataFrame, n_top: int, score_col: str = "chi",
              decimals: int = 6) -> DataFrame:
    """K1: the ``n_top`` best terms (TakeOrderedAndProject, no full sort),
    ties broken by term; rank is 1-based.  Scores are rounded before
    ordering so equal values tie deterministically."""
    key = F.round(F.col(score_col), decimals)
    best = scores.withColumn("__key", key).orderBy(F.desc("__key"), F.asc("term")).limit(n_top)
    # n_top rows only: a single-partition window is bounded by the limit
    w = Window.orderBy(F.desc("__key"), F.asc("term"))
    return best.withColumn("rank", F.row_number().over(w)).drop("__key")


def term_dictionary(best: DataFrame) -> DataFrame:
    """Dense ids 0..n-1 in rank order (bijective, as required)."""
    return best.select("term", (F.col("rank") - 1).cast("int").alias("term_id"))


def reorder_by_total_weight(weights: DataFrame, decimals: int = 6) -> DataFrame:
    """K6: new 0-based term id by descending total weight (ties by term).

    The per-term totals are ranked with :func:`global_rank`, a
    range-partitioned sort, so no single task orders the whole vocabulary."""
    totals = weights.groupBy("term").agg(F.round(F.sum("weight"), decimals).alias("total"))
    return global_rank(totals, [F.desc("total"), F.asc("term")], "term_id", start=0)


def global_rank(df: DataFrame, order_cols, rank_col: str, start: int = 1) -> DataFrame:
    """Dense 0/1-based position of each row in a total order, without a
    single-partition window: range-partitioned sort, per-partition counts,
    prefix offsets over the partition count table, row number inside each
    partition.  The rows are stored with their partition number, so counts and
    ranks come from the same partitions whatever other columns there are."""
    with_pid = materialize(df.orderBy(*order_cols).withColumn("__pid", F.spark_partition_id()), "ranked")
    counts = with_pid.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offs = counts.withColumn(
        "__off", F.coalesce(F.sum("__n").over(
            Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("__pid").orderBy(*order_cols)
    return (with_pid.withColumn("__rn", F.row_number().over(w))
            .join(offs.select("__pid", "__off"), "__pid")
            .withColumn(rank_col, (F.col("__rn") + F.col("__off") + (start - 1)).cast("long"))
            .drop("__pid", "__rn", "__off"))
