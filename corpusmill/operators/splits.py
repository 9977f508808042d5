"""Stratified splits and samples.

Random draws are replaced by a seeded md5 order (see
:func:`corpusmill.operators.ranking.seeded_hash`): a document's position
inside its group depends only on (seed, doc_id), so every draw is
reproducible and can be checked by SQL.  All per-group ranks use the
skew-safe :func:`rank_in_group`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ranking import rank_in_group, seeded_hash

# Fixed values of the reference's split and sample procedures.
TEST_SET_PERCENTAGE = 0.2
VALIDATION_IN_TRAINING_PERCENTAGE = 0.2
MIN_DOCUMENTS_FOR_TEST = 1
MIN_DOCUMENTS_FOR_VALIDATION = 1
TRAIN_MIN, VAL_MIN, TEST_MIN = 0.3, 0.15, 0.15
BALANCED_SHARE = 0.155


def _quota(n: Column, pct: float, minimum: int) -> Column:
    """int(n * pct), or ``minimum`` when that is 0 and minimum < n, else 0."""
    base = F.floor(n * F.lit(float(pct))).cast("long")
    return F.when(base > 0, base).when(F.lit(minimum) < n, F.lit(minimum)).otherwise(F.lit(0)).cast("long")


def first_labels(doc_labels: DataFrame) -> DataFrame:
    """(doc_id, first_label): the first label of each document in the fixed
    visiting order (level, then label text)."""
    return (doc_labels.groupBy("doc_id")
            .agg(F.min(F.struct("level", "label")).alias("f"))
            .select("doc_id", F.col("f.label").alias("first_label")))


def split_assign(doc_labels: DataFrame, seed: int = 10000,
                 test_pct: float = TEST_SET_PERCENTAGE,
                 val_pct: float = VALIDATION_IN_TRAINING_PERCENTAGE) -> DataFrame:
    """Closed form of the greedy stratified split.

    Visiting labels in a fixed order and taking only not-yet-assigned
    documents means each document is settled by its first-visited label.
    Inside that label's group: test = int(20%) (or 1 if more than one
    document), validation = int(20% of the rest) (or 1), the rest train; the
    seeded order decides which documents."""
    fl = first_labels(doc_labels).withColumn("h", seeded_hash(seed, "doc_id"))
    sizes = fl.groupBy("first_label").agg(F.count(F.lit(1)).alias("n"))
    n_test = _quota(F.col("n"), test_pct, MIN_DOCUMENTS_FOR_TEST)
    rest = F.col("n") - F.col("n_test")
    sizes = (sizes.withColumn("n_test", n_test)
             .withColumn("n_val", _quota(rest, val_pct, MIN_DOCUMENTS_FOR_VALIDATION)))
    ranked = rank_in_group(fl, ["first_label"], "h", "doc_id")
    split = (F.when(F.col("rank") <= F.col("n_test"), F.lit("test"))
             .when(F.col("rank") <= F.col("n_test") + F.col("n_val"), F.lit("validation"))
             .otherwise(F.lit("train")))
    return ranked.join(sizes, "first_label").select("doc_id", "first_label", split.alias("split"))


def label_split_counts(doc_labels: DataFrame, splits: DataFrame) -> DataFrame:
    """Per label, documents in each split and in total."""
    j = doc_labels.select("doc_id", "level", "label").join(splits.select("doc_id", "split"), "doc_id")
    return j.groupBy("level", "label").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "validation").alias("n_validation"),
        F.count_if(F.col("split") == "test").alias("n_test"))


def split_problems(counts: DataFrame, train_min: float = TRAIN_MIN,
                   val_min: float = VAL_MIN, test_min: float = TEST_MIN) -> DataFrame:
    """Labels whose train share < 0.3, validation < 0.15 or test < 0.15."""
    tr = F.col("n_train") / F.col("n_docs")
    va = F.col("n_validation") / F.col("n_docs")
    te = F.col("n_test") / F.col("n_docs")
    return (counts.withColumn("train_problem", tr < train_min)
            .withColumn("val_problem", va < val_min)
            .withColumn("test_problem", te < test_min)
            .filter(F.col("train_problem") | F.col("val_problem") | F.col("test_problem")))


def split_divergence(doc_labels: DataFrame, splits: DataFrame, n: Column,
                     split: str = "train") -> DataFrame:
    """A label's share of the corpus against its share of one split."""
    in_split = splits.filter(F.col("split") == split).select("doc_id")
    n_split = in_split.select(F.count(F.lit(1))).scalar()
    j = doc_labels.select("doc_id", "level", "label").join(
        in_split.withColumn("__in", F.lit(1)), "doc_id", "left")
    return (j.groupBy("level", "label")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.count("__in").alias("n_split"))
            .withColumn("share_corpus", F.col("n_docs") / n)
            .withColumn("share_split", F.col("n_split") / n_split))


def sample_per_label(doc_labels: DataFrame, pct: float, minimum: int,
                     seed: int = 10000) -> DataFrame:
    """Per label, int(n*pct) documents (``minimum`` if that is 0) when
    n > minimum, else all of them; the union of all draws, distinct."""
    dl = doc_labels.select("doc_id", "label").withColumn("h", seeded_hash(seed, "label", "doc_id"))
    sizes = dl.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    base = F.floor(F.col("n") * F.lit(float(pct))).cast("long")
    k = (F.when(F.col("n") > minimum, F.when(base > 0, base).otherwise(F.lit(minimum)))
         .otherwise(F.col("n")))
    ranked = rank_in_group(dl, ["label"], "h", "doc_id")
    return (ranked.join(sizes.withColumn("k", k), "label")
            .filter(F.col("rank") <= F.col("k")).select("doc_id").distinct())


def balanced_sample(doc_labels: DataFrame, splits: DataFrame, minimum: int,
                    share: float = BALANCED_SHARE, seed: int = 10000) -> DataFrame:
    """Per (label, split): max(minimum, int(n*share)) documents when
    n > minimum, else all; distinct (doc_id, split)."""
    dl = (doc_labels.select("doc_id", "label").join(splits.select("doc_id", "split"), "doc_id")
          .withColumn("h", seeded_hash(seed, "label", "doc_id")))
    sizes = dl.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))
    k = F.when(F.col("n") > minimum,
               F.greatest(F.lit(minimum), F.floor(F.col("n") * F.lit(share)).cast("long"))) \
        .otherwise(F.col("n"))
    ranked = rank_in_group(dl, ["label", "split"], "h", "doc_id")
    return (ranked.join(sizes.withColumn("k", k), ["label", "split"])
            .filter(F.col("rank") <= F.col("k")).select("doc_id", "split").distinct())


def heldout_sample(doc_labels: DataFrame, training: DataFrame, viable: DataFrame,
                   per_label: int = 300, seed: int = 10000) -> DataFrame:
    """Up to ``per_label`` documents per viable label drawn from
    documents not in training (left anti join), distinct."""
    cand = (doc_labels.select("doc_id", "label")
            .join(viable.select("label"), "label", "left_semi")
            .join(training.select("doc_id"), "doc_id", "left_anti")
            .withColumn("h", seeded_hash(seed, "label", "doc_id")))
    ranked = rank_in_group(cand, ["label"], "h", "doc_id")
    return ranked.filter(F.col("rank") <= per_label).select("doc_id", "label")


def single_label_sample(doc_labels: DataFrame, per_label: int, level: int = 1,
                        seed: int = 10000) -> DataFrame:
    """P10: documents with exactly one label at ``level``; up to
    ``per_label`` of them per label."""
    lv = doc_labels.filter(F.col("level") == level)
    single = (lv.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.min("label").alias("label"))
              .filter(F.col("k") == 1).select("doc_id", "label")
              .withColumn("h", seeded_hash(seed, "doc_id")))
    ranked = rank_in_group(single, ["label"], "h", "doc_id")
    return ranked.filter(F.col("rank") <= per_label).select("doc_id", "label")


def shuffled_batches(docs: DataFrame, batch_size: int, seed: int = 10000) -> DataFrame:
    """A seeded global shuffle and the batch number of each row."""
    d = docs.select("doc_id").withColumn("h", seeded_hash(seed, "doc_id"))
    ranked = rank_in_group(d, [], "h", "doc_id", rank_col="position")
    return ranked.select("doc_id", "position",
                         F.floor((F.col("position") - 1) / batch_size).cast("long").alias("batch"))


def coin_split(docs: DataFrame, seed: int) -> DataFrame:
    """Seeded coin flip between test and validation."""
    h = seeded_hash(seed, "doc_id")
    bit = F.conv(F.substring(h, 1, 1), 16, 10).cast("int") % 2
    return docs.select("doc_id", F.when(bit == 0, "test").otherwise("validation").alias("split"))


def proportional_sample(doc_labels: DataFrame, ratio: float, seed: int = 10000) -> DataFrame:
    """ceil(ratio * n) documents of every label, seeded order."""
    dl = doc_labels.select("doc_id", "label").withColumn("h", seeded_hash(seed, "label", "doc_id"))
    sizes = dl.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ranked = rank_in_group(dl, ["label"], "h", "doc_id")
    k = F.ceil(F.col("n") * F.lit(float(ratio))).cast("long")
    return (ranked.join(sizes, "label").filter(F.col("rank") <= k).select("doc_id", "label"))
