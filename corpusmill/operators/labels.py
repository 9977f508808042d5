"""Label tables and statistics.

Labels are a long table ``doc_labels(doc_id, level, label, section)`` with
level 1 = section, 2 = class, 3 = subclass.  The level is carried as a
column, never inferred from the label's string length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL_NAMES = {1: "section", 2: "class", 3: "subclass"}


def expand_ipc(records: DataFrame, id_col: str = "id",
               ipc_col: str = "classification-ipc", sep: str = "-") -> DataFrame:
    """IPC structs -> distinct (doc_id, level, label, section) rows with
    labels ``S``, ``S-CC``, ``S-CC-X`` (joined by ``sep``)."""
    e = records.select(F.col(id_col).alias("doc_id"), F.explode(F.col(f"`{ipc_col}`")).alias("c"))
    sec, cls, sub = F.col("c.section"), F.col("c.class"), F.col("c.subclass")
    lv = F.explode(F.array(
        F.struct(F.lit(1).alias("level"), sec.alias("label")),
        F.struct(F.lit(2).alias("level"), F.concat_ws(sep, sec, cls).alias("label")),
        F.struct(F.lit(3).alias("level"), F.concat_ws(sep, sec, cls, sub).alias("label"))))
    return (e.select("doc_id", sec.alias("section"), lv.alias("l"))
            .select("doc_id", "l.level", "l.label", "section").distinct())


def concatenated_keys(records: DataFrame, id_col: str = "id",
                      ipc_col: str = "classification-ipc") -> DataFrame:
    """sorted distinct ``section+class+subclass`` keys per document."""
    e = records.select(F.col(id_col).alias("doc_id"), F.explode(F.col(f"`{ipc_col}`")).alias("c"))
    return e.groupBy("doc_id").agg(F.array_sort(F.collect_set(
        F.concat("c.section", "c.class", "c.subclass"))).alias("keys"))


def at_level(doc_labels: DataFrame, level: int) -> DataFrame:
    """the labels of one level."""
    return doc_labels.filter(F.col("level") == level)



def label_counts(doc_labels: DataFrame, n: Column) -> DataFrame:
    """A5: (level, label, n_docs, share of the corpus)."""
    return (doc_labels.groupBy("level", "label")
            .agg(F.countDistinct("doc_id").alias("n_docs"))
            .withColumn("share", F.col("n_docs") / n))


def cooccurrence(doc_labels: DataFrame, level: int = 1) -> DataFrame:
    """(label_a, label_b, n_docs) over documents holding both; the
    diagonal is the label's own count.

    Documents are first grouped by their label set (at most 2^|labels|
    sets, far fewer in practice) and pairs are expanded per set, so the
    pair expansion never runs per document."""
    sets = (at_level(doc_labels, level).groupBy("doc_id")
            .agg(F.array_sort(F.collect_set("label")).alias("ls"))
            .groupBy("ls").agg(F.count(F.lit(1)).alias("n")))
    pairs = sets.select(
        "n", F.explode(F.flatten(F.transform(
            "ls", lambda a: F.transform("ls", lambda b: F.struct(a.alias("a"), b.alias("b")))))
        ).alias("p"))
    return (pairs.groupBy(F.col("p.a").alias("label_a"), F.col("p.b").alias("label_b"))
            .agg(F.sum("n").alias("n_docs")))


def sublabels_per_section(doc_labels: DataFrame) -> DataFrame:
    """Number of distinct classes and subclasses under each section."""
    return (doc_labels.filter(F.col("level") > 1)
            .groupBy("section", "level").agg(F.countDistinct("label").alias("n_labels")))


def label_size_stats(doc_labels: DataFrame) -> DataFrame:
    """Per (section, level) summary of label sizes (documents per label):
    mean, median, min, max, population std, labels below 3 and below 2."""
    sizes = (doc_labels.filter(F.col("level") > 1)
             .groupBy("section", "level", "label").agg(F.countDistinct("doc_id").alias("size")))
    return sizes.groupBy("section", "level").agg(
        F.avg("size").alias("mean_size"),
        F.median("size").alias("median_size"),
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
        F.stddev_pop("size").alias("std_size"),
        F.count_if(F.col("size") < 3).alias("n_below_3"),
        F.count_if(F.col("size") < 2).alias("n_below_2"))


def multilabel_docs(doc_labels: DataFrame) -> DataFrame:
    """Per level, documents with more than one label and all labelled
    documents."""
    per_doc = doc_labels.groupBy("level", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return per_doc.groupBy("level").agg(
        F.count_if(F.col("k") > 1).alias("n_multi"),
        F.count(F.lit(1)).alias("n_docs"))


def exact_size_labels(doc_labels: DataFrame, size: int = 2) -> DataFrame:
    """A10: labels with exactly ``size`` documents."""
    return (doc_labels.groupBy("level", "label").agg(F.countDistinct("doc_id").alias("n_docs"))
            .filter(F.col("n_docs") == size))


def facet_rollup(paths: DataFrame) -> DataFrame:
    """Document counts of section > class > subclass plus subtotals
    (``rollup``).  ``paths`` has (doc_id, section, class, subclass)."""
    return paths.rollup("section", "class", "subclass").agg(
        F.countDistinct("doc_id").alias("n_docs"))


def valid_labels(doc_labels: DataFrame, min_docs: int = 3) -> DataFrame:
    """labels with at least ``min_docs`` documents."""
    return (doc_labels.groupBy("level", "label").agg(F.countDistinct("doc_id").alias("n_docs"))
            .filter(F.col("n_docs") >= min_docs))


def unlabelled_docs(docs: DataFrame, doc_labels: DataFrame, valid: DataFrame,
                    level: int) -> DataFrame:
    """documents left with no label once labels of ``level`` are
    restricted to ``valid`` (left anti join)."""
    kept = at_level(doc_labels, level).join(
        valid.filter(F.col("level") == level).select("label"), "label", "left_semi")
    return docs.select("doc_id").join(kept.select("doc_id"), "doc_id", "left_anti")


def docs_per_label(doc_labels: DataFrame, docs_subset: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of each label restricted to a document subset; labels
    left without documents are kept with an empty list count of 0."""
    sub = doc_labels.join(docs_subset.select("doc_id"), "doc_id", "left_semi")
    counts = sub.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"))
    return labels.select("label").join(counts, "label", "left").fillna(0, ["n_docs"])
