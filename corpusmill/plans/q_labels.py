"""Queries over the label tables (both mappings of FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import labels as L
from corpusmill.plans import fixtures as fx
from corpusmill.plans import sql as q
from corpusmill.plans.registry import query

ROUND = 6
MIN_LABEL_DOCS = 3


def _n_orders(spark, sf_dir):
    dl = fx.doc_labels_multi(spark, sf_dir)
    return dl, dl.filter(F.col("level") == 1).select(F.countDistinct("doc_id")).scalar()


@query("label_counts", f"""WITH {q.DOC_LABELS_MULTI},
n AS (SELECT count(DISTINCT doc_id) AS n FROM doc_labels WHERE level = 1)
SELECT level, label, count(DISTINCT doc_id) AS n_docs, round(count(DISTINCT doc_id) / n.n, 6) AS share
FROM doc_labels, n GROUP BY level, label, n.n""")
def label_counts(spark, sf_dir):
    dl, n = _n_orders(spark, sf_dir)
    return L.label_counts(dl, n).withColumn("share", F.round("share", ROUND))


@query("label_overlap", f"""WITH {q.DOC_LABELS_MULTI},
s AS (SELECT doc_id, label FROM doc_labels WHERE level = 1)
SELECT a.label AS label_a, b.label AS label_b, count(*) AS n_docs
FROM s a JOIN s b USING (doc_id) GROUP BY a.label, b.label""")
def label_overlap(spark, sf_dir):
    return L.cooccurrence(fx.doc_labels_multi(spark, sf_dir), level=1)


@query("sublabels_per_section", f"""WITH {q.DOC_LABELS_MULTI}
SELECT section, level, count(DISTINCT label) AS n_labels FROM doc_labels WHERE level > 1
GROUP BY section, level""")
def sublabels_per_section(spark, sf_dir):
    return L.sublabels_per_section(fx.doc_labels_multi(spark, sf_dir))


@query("label_size_stats", f"""WITH {q.DOC_LABELS_MULTI},
sizes AS (SELECT section, level, label, count(DISTINCT doc_id) AS size FROM doc_labels
          WHERE level > 1 GROUP BY section, level, label)
SELECT section, level, round(avg(size), 6) AS mean_size,
       round(quantile_cont(size, 0.5), 6) AS median_size,
       min(size) AS min_size, max(size) AS max_size,
       round(stddev_pop(size), 6) AS std_size,
       count(*) FILTER (WHERE size < 3) AS n_below_3,
       count(*) FILTER (WHERE size < 2) AS n_below_2
FROM sizes GROUP BY section, level""")
def label_size_stats(spark, sf_dir):
    s = L.label_size_stats(fx.doc_labels_multi(spark, sf_dir))
    for c in ("mean_size", "median_size", "std_size"):
        s = s.withColumn(c, F.round(F.col(c).cast("double"), ROUND))
    return s


@query("multilabel_docs", f"""WITH {q.DOC_LABELS_MULTI},
k AS (SELECT level, doc_id, count(*) AS k FROM doc_labels GROUP BY level, doc_id)
SELECT level, count(*) FILTER (WHERE k > 1) AS n_multi, count(*) AS n_docs FROM k GROUP BY level""")
def multilabel_docs(spark, sf_dir):
    return L.multilabel_docs(fx.doc_labels_multi(spark, sf_dir))


@query("facet_rollup", f"""WITH {q.LABEL_PATHS_MULTI}
SELECT section, class, subclass, count(DISTINCT doc_id) AS n_docs
FROM paths GROUP BY ROLLUP (section, class, subclass)""")
def facet_rollup(spark, sf_dir):
    return L.facet_rollup(fx.label_paths_multi(spark, sf_dir))


@query("valid_labels", f"""WITH {q.DOC_LABELS_MULTI}
SELECT level, label, count(DISTINCT doc_id) AS n_docs FROM doc_labels
GROUP BY level, label HAVING count(DISTINCT doc_id) >= {MIN_LABEL_DOCS}""")
def valid_labels(spark, sf_dir):
    return L.valid_labels(fx.doc_labels_multi(spark, sf_dir), MIN_LABEL_DOCS)


@query("min_size_labels", f"""WITH {q.DOC_LABELS_SINGLE}
SELECT level, label, count(DISTINCT doc_id) AS n_docs FROM doc_labels
GROUP BY level, label HAVING count(DISTINCT doc_id) = 2""")
def min_size_labels(spark, sf_dir):
    """A10: labels with exactly two documents."""
    return L.exact_size_labels(fx.doc_labels_single(spark, sf_dir), 2)


@query("unlabelled_docs", f"""WITH {q.DOC_LABELS_SINGLE},
valid AS (SELECT label FROM doc_labels WHERE level = 3 GROUP BY label
          HAVING count(DISTINCT doc_id) >= {MIN_LABEL_DOCS}),
kept AS (SELECT DISTINCT doc_id FROM doc_labels WHERE level = 3 AND label IN (SELECT label FROM valid))
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM kept)""")
def unlabelled_docs(spark, sf_dir):
    dl = fx.doc_labels_single(spark, sf_dir)
    valid = L.valid_labels(dl, MIN_LABEL_DOCS)
    return L.unlabelled_docs(fx.corpus(spark, sf_dir), dl, valid, level=3)


@query("label_keys", """
SELECT l_orderkey AS doc_id,
       array_to_string(list_sort(list(DISTINCT p.p_type || p.p_brand || CAST(p.p_size AS VARCHAR))), ',') AS keys
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l_orderkey""")
def label_keys(spark, sf_dir):
    """sorted distinct concatenated class keys per document."""
    from corpusmill.sources.io import table
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    ipc = F.struct(F.col("p_type").alias("section"), F.col("p_brand").alias("class"),
                   F.col("p_size").cast("string").alias("subclass"))
    recs = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("id"), F.array(ipc).alias("classification-ipc"))
    return L.concatenated_keys(recs).select("doc_id", F.array_join("keys", ",").alias("keys"))


@query("class_weights", f"""WITH {q.DOC_LABELS_MULTI},
n AS (SELECT count(DISTINCT doc_id) AS n FROM doc_labels),
c AS (SELECT label, count(DISTINCT doc_id) AS n_pos FROM doc_labels WHERE level = 1 GROUP BY label)
SELECT label, n_pos, round(n.n / (2.0 * n_pos), 6) AS w_pos, round(n.n / (2.0 * (n.n - n_pos)), 6) AS w_neg
FROM c, n""")
def class_weights(spark, sf_dir):
    """L2: balanced one-vs-rest class weights N / (2 n_class) per section."""
    dl = fx.doc_labels_multi(spark, sf_dir)
    n = dl.select(F.countDistinct("doc_id")).scalar()
    c = dl.filter(F.col("level") == 1).groupBy("label").agg(F.countDistinct("doc_id").alias("n_pos"))
    return c.select("label", "n_pos",
                    F.round(n / (2.0 * F.col("n_pos")), ROUND).alias("w_pos"),
                    F.round(n / (2.0 * (n - F.col("n_pos"))), ROUND).alias("w_neg"))


@query("date_range", """SELECT min(o_orderdate) AS first_date, max(o_orderdate) AS last_date,
       count(*) AS n_docs FROM orders""")
def date_range(spark, sf_dir):
    """First and last document date (order dates stand in for patent
    dates)."""
    from corpusmill.sources.io import table
    o = table(spark, sf_dir, "orders")
    return o.agg(F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"),
                 F.count(F.lit(1)).alias("n_docs"))
