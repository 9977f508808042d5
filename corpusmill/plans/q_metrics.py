"""Queries over the sparse section predictions of the order mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import metrics as M
from corpusmill.plans import fixtures as fx
from corpusmill.plans import sql as q
from corpusmill.plans.registry import query
from corpusmill.session import materialize

ROUND = 6


def _preds(spark, sf_dir):
    # the prediction table is a pipeline stage (classifier output): stored
    # once, then read by every branch of the metric plan
    p = materialize(M.with_pred(fx.predictions_multi(spark, sf_dir), 0.0), "predictions")
    n = p.select(F.countDistinct("doc_id")).scalar()
    return p, fx.section_universe(spark, sf_dir), n


def _rounded(df, cols):
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), ROUND))
    return df


RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label DESC) AS rank FROM preds)"""

COUNTS = """cnt AS (
  SELECT u.label,
         coalesce(sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END), 0) AS tp,
         coalesce(sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END), 0) AS fp,
         coalesce(sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END), 0) AS fn
  FROM universe u LEFT JOIN preds p USING (label) GROUP BY u.label),
cnt2 AS (SELECT label, tp, fp, fn, nd.n - tp - fp - fn AS tn FROM cnt, nd)"""


def _div0(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


PER_LABEL = f"""per_label AS (
  SELECT label, tp, fp, fn, tn,
         {_div0('tp + tn', 'tp + fp + fn + tn')} AS accuracy,
         {_div0('tp', 'tp + fp')} AS precision, {_div0('tp', 'tp + fn')} AS recall,
         {_div0('2 * tp', '2 * tp + fp + fn')} AS f1 FROM cnt2)"""


@query("predictions", f"WITH {q.PREDS_MULTI} SELECT doc_id, label, y_true, score, y_pred FROM preds")
def predictions(spark, sf_dir):
    """the evaluated prediction table with binarized scores."""
    return _preds(spark, sf_dir)[0]


@query("topn_share", f"""WITH {q.PREDS_MULTI}, {RANKED},
nt AS (SELECT doc_id, sum(y_true) AS n_true FROM preds GROUP BY doc_id)
SELECT round(avg(CASE WHEN rank <= greatest(1, n_true) THEN 1.0 ELSE 0.0 END), 6) AS top_1,
       round(avg(CASE WHEN rank <= greatest(3, n_true) THEN 1.0 ELSE 0.0 END), 6) AS top_3,
       round(avg(CASE WHEN rank <= greatest(5, n_true) THEN 1.0 ELSE 0.0 END), 6) AS top_5
FROM ranked JOIN nt USING (doc_id) WHERE y_true = 1""")
def topn_share(spark, sf_dir):
    p, _, _ = _preds(spark, sf_dir)
    return _rounded(M.topn_share(p), ["top_1", "top_3", "top_5"])


@query("coverage_error", f"""WITH {q.PREDS_MULTI},
mt AS (SELECT doc_id, min(score) AS m FROM preds WHERE y_true = 1 GROUP BY doc_id),
cv AS (SELECT doc_id, count(*) FILTER (WHERE score >= m) AS cov FROM preds JOIN mt USING (doc_id) GROUP BY doc_id)
SELECT round(sum(cov) / (SELECT n FROM nd), 6) AS coverage_error,
       (SELECT round(sum(y_true) / (SELECT n FROM nd), 2) FROM preds) AS average_num_of_labels FROM cv""")
def coverage_error(spark, sf_dir):
    p, _, n = _preds(spark, sf_dir)
    cov = M.coverage_error(p, n)
    avg = M.average_labels(p, n).select("average_num_of_labels").scalar()
    return cov.select(F.round("coverage_error", ROUND).alias("coverage_error"),
                      avg.alias("average_num_of_labels"))


@query("prf_micro", f"""WITH {q.PREDS_MULTI},
t AS (SELECT count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp,
             count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
             count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn,
             sum(y_pred) AS total_positive FROM preds)
SELECT tp, fp, fn, total_positive, round({_div0('tp', 'tp + fp')}, 6) AS precision_micro,
       round({_div0('tp', 'tp + fn')}, 6) AS recall_micro,
       round({_div0('2 * tp', '2 * tp + fp + fn')}, 6) AS f1_micro FROM t""")
def prf_micro(spark, sf_dir):
    p, _, _ = _preds(spark, sf_dir)
    return _rounded(M.prf_micro(p), ["precision_micro", "recall_micro", "f1_micro"])


@query("prf_macro", f"""WITH {q.PREDS_MULTI}, {COUNTS}, {PER_LABEL}
SELECT round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro,
       round(avg(f1), 6) AS f1_macro FROM per_label""")
def prf_macro(spark, sf_dir):
    p, u, n = _preds(spark, sf_dir)
    per = M.contingency(M.per_label_counts(p, u, n))
    return _rounded(M.prf_macro(per), ["precision_macro", "recall_macro", "f1_macro"])


@query("per_label_prf", f"""WITH {q.PREDS_MULTI}, {COUNTS}, {PER_LABEL}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM per_label""")
def per_label_prf(spark, sf_dir):
    """M4: per-label precision / recall / F1."""
    p, u, n = _preds(spark, sf_dir)
    per = M.contingency(M.per_label_counts(p, u, n))
    return _rounded(per.select("label", "precision", "recall", "f1"), ["precision", "recall", "f1"])


@query("contingency", f"""WITH {q.PREDS_MULTI}, {COUNTS}, {PER_LABEL}
SELECT label, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1 FROM per_label""")
def contingency(spark, sf_dir):
    """Contingency table and its metrics per label."""
    p, u, n = _preds(spark, sf_dir)
    per = M.contingency(M.per_label_counts(p, u, n))
    return _rounded(per, ["accuracy", "precision", "recall", "f1"])


CONFUSION = """fnr AS (SELECT doc_id, label AS true_label,
                2 * (row_number() OVER (PARTITION BY doc_id ORDER BY label) - 1) AS k
         FROM preds WHERE y_true = 1 AND y_pred = 0),
fpr AS (SELECT doc_id, label AS pred_label,
               row_number() OVER (PARTITION BY doc_id ORDER BY label) - 1 AS k
        FROM preds WHERE y_true = 0 AND y_pred = 1),
pairs AS (
  SELECT label AS true_label, label AS pred_label FROM preds WHERE y_true = 1 AND y_pred = 1
  UNION ALL
  SELECT coalesce(fnr.true_label, 'None'), coalesce(fpr.pred_label, 'None')
  FROM fnr FULL OUTER JOIN fpr ON fnr.doc_id = fpr.doc_id AND fnr.k = fpr.k),
cm AS (SELECT true_label, pred_label, count(*) AS n FROM pairs GROUP BY true_label, pred_label)"""


@query("confusion_matrix", f"WITH {q.PREDS_MULTI}, {CONFUSION} SELECT * FROM cm")
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(_preds(spark, sf_dir)[0])


@query("confusion_percent", f"""WITH {q.PREDS_MULTI}, {CONFUSION}
SELECT true_label, pred_label, n, round(n * 100.0 / sum(n) OVER (PARTITION BY true_label), 6) AS percent
FROM cm""")
def confusion_percent(spark, sf_dir):
    out = M.confusion_percent(M.confusion_matrix(_preds(spark, sf_dir)[0]))
    return _rounded(out, ["percent"])


@query("average_precision", f"""WITH {q.PREDS_MULTI}, {COUNTS},
ap AS (SELECT label, tp, fp, fn, tp + fn AS pos,
              CASE WHEN tp + fp > 0
                   THEN (tp / (tp + fn)) * (tp / (tp + fp)) + (1 - tp / (tp + fn)) * ((tp + fn) / nd.n)
                   ELSE (tp + fn) / nd.n END AS ap
       FROM cnt2, nd WHERE tp + fn > 0),
tot AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, count(*) AS nl FROM cnt2)
SELECT round(CASE WHEN tp + fp > 0
             THEN (tp / (tp + fn)) * (tp / (tp + fp)) + (1 - tp / (tp + fn)) * ((tp + fn) / (nd.n * nl))
             ELSE (tp + fn) / (nd.n * nl) END, 6) AS ap_micro,
       (SELECT round(avg(ap), 6) FROM ap) AS ap_macro
FROM tot, nd""")
def average_precision(spark, sf_dir):
    p, u, n = _preds(spark, sf_dir)
    return _rounded(M.average_precision(p, u, n), ["ap_micro", "ap_macro"])


@query("last_true_rank", f"""WITH {q.PREDS_MULTI}, {RANKED}
SELECT doc_id, max(rank) AS last_true_rank FROM ranked WHERE y_true = 1 GROUP BY doc_id""")
def last_true_rank(spark, sf_dir):
    return M.last_true_rank(_preds(spark, sf_dir)[0])


@query("label_ranking", f"""WITH {q.PREDS_MULTI}, {RANKED}
SELECT doc_id, label, rank FROM ranked""")
def label_ranking(spark, sf_dir):
    """Per-document ranking of labels by score."""
    return M.ranked(_preds(spark, sf_dir)[0]).select("doc_id", "label", "rank")


@query("coverage_binary", f"""WITH {q.PREDS_MULTI},
mt AS (SELECT doc_id, min(y_pred) AS m FROM preds WHERE y_true = 1 GROUP BY doc_id),
cv AS (SELECT doc_id, count(*) FILTER (WHERE y_pred >= m) AS cov FROM preds JOIN mt USING (doc_id) GROUP BY doc_id)
SELECT round(sum(cov) / (SELECT n FROM nd), 6) AS coverage_error FROM cv""")
def coverage_binary(spark, sf_dir):
    """M7: coverage error computed on the 0/1 predictions instead of the
    scores (the superseded variant)."""
    p, _, n = _preds(spark, sf_dir)
    cov = M.coverage_error(p.withColumn("score", F.col("y_pred").cast("double")), n)
    return cov.select(F.round("coverage_error", ROUND).alias("coverage_error"))
