"""Queries over splits and samples (single-path mapping on documents)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from corpusmill.operators import labels as L
from corpusmill.operators import splits as Sp
from corpusmill.plans import fixtures as fx
from corpusmill.plans import sql as q
from corpusmill.plans.registry import query
from corpusmill.session import materialize
from corpusmill.sources.stages import stage

SEED = 10000
ROUND = 6
# Fixed values of the reference's sampling procedures.
TRAINING_SAMPLE_PERCENTAGE = 0.001
MIN_TRAINING_SAMPLES = 20
MIN_DOCUMENTS_FOR_TRAINING_SAMPLE = 10
HELDOUT_PER_CLASS = 300
SINGLE_LABEL_PER_SECTION = 3000
BATCH_SIZE = 100


def quota_sql(n: str, pct: float, minimum: int) -> str:
    base = f"CAST(floor({n} * CAST({pct} AS DOUBLE)) AS BIGINT)"
    return f"(CASE WHEN {base} > 0 THEN {base} WHEN {minimum} < {n} THEN {minimum} ELSE 0 END)"


def rank_sql(group: str, h: str, tie: str = "doc_id") -> str:
    part = f"PARTITION BY {group} " if group else ""
    return f"row_number() OVER ({part}ORDER BY {h}, {tie})"


SPLIT_SQL = f"""{q.DOC_LABELS_SINGLE},
fl AS (SELECT doc_id, arg_min(label, (level, label)) AS first_label FROM doc_labels GROUP BY doc_id),
sz AS (SELECT first_label, count(*) AS n FROM fl GROUP BY first_label),
sz2 AS (SELECT first_label, n, {quota_sql('n', 0.2, 1)} AS n_test FROM sz),
sz3 AS (SELECT first_label, n, n_test, {quota_sql('(n - n_test)', 0.2, 1)} AS n_val FROM sz2),
rk AS (SELECT doc_id, first_label, {rank_sql('first_label', q.md5_hash(SEED, 'doc_id'))} AS rank FROM fl),
splits AS (
  SELECT rk.doc_id, rk.first_label,
         CASE WHEN rank <= n_test THEN 'test' WHEN rank <= n_test + n_val THEN 'validation'
              ELSE 'train' END AS split
  FROM rk JOIN sz3 USING (first_label))"""


def stored_splits(spark, sf_dir):
    """The split lists, a stored stage (read by several branches and queries)."""
    inputs = [os.path.join(sf_dir, f"{t}.parquet") for t in ("documents", "labels")]
    return stage(spark, "splits", inputs, lambda: Sp.split_assign(fx.doc_labels_single(spark, sf_dir), seed=SEED),
                 {"seed": SEED})


def document_kinds(spark, sf_dir):
    """((doc_id, kind), (kind, split, labels)), stored stages: documents with the same labels, however often they have them,
    and the same split are of one kind.  There are few kinds, whatever the number of documents, and a posting that carries
    its document's kind needs no join with the documents.  A document without an id has no kind, as it joins with no label."""
    from corpusmill.operators import select as S
    inputs = [os.path.join(sf_dir, f"{t}.parquet") for t in ("documents", "labels")]

    def keys():
        own = fx.doc_labels_single(spark, sf_dir).filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
            F.array_sort(F.collect_list(F.struct("level", "label"))).alias("labels"))
        return own.join(stored_splits(spark, sf_dir).select("doc_id", "split"), "doc_id", "left") \
            .select("doc_id", F.to_json(F.struct("split", "labels")).alias("key"))
    of = stage(spark, "document-keys", inputs, keys, {"seed": SEED})
    ranked = stage(spark, "kinds", inputs, lambda: S.global_rank(of.select("key").distinct(), [F.asc("key")], "kind"), {"seed": SEED})
    kinds = ranked.select("kind", F.from_json("key", "split string, labels array<struct<level int, label string>>").alias("k")) \
        .select("kind", "k.split", "k.labels")
    return of.join(ranked, "key").select("doc_id", "kind"), kinds


def kind_labels(kinds, level):
    """(kind, label) of a level."""
    return kinds.select("kind", F.explode("labels").alias("l")).filter(F.col("l.level") == level).select("kind", "l.label")


def _splits(spark, sf_dir):
    return fx.doc_labels_single(spark, sf_dir), stored_splits(spark, sf_dir)


@query("split_assign", f"WITH {SPLIT_SQL} SELECT doc_id, first_label, split FROM splits")
def split_assign(spark, sf_dir):
    return _splits(spark, sf_dir)[1]


COUNTS_SQL = f"""{SPLIT_SQL},
counts AS (
  SELECT level, label, count(*) AS n_docs,
         count(*) FILTER (WHERE split = 'train') AS n_train,
         count(*) FILTER (WHERE split = 'validation') AS n_validation,
         count(*) FILTER (WHERE split = 'test') AS n_test
  FROM doc_labels JOIN splits USING (doc_id) GROUP BY level, label)"""


@query("split_counts", f"WITH {COUNTS_SQL} SELECT * FROM counts")
def split_counts(spark, sf_dir):
    """Label x split document counts."""
    dl, sp = _splits(spark, sf_dir)
    return Sp.label_split_counts(dl, sp)


@query("split_problems", f"""WITH {COUNTS_SQL}
SELECT *, n_train / n_docs < 0.3 AS train_problem, n_validation / n_docs < 0.15 AS val_problem,
       n_test / n_docs < 0.15 AS test_problem FROM counts
WHERE n_train / n_docs < 0.3 OR n_validation / n_docs < 0.15 OR n_test / n_docs < 0.15""")
def split_problems(spark, sf_dir):
    dl, sp = _splits(spark, sf_dir)
    return Sp.split_problems(Sp.label_split_counts(dl, sp))


@query("split_divergence", f"""WITH {SPLIT_SQL},
n AS (SELECT count(*) AS n FROM documents),
ns AS (SELECT count(*) AS n FROM splits WHERE split = 'train'),
c AS (SELECT level, label, count(*) AS n_docs, count(*) FILTER (WHERE split = 'train') AS n_split
      FROM doc_labels JOIN splits USING (doc_id) GROUP BY level, label)
SELECT level, label, n_docs, n_split, round(n_docs / n.n, 6) AS share_corpus,
       round(n_split / ns.n, 6) AS share_split FROM c, n, ns""")
def split_divergence(spark, sf_dir):
    dl, sp = _splits(spark, sf_dir)
    n = fx.documents(spark, sf_dir).select(F.count(F.lit(1))).scalar()
    return (Sp.split_divergence(dl, sp, n)
            .withColumn("share_corpus", F.round("share_corpus", ROUND))
            .withColumn("share_split", F.round("share_split", ROUND)))


@query("label_sample", f"""WITH {q.DOC_LABELS_SINGLE},
sz AS (SELECT label, count(*) AS n FROM doc_labels GROUP BY label),
k AS (SELECT label, CASE WHEN n > {MIN_TRAINING_SAMPLES} THEN
        (CASE WHEN floor(n * CAST({TRAINING_SAMPLE_PERCENTAGE} AS DOUBLE)) > 0
              THEN CAST(floor(n * CAST({TRAINING_SAMPLE_PERCENTAGE} AS DOUBLE)) AS BIGINT)
              ELSE {MIN_TRAINING_SAMPLES} END) ELSE n END AS k FROM sz),
rk AS (SELECT doc_id, label, {rank_sql('label', q.md5_hash(SEED, 'label', 'doc_id'))} AS rank FROM doc_labels)
SELECT DISTINCT doc_id FROM rk JOIN k USING (label) WHERE rank <= k""")
def label_sample(spark, sf_dir):
    dl = fx.doc_labels_single(spark, sf_dir)
    return Sp.sample_per_label(dl, TRAINING_SAMPLE_PERCENTAGE, MIN_TRAINING_SAMPLES, seed=SEED)


@query("balanced_sample", f"""WITH {SPLIT_SQL},
dl AS (SELECT d.doc_id, d.label, s.split FROM doc_labels d JOIN splits s USING (doc_id) WHERE d.level = 3),
bsz AS (SELECT label, split, count(*) AS n FROM dl GROUP BY label, split),
bk AS (SELECT label, split, CASE WHEN n > {MIN_DOCUMENTS_FOR_TRAINING_SAMPLE}
        THEN greatest({MIN_DOCUMENTS_FOR_TRAINING_SAMPLE}, CAST(floor(n * CAST(0.155 AS DOUBLE)) AS BIGINT))
        ELSE n END AS k FROM bsz),
brk AS (SELECT doc_id, label, split,
              {rank_sql('label, split', q.md5_hash(SEED, 'label', 'doc_id'))} AS rank FROM dl)
SELECT DISTINCT doc_id, split FROM brk JOIN bk USING (label, split) WHERE rank <= k""")
def balanced_sample(spark, sf_dir):
    dl, sp = _splits(spark, sf_dir)
    return Sp.balanced_sample(dl.filter(F.col("level") == 3), sp, MIN_DOCUMENTS_FOR_TRAINING_SAMPLE,
                              seed=SEED)


@query("heldout_sample", f"""WITH {SPLIT_SQL},
viable AS (SELECT label FROM doc_labels WHERE level = 2 GROUP BY label HAVING count(DISTINCT doc_id) >= 3),
cand AS (SELECT doc_id, label FROM doc_labels WHERE level = 2 AND label IN (SELECT label FROM viable)
         AND doc_id NOT IN (SELECT doc_id FROM splits WHERE split = 'train')),
hrk AS (SELECT doc_id, label, {rank_sql('label', q.md5_hash(SEED, 'label', 'doc_id'))} AS rank FROM cand)
SELECT doc_id, label FROM hrk WHERE rank <= {HELDOUT_PER_CLASS}""")
def heldout_sample(spark, sf_dir):
    dl, sp = _splits(spark, sf_dir)
    cls = dl.filter(F.col("level") == 2)
    viable = L.valid_labels(cls, 3)
    training = sp.filter(F.col("split") == "train")
    return Sp.heldout_sample(cls, training, viable, HELDOUT_PER_CLASS, seed=SEED)


@query("single_label_sample", f"""WITH {q.DOC_LABELS_MULTI},
one AS (SELECT doc_id, min(label) AS label FROM doc_labels WHERE level = 1 GROUP BY doc_id HAVING count(*) = 1),
rk AS (SELECT doc_id, label, {rank_sql('label', q.md5_hash(SEED, 'doc_id'))} AS rank FROM one)
SELECT doc_id, label FROM rk WHERE rank <= {SINGLE_LABEL_PER_SECTION}""")
def single_label_sample(spark, sf_dir):
    return Sp.single_label_sample(fx.doc_labels_multi(spark, sf_dir), SINGLE_LABEL_PER_SECTION,
                                  level=1, seed=SEED)


@query("shuffled_batches", f"""
WITH rk AS (SELECT doc_id, {rank_sql('', q.md5_hash(SEED, 'doc_id'))} AS position FROM documents)
SELECT doc_id, position, CAST(floor((position - 1) / {BATCH_SIZE}) AS BIGINT) AS batch FROM rk""")
def shuffled_batches(spark, sf_dir):
    return Sp.shuffled_batches(fx.corpus(spark, sf_dir), BATCH_SIZE, seed=SEED)


@query("coin_split", f"""
SELECT doc_id, CASE WHEN ('0x' || substr({q.md5_hash(SEED, 'doc_id')}, 1, 1))::INTEGER % 2 = 0
                    THEN 'test' ELSE 'validation' END AS split FROM documents""")
def coin_split(spark, sf_dir):
    """Seeded coin flip between test and validation."""
    return Sp.coin_split(fx.corpus(spark, sf_dir), SEED)


PATH_SAMPLE_RATIO = 0.01


@query("path_sample", f"""WITH {q.LABEL_PATHS_MULTI},
sub AS (SELECT DISTINCT doc_id, subclass FROM paths),
sz AS (SELECT subclass, count(*) AS n FROM sub GROUP BY subclass),
rk AS (SELECT doc_id, subclass, {rank_sql('subclass', q.md5_hash(SEED, 'subclass', 'doc_id'))} AS rank FROM sub)
SELECT doc_id, subclass FROM rk JOIN sz USING (subclass)
WHERE rank <= CAST(ceil(n * CAST({PATH_SAMPLE_RATIO} AS DOUBLE)) AS BIGINT)""")
def path_sample(spark, sf_dir):
    """ceil(1%) of the documents of every section/class/subclass path,
    drawn in seeded order."""
    paths = fx.label_paths_multi(spark, sf_dir).select("doc_id", F.col("subclass").alias("label")).distinct()
    return Sp.proportional_sample(paths, PATH_SAMPLE_RATIO, seed=SEED).withColumnRenamed("label", "subclass")


@query("docs_per_label", f"""WITH {SPLIT_SQL},
tr AS (SELECT doc_id FROM splits WHERE split = 'train'),
labs AS (SELECT DISTINCT label FROM doc_labels WHERE level = 3),
c AS (SELECT label, count(*) AS n FROM doc_labels WHERE level = 3 AND doc_id IN (SELECT doc_id FROM tr) GROUP BY label)
SELECT labs.label, coalesce(c.n, 0) AS n_docs FROM labs LEFT JOIN c USING (label)""")
def docs_per_label(spark, sf_dir):
    """Documents of every subclass inside the training split; labels
    left without training documents are kept with 0."""
    dl, sp = _splits(spark, sf_dir)
    sub = dl.filter(F.col("level") == 3)
    return L.docs_per_label(sub, sp.filter(F.col("split") == "train"), sub.select("label").distinct())


@query("tfidf_train_split", f"""WITH {q.POSTINGS}, {SPLIT_SQL},
tp AS (SELECT term, doc_id, tf FROM postings WHERE doc_id IN (SELECT doc_id FROM splits WHERE split = 'train')),
tdf AS (SELECT term, count(*) AS df FROM tp GROUP BY term),
tn AS (SELECT count(*) AS n FROM splits WHERE split = 'train')
SELECT tp.term, tp.doc_id, round(tp.tf * log10((tn.n + 1) / (tdf.df + 1)), 6) AS weight
FROM tp JOIN tdf USING (term), tn WHERE tdf.df > 5 AND tdf.df < tn.n""")
def tfidf_train_split(spark, sf_dir):
    """T13 + J5: tf-idf with df and N recomputed inside the training split
    (postings restricted to the split by a left semi join)."""
    from corpusmill.operators import postings as P
    from corpusmill.operators import weights as Wt
    _, sp = _splits(spark, sf_dir)
    train = sp.filter(F.col("split") == "train").select("doc_id")
    post = P.restrict_docs(P.build_postings(fx.corpus(spark, sf_dir)), train)
    post = P.stored_postings(post)
    n = train.select(F.count(F.lit(1))).scalar()
    freq = P.frequent_terms(P.doc_freq(post), 5, n)
    w = Wt.tfidf(post, freq, n)
    return w.select("term", "doc_id", F.round("weight", ROUND).alias("weight"))


@query("weights_per_split", f"""WITH {q.FREQ}, {SPLIT_SQL},
lens AS (SELECT doc_id, length(text) AS len FROM documents),
avgl AS (SELECT avg(len) AS a FROM lens),
sn AS (SELECT split, count(*) AS n FROM splits GROUP BY split),
sp AS (SELECT s.split, p.term, p.doc_id, p.tf FROM fpost p JOIN splits s USING (doc_id)),
sdf AS (SELECT split, term, count(*) AS sdf FROM sp GROUP BY split, term)
SELECT split, term, doc_id, tf, round(tf * log10((sn.n + 1) / (sdf + 1)), 6) AS tfidf,
       round(greatest(0.0, log10((sn.n - sdf + 0.5) / (sdf + 0.5)))
       * (2.5 * tf) / (1.5 * (0.25 + 0.75 * (lens.len / avgl.a)) + tf), 6) AS bm25
FROM sp JOIN sdf USING (split, term) JOIN sn USING (split) JOIN lens USING (doc_id), avgl""")
def weights_per_split(spark, sf_dir):
    """T13 + J7: tf-idf and BM25 of the corpus's frequent terms in the training,
    validation and test documents, with df and N counted inside each split and
    the corpus's average length."""
    from corpusmill.operators import postings as P
    from corpusmill.operators import weights as Wt
    from corpusmill.plans import q_text as QT
    _, _, fpost, kinds = QT.labelled_stats(spark, sf_dir)
    post = fpost.drop("df").join(kinds.select("kind", "split").filter(F.col("split").isNotNull()), "kind")
    df = Wt.by_split(post.groupBy("split", "term").agg(F.count(F.lit(1)).alias("df")), "df")
    sizes = stored_splits(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    n = F.element_at(sizes.select(F.map_from_entries(F.collect_list(F.struct("split", "n")))).scalar(), F.col("split"))
    avg = QT.average_chars(spark, sf_dir)
    j = post.join(df.hint("shuffle_hash"), "term").withColumn("df", F.element_at("df", F.col("split"))).withColumn("n", n)
    tfidf = F.col("tf") * F.log10(Wt.idf_quotient(F.col("df"), F.col("n")))
    bm25 = Wt.bm25_weight(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), avg)
    return j.select("split", "term", "doc_id", "tf", F.round(tfidf, ROUND).alias("tfidf"),
                    F.round(bm25, ROUND).alias("bm25"))


@query("tf_rf_per_split", f"""WITH {q.FREQ}, {SPLIT_SQL},
sp AS MATERIALIZED (SELECT s.split, d.lang AS label, p.term, p.doc_id, p.tf FROM fpost p JOIN splits s USING (doc_id)
                    JOIN documents d USING (doc_id)),
a AS (SELECT split, term, label, count(*) AS a FROM sp GROUP BY split, term, label),
c AS (SELECT split, term, count(*) AS df FROM sp GROUP BY split, term),
rf AS (SELECT split, term, label, log2(2 + a / greatest(1, df - a)) AS rf FROM a JOIN c USING (split, term))
SELECT sp.split, rf.label, sp.term, sp.doc_id, round(sp.tf * rf.rf, 6) AS weight
FROM sp JOIN rf ON rf.split = sp.split AND rf.term = sp.term""")
def tf_rf_per_split(spark, sf_dir):
    """Tf-rf of the frequent terms for every split and section, counted inside the split."""
    from corpusmill.operators import weights as Wt
    from corpusmill.plans import q_text as QT
    _, _, fpost, kinds = QT.labelled_stats(spark, sf_dir)
    out = Wt.tf_rf_per_split(fpost, kind_labels(kinds, 1), kinds.filter(F.col("split").isNotNull()), on="kind")
    return out.withColumn("weight", F.round("weight", ROUND))
