"""Model, export and row-only queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill.functions import stem as St
from corpusmill.functions import text as tx
from corpusmill.operators import linear as Ln
from corpusmill.operators import markup as Mk
from corpusmill.operators import metrics as M
from corpusmill.operators import models as Md
from corpusmill.operators import postings as P
from corpusmill.operators import select as S
from corpusmill.operators import topics as Tp
from corpusmill.operators import weights as Wt
from corpusmill.plans import fixtures as fx
from corpusmill.plans import q_splits as QS
from corpusmill.plans import q_text as QT
from corpusmill.plans import sql as q
from corpusmill.plans.registry import query
from corpusmill.sources import io
from corpusmill.sources.io import table
from corpusmill.session import checkpoint_dir, materialize

BLOCK_ROWS = 100_000
SVM_ITERATIONS = 100
SVM_REG = 0.01
LDA_PASSES = 50
LDA_TOPICS = 1000


def _index(spark, sf_dir):
    """BM25 doc index over the chi-selected dictionary; the dictionary is small, so that no posting is shuffled for it."""
    fpost, freq, n, best = QT._chi_best(spark, sf_dir)
    return Wt.doc_index(Wt.bm25(fpost, freq, None, n, QT.average_chars(spark, sf_dir)),
                        F.broadcast(S.term_dictionary(best)))


def _label_ids(spark, sf_dir):
    """(label_id, level, label): all labels of the three levels, numbered by level and name."""
    dl = fx.doc_labels_single(spark, sf_dir)

    def build():
        ranked = S.global_rank(dl.select("level", "label").distinct(), [F.asc("level"), F.asc("label")], "label_id", start=0)
        return ranked.select(F.col("label_id").cast("int").alias("label_id"), "level", "label")
    return dl, QT.stored(spark, sf_dir, "label-ids", build, ("documents", "labels"))


def _entries(spark, sf_dir):
    """(doc_id, indices, values, kind): the index as one sparse vector for each document, a stored stage."""
    def build():
        of, _ = QS.document_kinds(spark, sf_dir)
        docs = fx.documents(spark, sf_dir).select("doc_id").join(of, "doc_id", "left")
        return Md.sparse_entries(_index(spark, sf_dir), docs, keep=("kind",))
    return QT.stored(spark, sf_dir, "entries", build, ("documents", "labels"), features=QT.TOP_N_FEATURES)


def _kinds(spark, sf_dir, names, split):
    """(kind, labels): the sorted label ids of a split's kinds of documents, a stored stage, so that the few are known to be few."""
    def build():
        kinds = QS.document_kinds(spark, sf_dir)[1]
        own = kinds.select("kind", F.explode("labels").alias("l")).select("kind", "l.level", "l.label").join(names, ["level", "label"]) \
            .groupBy("kind").agg(F.array_sort(F.collect_set("label_id")).alias("labels"))
        return kinds.select("kind", "split").join(own, "kind", "left") \
            .select("kind", "split", F.coalesce("labels", F.array().cast("array<int>")).alias("labels"))
    return QT.stored(spark, sf_dir, "kind-labels", build, ("documents", "labels")).filter(F.col("split") == split).select("kind", "labels")


def _svm(spark, sf_dir):
    """(entries of all documents, weights of all labels, label ids).  The weights are a stage under a manifest of the
    input's files and the parameters (L5), so that the queries share them.  Splits and labels are joined by the kinds of
    documents, so that no entries are shuffled for them."""
    _, names = _label_ids(spark, sf_dir)
    entries = _entries(spark, sf_dir)

    def build():
        train = Ln.stored_rows(entries.join(_kinds(spark, sf_dir, names, "train"), "kind").drop("kind"))
        return Ln.train_all(train, QT.TOP_N_FEATURES, names.count(), iterations=SVM_ITERATIONS, reg=SVM_REG)
    weights = QT.stored(spark, sf_dir, "svm-weights", build, ("documents", "labels"), features=QT.TOP_N_FEATURES,
                        iterations=SVM_ITERATIONS, reg=SVM_REG)
    return entries, weights, names


def _svm_predictions(spark, sf_dir, split):
    """(level, doc_id, label, y_true, score) of a split's documents and every label."""
    entries, weights, names = _svm(spark, sf_dir)
    own = _kinds(spark, sf_dir, names, split)
    mine = entries.join(own.select("kind"), "kind")
    y_true = F.when(F.array_contains("labels", F.col("label_id")), 1).otherwise(0)
    return Ln.score_all(mine, weights, QT.TOP_N_FEATURES, keep=("kind",)).join(names, "label_id").join(own, "kind") \
        .select("level", "doc_id", "label", y_true.alias("y_true"), "score")


@query("svm_margins")
def svm_margins(spark, sf_dir):
    """One linear SVM per section, class and subclass trained on the train split, raw
    margins of every document of the test split."""
    return _svm_predictions(spark, sf_dir, "test").select("level", "doc_id", "label", "score")


@query("svm_training_error")
def svm_training_error(spark, sf_dir):
    """L4: training error of every label's classifier."""
    wrong = (F.col("score") > 0) != (F.col("y_true") == 1)
    return _svm_predictions(spark, sf_dir, "train").groupBy("level", "label") \
        .agg(F.avg(wrong.cast("double")).alias("training_error"))


@query("svm_coverage_error")
def svm_coverage_error(spark, sf_dir):
    """L3 into M5: coverage error of the margins on the test split, per level."""
    return svm_metrics(spark, sf_dir).select("level", "coverage_error")


@query("svm_metrics")
def svm_metrics(spark, sf_dir):
    """L3 into M2, M5 and M6: micro precision, recall and F1, coverage error and top-N shares of the margins
    on the test split, per level."""
    preds = materialize(M.with_pred(_svm_predictions(spark, sf_dir, "test")), "svm-predictions")
    out = None
    for level in (1, 2, 3):
        p = preds.filter(F.col("level") == level)
        parts = [M.prf_micro(p).select("precision_micro", "recall_micro", "f1_micro"),
                 M.coverage_error(p, p.select(F.countDistinct("doc_id")).scalar()), M.topn_share(p)]
        row, *more = [x.withColumn("level", F.lit(level)) for x in parts]      # one row each
        for x in more:
            row = row.join(x, "level")
        out = row if out is None else out.unionByName(row)
    return out


def _topics(spark, sf_dir):
    """(doc_id, topics) of every document: 1,000 topics fitted on the train split's BM25 vectors, a stored stage."""
    def build():
        entries, sp = _entries(spark, sf_dir), QS.stored_splits(spark, sf_dir)
        train = entries.join(sp.filter(F.col("split") == "train").select("doc_id"), "doc_id")
        return Tp.transform(entries, Tp.fit(train, QT.TOP_N_FEATURES, LDA_TOPICS, LDA_PASSES), LDA_TOPICS)
    return QT.stored(spark, sf_dir, "topics", build, ("documents", "labels"), topics=LDA_TOPICS, passes=LDA_PASSES)


@query("lda_topics")
def lda_topics(spark, sf_dir):
    """Each document's strongest topic (1-based) and its weight, in all three splits."""
    best = _topics(spark, sf_dir).select("doc_id", F.array_position("topics", F.array_max("topics")).alias("topic"),
                                         F.array_max("topics").cast("double").alias("weight"))
    return best.join(QS.stored_splits(spark, sf_dir).select("doc_id", "split"), "doc_id", "left")


@query("word2vec_docs")
def word2vec_docs(spark, sf_dir):
    """Mean word vectors per document (Word2Vec on plain tokens)."""
    docs = fx.corpus(spark, sf_dir).select("doc_id", tx.plain_tokens(F.col("text")).alias("tokens"))
    return Md.word2vec_docs(docs)


@query("bisecting_kmeans")
def bisecting_kmeans(spark, sf_dir):
    """Eight clusters of the embeddings."""
    return Md.bisecting_kmeans(fx.vectors(spark, sf_dir).select("id", "v"), k=8)


@query("stemmed_postings")
def stemmed_postings(spark, sf_dir):
    """Postings keyed by Porter stems and pairs of them."""
    return St.stemmed_postings(fx.corpus(spark, sf_dir), parts=fx.parts(fx.documents(spark, sf_dir)))


@query("stemmed_tfidf")
def stemmed_tfidf(spark, sf_dir):
    """V1 into T3: tf-idf weights of the frequent stemmed terms."""
    docs = fx.documents(spark, sf_dir)
    n, parts = P.n_docs(docs), fx.parts(docs)
    fpost = P.frequent_postings(St.stemmed_postings(fx.corpus(spark, sf_dir), parts=parts), fx.parts(docs, fx.TERM_BYTES), QT.MIN_DOCUMENTS, n)
    w = Wt.tfidf(fpost, None, n)
    return w.select("term", "doc_id", F.round("weight", 6).alias("weight"))


@query("paragraphs")
def paragraphs(spark, sf_dir):
    """Paragraphs of the pages' markup."""
    pages = fx.spread(table(spark, sf_dir, "pages"), "page_id")
    return Mk.page_paragraphs(pages)


def _min_count_sql(n: str, share: float) -> str:
    up = f"ceil({n} * {share!r}::DOUBLE)"
    return f"CAST(CASE WHEN ({up} - 1) / {n} >= {share!r}::DOUBLE THEN {up} - 1 ELSE {up} END AS BIGINT)"


# The three passes of the repair, each a row of counts after the one before.
REPAIR_SQL = f"""WITH {QS.SPLIT_SQL},
one AS (SELECT dl.doc_id, dl.label, s.split FROM doc_labels dl JOIN splits s USING (doc_id) WHERE dl.level = 3),
c0 AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE split = 'train') AS tr, count(*) FILTER (WHERE split = 'validation') AS va,
              count(*) FILTER (WHERE split = 'test') AS te FROM one GROUP BY label HAVING count(*) >= 3),
m AS (SELECT *, tr AS s_tr, va AS s_va, te AS s_te, {_min_count_sql("n", 0.3)} AS mtr, {_min_count_sql("n", 0.15)} AS mva,
             {_min_count_sql("n", 0.15)} AS mte FROM c0),
p1 AS (SELECT *, least(greatest(mva - va, 0), greatest(tr - mtr, 0), s_tr) AS m1v FROM m),
p2 AS (SELECT *, least(greatest(mte - te, 0), greatest(tr - mtr, 0) - m1v, s_tr - m1v) AS m1t FROM p1),
q1 AS (SELECT * REPLACE (tr - m1v - m1t AS tr, va + m1v AS va, te + m1t AS te) FROM p2),
p3 AS (SELECT *, least(greatest(mva - va, 0), greatest(te - mte, 0), s_te) AS m2v FROM q1),
p4 AS (SELECT *, least(greatest(mtr - tr, 0), greatest(te - mte, 0) - m2v, s_te - m2v) AS m2r FROM p3),
q2 AS (SELECT * REPLACE (te - m2v - m2r AS te, va + m2v AS va, tr + m2r AS tr) FROM p4),
p5 AS (SELECT *, least(greatest(mte - te, 0), greatest(va - mva, 0), s_va) AS m3t FROM q2),
p6 AS (SELECT *, least(greatest(mtr - tr, 0), greatest(va - mva, 0) - m3t, s_va - m3t) AS m3r FROM p5),
mv AS (SELECT *, row_number() OVER (PARTITION BY label, split ORDER BY {q.md5_hash(10000, "doc_id")}, doc_id) AS rank FROM one)
SELECT doc_id, mv.label, split, CASE
    WHEN split = 'train' AND rank <= m1v THEN 'validation' WHEN split = 'train' AND rank <= m1v + m1t THEN 'test'
    WHEN split = 'test' AND rank <= m2v THEN 'validation' WHEN split = 'test' AND rank <= m2v + m2r THEN 'train'
    WHEN split = 'validation' AND rank <= m3t THEN 'test' WHEN split = 'validation' AND rank <= m3t + m3r THEN 'train'
    ELSE split END AS new_split
FROM mv LEFT JOIN p6 ON p6.label = mv.label"""


@query("split_repair", REPAIR_SQL)
def split_repair(spark, sf_dir):
    """Minimum-share repair of the splits for single-label documents."""
    dl, sp = QS._splits(spark, sf_dir)
    return Md.repair_splits(dl.filter(F.col("level") == 3), sp)


@query("sparse_export", f"""WITH {QT.DOC_INDEX_SQL},
lines AS (SELECT doc_id, string_agg(CAST(term_id + 1 AS VARCHAR) || ':' || printf('%.4f', round(weight, 4)), ' ' ORDER BY term_id) AS l
          FROM idx GROUP BY doc_id)
SELECT d.doc_id, '0' || coalesce(' ' || l, '') AS line FROM documents d LEFT JOIN lines USING (doc_id)""")
def sparse_export(spark, sf_dir):
    """The doc index as libsvm lines (label, then 1-based index:value),
    one for every document."""
    e = Md.sparse_entries(_index(spark, sf_dir), fx.documents(spark, sf_dir))
    parts = F.zip_with("indices", "values", lambda i, v: F.concat(
        (i + 1).cast("string"), F.lit(":"), F.format_string("%.4f", F.round(v, 4))))
    return e.select("doc_id", F.array_join(F.concat(F.array(F.lit("0")), parts), " ").alias("line"))


@query("dense_export", """
SELECT vec_id AS id, array_to_string(list_transform(CAST(embedding AS DOUBLE[]), lambda x: printf('%.3f', x)), ' ') AS line
FROM embeddings""")
def dense_export(spark, sf_dir):
    """Vectors as space-separated %.3f text lines."""
    return io.dense_text(fx.vectors(spark, sf_dir), "v", "id")


@query("row_blocks", f"""
WITH r AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS idx FROM lineitem)
SELECT CAST(floor(idx / {BLOCK_ROWS}) AS BIGINT) AS block, count(*) AS n_rows,
       min(l_orderkey) AS first_key, max(l_orderkey) AS last_key
FROM r GROUP BY 1""")
def row_blocks(spark, sf_dir):
    """Lineitem rows in key order cut into 100,000-row blocks."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    ranked = S.global_rank(li, [F.asc("l_orderkey"), F.asc("l_linenumber")], "idx", start=0)
    b = io.row_blocks(ranked, "idx", BLOCK_ROWS)
    return b.groupBy("block").agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.min("l_orderkey").alias("first_key"),
                                  F.max("l_orderkey").alias("last_key"))


@query("row_block_sink", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
           row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS row_idx FROM lineitem)
SELECT row_idx, l_orderkey, l_linenumber, l_quantity, l_extendedprice, CAST(floor(row_idx / {BLOCK_ROWS}) AS INTEGER) AS block
FROM r WHERE floor(row_idx / {BLOCK_ROWS}) = (SELECT floor((count(*) - 1) / {BLOCK_ROWS}) FROM lineitem)""")
def row_block_sink(spark, sf_dir):
    """Lineitem rows with payload written by block and the last block read back from its own folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/corpusmill-blocks-{uuid.uuid4().hex}"
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    io.write_row_blocks(li, [F.asc(c) for c in li.columns], path, BLOCK_ROWS)
    last = spark.read.parquet(path).agg(F.max("block")).first()[0]
    return io.read_row_blocks(spark, path, last or 0).select(
        "row_idx", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "block")


@query("part_sequences")
def part_sequences(spark, sf_dir):
    """Per document a fixed-width sequence of part vectors
    (document, first P paragraphs, four chunks; zero vectors where a part is
    missing).  Part vectors are mean Word2Vec vectors of the part's tokens;
    P is the median paragraph count (L10)."""
    from corpusmill.operators import parts as Pt
    from corpusmill.operators import wordvectors as Wv
    docs = fx.corpus(spark, sf_dir)
    parts = Wv.in_blocks(Pt.part_table(docs, tx.plain_tokens, 4), "parts")
    n_par = parts.filter(F.col("part_type") == "paragraph").groupBy("doc_id").count() \
        .select(F.floor(F.percentile("count", 0.5)).cast("int")).first()[0] or 1
    dim = 200
    words = Wv.word_vectors(parts.filter(F.col("part_type") == "doc"), dim, min_count=5, window=5, iterations=1, seed=1)
    vecs = Wv.mean_vectors(parts.drop("part_order"), words, dim, by="doc_id")
    seq = Pt.part_sequence_matrix(vecs, docs, n_par, 4, dim)
    # The same sequence flattened (parts x dims) for non-sequence models
    return seq.withColumn("flat", F.flatten("sequence"))


@query("split_repair_multilabel")
def split_repair_multilabel(spark, sf_dir):
    """Round-based repair of subclass shares on the multi-label order
    mapping (orders split with the closed-form stratified split first);
    returns the moved documents with their old and new split."""
    from corpusmill.operators import splits as Sp
    dl = fx.doc_labels_multi(spark, sf_dir)
    sp = materialize(Sp.split_assign(dl), "order-splits")
    return Md.repair_splits_multilabel(dl.filter(F.col("level") == 3), sp)[0]


@query("split_repair_leftovers")
def split_repair_leftovers(spark, sf_dir):
    """The subclasses that are still below a minimum after the repair, with the split and both counts."""
    from corpusmill.operators import splits as Sp
    dl = fx.doc_labels_multi(spark, sf_dir)
    sp = materialize(Sp.split_assign(dl), "order-splits")
    return Md.repair_splits_multilabel(dl.filter(F.col("level") == 3), sp)[1]
