"""Postings are shuffled once, and what counts them by term, label or split later shuffles none of them."""
import re

import pytest

from pyspark.sql import functions as F

from corpusmill.functions import stem as St
from corpusmill.operators import postings as P
from corpusmill.operators import select as S
from corpusmill.operators import weights as Wt
from corpusmill.plans import fixtures as fx
from corpusmill.plans import q_io as QI
from corpusmill.plans import q_models as QM
from corpusmill.plans import q_splits as QS
from corpusmill.plans import q_text as QT
from corpusmill.sources import stages


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents that come twice, also with another language, without an id, a language or a text; labels that come twice."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, f"alpha beta word{i % 4} alpha gamma{i % 9}", "en" if i % 3 else "de", f"s{i % 2}") for i in range(40)]
    rows += [(3, "alpha beta", "en", "s1"), (3, "alpha beta", "de", "s1"), (4, "beta word1", None, "s0"), (None, "alpha beta", "en", "s0"),
             (50, None, "de", None), (51, "", "de", "s1"), (52, "alpha word1", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 3) for i in range(30)] + [(5, 2), (6, 1), (None, 1), (7, None)], "doc_id long, quality int") \
        .write.parquet(f"{path}/labels.parquet")
    return path


def test_the_count_and_the_join_read_one_shuffle(spark, tables):
    post = P.build_postings(fx.corpus(spark, tables), keep_length=True)
    out = P.frequent_postings(post, 8, 5, F.lit(1000))
    got = _rows(out.select("term", "doc_id", "tf", "df"))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df > 5")
    assert got == _rows(post.join(df, "term").select("term", "doc_id", "tf", "df")) and len(got) > 100
    out.collect()
    final = _plan(out).split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 1 and len(re.findall(r"[+-] Exchange hashpartitioning\(term", final)) == 1


def test_kinds_count_as_documents_do(spark, tables):
    n, freq, fpost, kinds = QT.labelled_stats(spark, tables)
    plain, dl = QT.index_stats(spark, tables)[5], fx.doc_labels_single(spark, tables)
    assert _rows(fpost.drop("kind").select(plain.columns)) == _rows(plain)
    one, three, sp = (dl.filter("level = 1"), dl.filter("level = 3"), QS.stored_splits(spark, tables))
    assert _rows(Wt.relevance_frequency(fpost, QS.kind_labels(kinds, 1), freq, on="kind")) == _rows(Wt.relevance_frequency(plain, one, freq))
    assert _rows(S.chi_squared(fpost, freq, QS.kind_labels(kinds, 3), n, "kind", S.class_sizes(three))) == _rows(S.chi_squared(plain, freq, three, n))
    assert _rows(Wt.tf_rf_per_split(fpost, QS.kind_labels(kinds, 1), kinds.filter("split is not null"), on="kind")) == _rows(Wt.tf_rf_per_split(plain, one, sp))


@pytest.mark.parametrize("name", ["rf", "tf_rf_per_split", "weights_per_split"])
def test_frequent_postings_are_not_shuffled_again(spark, tables, name):
    plan = _plan({"rf": QT.rf, "tf_rf_per_split": QS.tf_rf_per_split, "weights_per_split": QS.weights_per_split}[name](spark, tables))
    assert "Bucketed: true" in plan and not re.findall(r"Exchange hashpartitioning\((?:split#\d+, )?term", plan)


def test_a_session_without_the_table_finds_its_files(spark, tables):
    want = _rows(QT.index_stats(spark, tables)[5])
    for s in stages.stages(spark):
        if "buckets" in s:
            spark.sql(f"DROP TABLE IF EXISTS {stages._table(s['data'])}")
    got = QT.index_stats(spark, tables)[5]
    assert _rows(got) == want and "Bucketed: true" in _plan(got.groupBy("term").count())


def test_stems_are_dealt_and_not_their_postings(spark, tables):
    out = QM.stemmed_postings(spark, tables)
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", _plan(out))) == {"doc_id"}
    assert _rows(out) == _rows(St.stemmed_postings(fx.corpus(spark, tables)))
    n = spark.read.parquet(f"{tables}/documents.parquet").count()
    weights = {r["term"]: r["weight"] for r in QM.stemmed_tfidf(spark, tables).collect() if r["doc_id"] is None}
    assert set(weights) == {"alpha", "beta", "alpha beta"} and n == 47


def test_json_lines_are_compressed(spark, tmp_path):
    spark.createDataFrame([(i, f"alpha beta word{i % 2}") for i in range(12)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QI.postings_json(spark, str(tmp_path))
    assert out.inputFiles() and all(f.endswith(".gz") for f in out.inputFiles())
    assert _rows(out.select("term", "doc_id", F.col("tf").cast("long"))) == _rows(QT.index_stats(spark, str(tmp_path))[5].select("term", "doc_id", "tf"))
