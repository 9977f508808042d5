"""Postings stream past hash tables of the terms; they are not sorted for a join."""
from pyspark.sql import functions as F

from corpusmill.operators import weights as Wt
from corpusmill.plans import q_text as QT


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frequent_postings_are_joined_without_a_sort(spark, tmp_path, monkeypatch):
    built = []
    real = QT.stored

    def watch(s, d, name, builder, *a, **k):
        if name == "frequent-postings":
            built.append(_plan(builder()))
        return real(s, d, name, builder, *a, **k)
    monkeypatch.setattr(QT, "stored", watch)
    rows = [(i, "alpha beta") for i in range(8)] + [(8, "gamma"), (None, "alpha"), (3, "alpha beta"), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    fpost = QT.index_stats(spark, str(tmp_path))[5]
    got = {(r["term"], r["doc_id"]): (r["tf"], r["df"]) for r in fpost.collect()}
    assert len(built) == 1 and "ShuffledHashJoin" in built[0] and "SortMergeJoin" not in built[0]
    assert len(got) == 25 and got["alpha", 3] == (2, 9) and got["alpha", None] == (1, 9) and got["alpha beta", 3] == (2, 8)


def test_weights_of_a_split_are_joined_without_a_sort(spark):
    post = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 2, 3), ("a", 3, 1), ("b", 4, 1)], "term string, doc_id long, tf long")
    labels = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (3, "x"), (4, "y")], "doc_id long, label string")
    splits = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test")], "doc_id long, split string")
    out = Wt.tf_rf_per_split(post, labels, splits)
    got = sorted((r["split"], r["label"], r["term"], r["doc_id"], round(r["weight"], 6)) for r in out.collect())
    a = round(1.584963, 6)      # log2(2 + 1 / 1)
    assert got == [("test", "x", "a", 3, 2.0), ("train", "x", "a", 1, round(2 * 1.5849625, 6)), ("train", "x", "a", 2, a),
                   ("train", "y", "a", 1, round(2 * 1.5849625, 6)), ("train", "y", "a", 2, a), ("train", "y", "b", 2, round(3 * 1.5849625, 6))]
    assert "ShuffledHashJoin" in _plan(out.select(F.col("weight")))
