"""Texts are dealt by document once; what later groups by document needs no other shuffle."""
import re

import pytest

from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators import linear as Ln
from corpusmill.operators import postings as P
from corpusmill.operators import topics as Tp
from corpusmill.plans import fixtures as fx


def test_postings_of_many_files_shuffle_only_the_texts(spark, tmp_path):
    rows = [(i, f"alpha beta word{i % 7} alpha") for i in range(60)] + [(3, "alpha again"), (None, "beta")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    post = P.build_postings(fx.corpus(spark, str(tmp_path)), keep_length=True)
    assert post.rdd.getNumPartitions() >= 8
    plan = post._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#\d+[^)]*\)", plan)) == {"doc_id"}
    got = {(r["term"], r["doc_id"], r["length"]): r["tf"] for r in post.collect()}
    assert got["alpha", 0, 22] == 2 and got["beta", None, 4] == 1 and got["alpha", 3, 11] == 1


ODD = ["--a--b--", "word.", "word,", "(word).", "nan", "nan,", "n,an", "inf.", "1,000.", "-5", "$5.", "fig.", "u.s.", "e.g.", "...", ".", "!?x", "x!?",
       "‘quoted’.", "quo’.", "a b", "a ", "\u0085", "x" * 39, "x" * 40, "x" * 39 + ".", "a-b-c-" + "d" * 30, "éà.", "Σας", "ΌΔΟΣ.", "İ", "日本.",
       "a.b", "al", "al.", "al,", "Am.", "---x" + "-" * 50 + "y", "'tis", "\x00a\x00."]


@pytest.mark.parametrize("chars", [tx.PUNCTUATION, tx.SENTENCE_STRIP])
def test_stripped_tokens_equal_a_strip_for_each(spark, chars):
    text = " \t".join(ODD) + "\n" + "\x0b".join(reversed(ODD))
    df = spark.createDataFrame([(text,), ("",), (None,), (" - ",)], "text string")
    each = F.filter(F.transform(tx.whitespace_split(F.col("text")), lambda t: tx.strip_chars(F.lower(t), chars)), lambda s: s != "")
    for r in df.select(tx.stripped_tokens(F.col("text"), chars).alias("got"), each.alias("want")).collect():
        assert r["got"] == r["want"]


def test_sentence_words_equal_the_patterns(spark):
    """X10 by its patterns alone, for every odd token."""
    def plain(s):
        pat = r"^([.,!?;:]*)(.+?)([.,!?;:]?)$"
        lead, mid, tail = (tx.strip_chars(F.regexp_extract(s, pat, i), tx.SENTENCE_STRIP) for i in (1, 2, 3))
        known = F.array_contains(F.array(*[F.lit(a) for a in tx.ABBREVIATIONS]), mid)
        three = F.array(lead, F.when(known, F.concat(mid, tail)).otherwise(mid), F.when(known, F.lit("")).otherwise(tail))
        return F.when(tx.is_number(s), F.array(F.lit("num_indic"))).when(tx.is_currency(s), F.array(F.lit("curr_indic"))) \
            .when(tx.is_chemical_new(s), F.array(F.lit("chem_indic"))).otherwise(three)
    s = tx.strip_chars(F.lower("t"), tx.SENTENCE_STRIP)
    df = spark.createDataFrame([(t,) for t in ODD], "t string").select(
        "t", tx.sentence_word_tokens(F.col("t")).alias("got"), F.when(s == "", F.array()).otherwise(F.filter(plain(s), lambda x: x != "")).alias("want"))
    for r in df.collect():
        assert r["got"] == r["want"], repr(r["t"])


def test_training_tasks_and_topic_blocks_do_not_grow_with_the_documents(spark):
    cores = spark.sparkContext.defaultParallelism
    entries = spark.range(300).select(F.col("id").alias("doc_id"), F.array(F.lit(1)).alias("indices"), F.array(F.lit(0.5)).alias("values"))
    labels = entries.select("doc_id", F.lit(0).alias("label_id"))
    training = Ln.training_table(entries, labels, entries, rows_per_part=2)
    assert training.count() == 300
    assert len(training.select(F.input_file_name()).distinct().collect()) <= 2 * cores
    blocks, n = Tp.in_blocks(entries, rows=2)
    assert n == cores and blocks.count() == 300 and blocks.filter(f"block >= {n}").count() == 0


def test_tasks_grow_with_the_bytes_of_the_table(spark, tmp_path, monkeypatch):
    rows = [(i, f"alpha beta word{i} alpha") for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/a b/documents.parquet")
    docs = fx.documents(spark, f"{tmp_path}/a b")
    assert fx.parts(docs) == 2 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(fx, "PART_BYTES", 512)
    n = fx.parts(docs)
    assert n > 16 and fx.corpus(spark, f"{tmp_path}/a b").rdd.getNumPartitions() == n


def test_doc_freq_is_the_same_in_any_number_of_tasks(spark):
    post = spark.createDataFrame([(f"t{i % 5}", i) for i in range(23)] + [("t0", None)], "term string, doc_id long")
    want = sorted(map(tuple, P.doc_freq(post).collect()))
    assert want[0] == ("t0", 6) and sorted(map(tuple, P.doc_freq(post, 7).collect())) == want
    plan = P.doc_freq(post, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_frequent_terms_need_no_join_of_the_postings(spark, tmp_path, monkeypatch):
    """min_df_terms and chi_old read the term counts alone."""
    from corpusmill.plans import q_text as QT
    made = []
    real = QT.stored
    monkeypatch.setattr(QT, "stored", lambda s, d, name, *a, **k: made.append(name) or real(s, d, name, *a, **k))
    rows = [(i, "alpha beta") for i in range(8)] + [(8, "gamma"), (None, "alpha")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["term"]: r["df"] for r in QT.min_df_terms(spark, str(tmp_path)).collect()}
    assert got == {"alpha": 9, "beta": 8, "alpha beta": 8} and "frequent-postings" not in made
    assert QT.index_stats(spark, str(tmp_path))[5].count() == 25 and "frequent-postings" in made
