from pyspark.sql import functions as F

from corpusmill.functions import text as tx



def index_terms(text):
    u = tx.index_unigrams(text)
    return F.concat(u, tx.bigrams(u))


def _one(spark, expr, text):
    return spark.createDataFrame([(text,)], "text string").select(expr(F.col("text")).alias("r")).first()["r"]


def test_plain_tokens(spark):
    out = _one(spark, tx.plain_tokens, "Hello, World!  1,000 -2.5e3 nan a-b-c-d-e (x) ...")
    assert out == ["hello", "world", "num_indic", "num_indic", "num_indic", "chem_indic", "x"]


def test_index_unigrams_and_bigrams(spark):
    text = "The quick brown fox, and the lazy dog 42 times"
    uni = _one(spark, tx.index_unigrams, text)
    assert uni == ["quick", "brown", "fox", "lazy", "dog", "number_inidicator", "times"]
    terms = _one(spark, index_terms, text)
    # a dropped stopword does not break a bigram
    assert "fox lazy" in terms and "quick brown" in terms
    assert len(terms) == len(uni) + len(uni) - 1


def test_short_documents(spark):
    assert _one(spark, index_terms, "") == []
    assert _one(spark, index_terms, "word") == ["word"]


def test_number_grammar(spark):
    df = spark.createDataFrame([(t,) for t in ["12", "1.", ".5", "1e5", "1e", "inf", "abc", "1,234.5", "12a"]],
                               "t string")
    got = {r["t"]: r["n"] for r in df.select("t", tx.is_number(F.col("t")).alias("n")).collect()}
    assert got == {"12": True, "1.": True, ".5": True, "1e5": True, "1e": False, "inf": True,
                   "abc": False, "1,234.5": True, "12a": False}


def test_chemical_rules(spark):
    df = spark.createDataFrame([("a-b-c-d",), ("a-b-c-d-e",), ("x" * 40,), ("a-b-c-" + "x" * 20,)], "t string")
    rows = df.select(tx.is_chemical(F.col("t")).alias("old"), tx.is_chemical_new(F.col("t")).alias("new")).collect()
    assert [(r["old"], r["new"]) for r in rows] == [(False, False), (True, False), (False, True), (False, True)]


def test_chunk_bounds(spark):
    for n, parts, expect in [(10, 4, [2, 2, 2, 4]), (3, 4, [3, 0, 0, 0]), (8, 4, [2, 2, 2, 2])]:
        df = spark.createDataFrame([(n,)], "n int")
        b = df.select(tx.chunk_bounds(F.col("n"), parts).alias("b")).first()["b"]
        assert [x["len"] for x in b] == expect
        assert sum(x["len"] for x in b) == n


def test_parse_reachability(spark):
    from corpusmill.sources.io import parse_reachability
    df = spark.createDataFrame([("ID=12 core=0.5 reachdist=0.25 pre=3",), ("ID=7 reachdist=Infinity",)], "value string")
    got = [(r["elem_id"], r["reachdist"]) for r in parse_reachability(df).collect()]
    assert got == [("12", 0.25), ("7", 100.0)]


def test_sentence_word_tokens(spark):
    text = "See Fig. 3, then stop. Numbers: 1,234 and (x)!"
    out = _one(spark, tx.sentence_word_tokens, text)
    # abbreviations keep their dot, sentence punctuation becomes its own
    # token; single letters are abbreviations too, so "(x)!" keeps its "!"
    assert out == ["see", "fig.", "num_indic", "then", "stop", ".", "numbers", "num_indic",
                   "and", "x!"]
