"""Term weights (T1-T8, T12-T13) over the long postings table.

Corpus-wide scalars (N, average length) enter as scalar subqueries that
Spark evaluates once; per-term statistics (df) and per-document statistics
(length) are joined on their keys.  No map or vector is built until export.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the reference's BM25 (k1 and b).
BM25_K = 1.5
BM25_B = 0.75


def _with_df(postings: DataFrame, dfreq: DataFrame) -> DataFrame:
    if "df" in postings.columns:
        return postings
    return postings.join(dfreq.select("term", "df"), "term")


def sublinear_tf(tf: Column) -> Column:
    """log10(1 + tf)."""
    return F.log10(F.lit(1.0) + tf)


def idf_quotient(df: Column, n: Column, integer_division: bool = False) -> Column:
    """(N+1)/(df+1), truncated when ``integer_division`` (Python 2 parity)."""
    q = (n + F.lit(1)) / (df + F.lit(1))
    return F.floor(q).cast("double") if integer_division else q


def tfidf(postings: DataFrame, dfreq: DataFrame, n: Column,
          integer_division: bool = False, sublinear: bool = False) -> DataFrame:
    """Tf * log10((N+1)/(df+1)); ``sublinear`` uses log10(1+tf)."""
    tf = sublinear_tf(F.col("tf")) if sublinear else F.col("tf").cast("double")
    w = tf * F.log10(idf_quotient(F.col("df"), n, integer_division))
    return _with_df(postings, dfreq).select("term", "doc_id", "tf", w.alias("weight"))


def bm25_weight(tf: Column, df: Column, n: Column, length: Column, avg_len: Column,
                k: float = BM25_K, b: float = BM25_B) -> Column:
    """T5 as an expression."""
    idf = F.greatest(F.lit(0.0), F.log10((n - df + 0.5) / (df + 0.5)))
    tf = tf.cast("double")
    return (k + 1) * tf / (k * ((1 - b) + b * (length / avg_len)) + tf) * idf


def bm25(postings: DataFrame, dfreq: DataFrame, lengths: DataFrame | None, n: Column,
         avg_len: Column, k: float = BM25_K, b: float = BM25_B) -> DataFrame:
    """T5: max(0, log10((N-df+.5)/(df+.5))) * (k+1) tf / (k((1-b)+b len/avg) + tf).

    ``lengths`` may be None when the postings already carry ``length``."""
    j = _with_df(postings, dfreq)
    if lengths is not None:
        j = j.drop("length").join(lengths.select("doc_id", "length"), "doc_id")
    weight = bm25_weight(F.col("tf"), F.col("df"), n, F.col("length"), avg_len, k, b)
    return j.select("term", "doc_id", "tf", weight.alias("weight"))


def relevance_frequency(postings: DataFrame, doc_labels: DataFrame,
                        dfreq: DataFrame, on: str = "doc_id") -> DataFrame:
    """rf(term, label) = log2(2 + a / max(1, c)).

    a = documents with the term inside the label, c = documents with the term
    outside it (= df - a).  Only pairs with a > 0 are produced; every other
    pair has a = 0 and therefore rf = 1 exactly.  ``on`` names the column that postings and labels share."""
    a = (postings.select("term", on)
         .join(doc_labels.select(on, "label"), on)
         .groupBy("term", "label").agg(F.count(F.lit(1)).alias("a")))
    c = F.col("df") - F.col("a")
    return (a.join(dfreq.select("term", "df"), "term")
            .select("term", "label", "a", c.alias("c"),
                    F.log2(F.lit(2.0) + F.col("a") / F.greatest(F.lit(1), c)).alias("rf")))


def tf_rf(postings: DataFrame, rf: DataFrame, label: str) -> DataFrame:
    """Tf * rf(term, label) for one binary classification problem;
    terms absent from the label have rf = 1."""
    rf_l = rf.filter(F.col("label") == label).select("term", "rf")
    return (postings.join(rf_l, "term", "left")
            .select("term", "doc_id", "tf",
                    (F.col("tf") * F.coalesce(F.col("rf"), F.lit(1.0))).alias("weight")))


def by_split(counts: DataFrame, value: str) -> DataFrame:
    """(term, ``value``): the counts (split, term, ``value``) of a term as a map by split.  A table dealt by term then joins
    it by the term alone and needs no shuffle, which a join by split and term would."""
    return counts.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("split", value))).alias(value))


def tf_rf_per_split(postings: DataFrame, doc_labels: DataFrame, splits: DataFrame, on: str = "doc_id") -> DataFrame:
    """Tf * rf for every split and label, with a and c counted among the split's own documents:
    (split, label, term, doc_id, weight).  Only the (term, label) pairs of a split with a > 0 are formed; of every other
    the weight is tf.  ``on`` names the column that postings, labels and splits share."""
    post = postings.select("term", "doc_id", "tf", *([on] if on != "doc_id" else [])).join(splits.select(on, "split"), on)
    a = post.join(doc_labels.select(on, "label"), on) \
        .groupBy("split", "term", "label").agg(F.count(F.lit(1)).alias("a"))
    df = by_split(post.groupBy("split", "term").agg(F.count(F.lit(1)).alias("df")), "df")
    rf = F.log2(F.lit(2.0) + F.col("a") / F.greatest(F.lit(1), F.element_at("df", F.col("split")) - F.col("a")))
    of = F.struct(F.col("split").alias("of"), "label", rf.alias("rf"))
    rfs = a.join(df, "term").groupBy("term").agg(F.collect_list(of).alias("rfs"))
    # the postings are streamed past the few labels of a term, not sorted
    own = F.explode(F.filter("rfs", lambda x: x["of"] == F.col("split"))).alias("r")
    return post.join(rfs.hint("shuffle_hash"), "term").select("split", "term", "doc_id", "tf", own) \
        .select("split", "r.label", "term", "doc_id", (F.col("tf") * F.col("r.rf")).alias("weight"))


def l2_tfidf(postings: DataFrame, dfreq: DataFrame, n: Column, min_df: int = 5) -> DataFrame:
    """Smoothed idf ln((1+N)/(1+df)) + 1 on terms with df >= min_df,
    then each document vector scaled to unit l2 norm.

    The norm is a grouped sum joined back (skew-safe: a huge document is
    split by the skew-join rule) rather than a window over the document."""
    kept = dfreq.filter(F.col("df") >= min_df)
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    raw = (postings.join(kept.select("term", "df"), "term")
           .select("term", "doc_id", "tf", (F.col("tf") * idf).alias("w")))
    norms = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return (raw.join(norms, "doc_id")
            .select("term", "doc_id", "tf", (F.col("w") / F.col("norm")).alias("weight")))


def doc_index(weights: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Term-doc weights pivoted to (doc_id, term_id, weight)."""
    return weights.join(dictionary.select("term", "term_id"), "term") \
        .select("doc_id", "term_id", "weight")
