"""Inverted index: postings, document frequency, lengths.

The index is a long table ``postings(term, doc_id, tf)``.  It is built with
one ``groupBy(term, doc_id)``; because a document's tokens sit in one input
partition, the map-side partial aggregate already collapses repeats, so the
shuffle carries at most one row per distinct (term, document).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as tx


def token_table(corpus: DataFrame, tokens: Column, id_col: str = "doc_id",
                pos_col: str = "pos", tok_col: str = "token") -> DataFrame:
    """Long (id, pos, token) table from a token-array expression; pos is
    1-based."""
    return corpus.select(F.col(id_col), F.posexplode(tokens).alias(pos_col, tok_col)) \
        .withColumn(pos_col, F.col(pos_col) + 1)


def build_postings(corpus: DataFrame, terms: Column | None = None,
                   id_col: str = "doc_id", text_col: str = "text",
                   keep_length: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(term, doc_id, tf) with tf = occurrences of term in doc.

    ``keep_length`` carries the document's character length on every
    posting (it is known while tokenizing), so length-normalized weights
    need no later join back to the documents; ``keep`` carries columns that depend on the document's id."""
    extra = [F.length(F.col(text_col)).cast("long").alias("length")] if keep_length else []
    extra += [F.col(c) for c in keep]
    names = (["length"] if keep_length else []) + list(keep)
    if terms is None:
        # unigrams are materialized once as a column; bigrams read that
        # column instead of re-running the tokenizer
        uni = corpus.select(F.col(id_col).alias("doc_id"), *extra,
                            tx.index_unigrams(F.col(text_col)).alias("__u"))
        exploded = uni.select("doc_id", *names, F.explode(
            F.concat(F.col("__u"), tx.bigrams(F.col("__u")))).alias("term"))
    else:
        exploded = corpus.select(F.col(id_col).alias("doc_id"), *extra,
                                 F.explode(terms).alias("term"))
    keys = ["term", "doc_id"] + names
    return exploded.groupBy(*keys).agg(F.count(F.lit(1)).alias("tf"))


def stored_postings(postings: DataFrame) -> DataFrame:
    """The postings written once as a Parquet table in the shared checkpoint
    folder, so tokenization runs exactly once however many branches of a
    plan read the index (df, the weight join, the label join), and a lost
    executor re-reads the stored postings instead of re-tokenizing.

    No repartition is added: a file scan does not report a partitioning, so
    a pre-shuffle by term would be paid and then forgotten.  df is a
    partial + final aggregate and the frequent-term join is broadcast when
    the measured term table is small (shuffled otherwise)."""
    from corpusmill.session import materialize
    return materialize(postings, "postings")


def doc_freq(postings: DataFrame, parts: int | None = None) -> DataFrame:
    """A2: (term, df).  Postings hold one row per (term, doc), so count(*)
    is the distinct-document count without a second distinct pass.

    With ``parts`` the terms are dealt to that many tasks before they are counted: most terms are rare, so counting them
    per split of the stored postings saves little and fills a table of the size of the split."""
    terms = postings.select("term")
    if parts:
        terms = terms.repartition(parts, "term")
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def doc_lengths(corpus: DataFrame, postings: DataFrame | None = None,
                mode: str = "chars", text_col: str = "text") -> DataFrame:
    """A3: (doc_id, length): characters of the text, or the sum of tf."""
    if mode == "chars":
        return corpus.select("doc_id", F.length(text_col).cast("long").alias("length"))
    if mode == "tf":
        return postings.groupBy("doc_id").agg(F.sum("tf").cast("long").alias("length"))
    raise ValueError(f"unknown length mode {mode!r}")


def average_length(lengths: DataFrame, integer_division: bool = False) -> Column:
    """A4: mean document length as a scalar subquery column.

    ``integer_division`` reproduces Python 2 ``sum/len`` on integers."""
    if integer_division:
        agg = lengths.select((F.sum("length") / F.count(F.lit(1))).cast("long")
                             .cast("double").alias("avg_len"))
    else:
        agg = lengths.select(F.avg("length").alias("avg_len"))
    return agg.scalar()


def n_docs(corpus: DataFrame) -> Column:
    """Corpus size N as a scalar subquery column (computed once)."""
    return corpus.select(F.count(F.lit(1))).scalar()


def frequent_terms(dfreq: DataFrame, min_df: int = 5, max_df: Column | int | None = None) -> DataFrame:
    """terms with df strictly greater than ``min_df`` and, when
    given, strictly below ``max_df`` (a term present everywhere breaks
    chi-squared)."""
    cond = F.col("df") > min_df
    if max_df is not None:
        cond = cond & (F.col("df") < max_df)
    return dfreq.filter(cond)


def frequent_postings(postings: DataFrame, parts: int, min_df: int = 5, max_df: Column | int | None = None) -> DataFrame:
    """The postings of the frequent terms with ``df``.  The postings (term, doc_id, ..., tf) are dealt by term to
    ``parts`` tasks once: the count of the terms and the join with the frequent ones read the same shuffle.  A task keeps
    the frequent terms of its part in a hash table, a small share of the postings, which need no sort.

    The count looks at every column (each posting has tf > 0), since Spark writes a second shuffle for a branch that
    reads fewer columns."""
    dealt = postings.repartition(parts, "term")
    counted = F.col("tf") > 0
    for c in postings.columns:
        counted = counted | F.col(c).isNull()
    dfreq = dealt.groupBy("term").agg(F.count(F.when(counted, 1)).alias("df"))
    return dealt.join(frequent_terms(dfreq, min_df, max_df).hint("shuffle_hash"), "term")


def restrict_terms(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the given terms only (left semi join)."""
    return postings.join(terms.select("term"), "term", "left_semi")


def restrict_docs(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Postings of the given documents only (left semi join)."""
    return postings.join(docs.select("doc_id"), "doc_id", "left_semi")



def word_search(postings: DataFrame, word: str) -> DataFrame:
    """Ids of documents containing a word."""
    return postings.filter(F.col("term") == word).select("doc_id")
