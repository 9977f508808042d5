"""V1: Porter stemmer over token arrays.

A document's tokens are stemmed in one Arrow UDF call per batch, with a bounded
cache of words per worker; everything before and after stays in the JVM.

The algorithm is the published one (M.F. Porter, "An algorithm for suffix
stripping", 1980); its suffix tables below are the paper's.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as tx

# Suffix rules of the Porter (1980) paper, steps 2, 3 and 4.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
         ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
         ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
         ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
         ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
         ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
         "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _is_cons(w: str, i: int) -> bool:
    c = w[i]
    if c in "aeiou":
        return False
    if c == "y":
        return i == 0 or not _is_cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    m, prev_vowel = 0, False
    for i in range(len(stem)):
        cons = _is_cons(stem, i)
        if cons and prev_vowel:
            m += 1
        prev_vowel = not cons
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _is_cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _is_cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return (n >= 3 and _is_cons(w, n - 3) and not _is_cons(w, n - 2) and _is_cons(w, n - 1)
            and w[-1] not in "wxy")


def porter(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    # step 1a
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # step 1b
    extra = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suf in ("ed", "ing"):
            if w.endswith(suf) and _has_vowel(w[:-len(suf)]):
                w, extra = w[:-len(suf)], True
                break
    if extra:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    # step 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # steps 2 and 3
    for table in (STEP2, STEP3):
        for suf, rep in sorted(table, key=lambda r: -len(r[0])):
            if w.endswith(suf):
                if _measure(w[:-len(suf)]) > 0:
                    w = w[:-len(suf)] + rep
                break
    # step 4
    for suf in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suf):
            stem = w[:-len(suf)]
            if _measure(stem) > 1 and (suf != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    # step 5
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            w = stem
    if _measure(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w


INDICATORS = frozenset((tx.INDEX_NUMBER, tx.INDEX_CURRENCY, tx.INDEX_CHEMICAL))
_cached_porter = lru_cache(200_000)(porter)


def _stem_lists(lists: pd.Series) -> pd.Series:
    return lists.map(lambda ws: None if ws is None else [w if w in INDICATORS else _cached_porter(w) for w in ws])


def stemmed_unigrams(text: Column, min_size: int = 3) -> Column:
    """The index tokens of a text, stemmed.

    Tokens of any length come from the JVM tokenizer; one Arrow UDF stems each
    document's token array (distinct words are cached per worker, indicators stay
    as they are); then the stem is stripped again and short ones are
    dropped."""
    udf = F.pandas_udf(_stem_lists, "array<string>")
    stems = udf(tx.index_unigrams(text, min_size=1))
    return F.filter(F.transform(stems, lambda s: tx.strip_chars(s)), lambda s: F.length(s) >= min_size)


def stemmed_postings(corpus: DataFrame, min_size: int = 3, parts: int | None = None) -> DataFrame:
    """V1: (term, doc_id, tf) over stems and pairs of neighbouring kept stems.

    With ``parts`` the stems are dealt by document to that many tasks: Spark does not know that the texts were, once they
    have been through Python, and would shuffle the postings, which are several times as large."""
    uni = corpus.select("doc_id", stemmed_unigrams(F.col("text"), min_size).alias("u"))
    if parts:
        uni = uni.repartition(parts, "doc_id")
    terms = uni.select("doc_id", F.explode(F.concat("u", tx.bigrams(F.col("u")))).alias("term"))
    return terms.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def digit_punct_stems(text: Column) -> Column:
    """:func:`corpusmill.functions.text.digit_punct_tokens`, stemmed; stems that fail X14 are dropped."""
    stems = F.pandas_udf(_stem_lists, "array<string>")(tx.digit_punct_tokens(text))
    return F.filter(stems, tx.is_valid_stem)
