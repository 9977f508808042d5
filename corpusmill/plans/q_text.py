"""Queries over the corpus: tokens, postings, weights, feature selection."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import stem as St
from corpusmill.functions import text as tx
from corpusmill.operators import postings as P
from corpusmill.operators import select as S
from corpusmill.operators import weights as Wt
from corpusmill.plans import fixtures as fx
from corpusmill.plans import q_splits as QS
from corpusmill.plans import sql as q
from corpusmill.plans.registry import query
from corpusmill.sources.io import table
from corpusmill.session import checkpoint_dir
from corpusmill.sources.stages import stage
from corpusmill.streaming import incremental as Inc

MIN_DOCUMENTS = 5          # F4: df strictly greater than this
TOP_N_FEATURES = 10_000    # K1 cut
TOP_TERMS_PER_DOC = 10
ROUND = 6


def _r(c):
    return F.round(c, ROUND)


def stored(spark, sf_dir, name, builder, tables=("documents",), buckets=None, **params):
    """A stage of the store whose manifest names these tables and parameters."""
    return stage(spark, name, [os.path.join(sf_dir, f"{t}.parquet") for t in tables], builder, params, buckets=buckets)


def stored_lengths(spark, sf_dir):
    """(doc_id, length in characters) of every document, with or without terms."""
    return stored(spark, sf_dir, "lengths", lambda: P.doc_lengths(fx.documents(spark, sf_dir), mode="chars"))


def average_chars(spark, sf_dir):
    return P.average_length(stored_lengths(spark, sf_dir))


def frequent(spark, sf_dir, fpost=None):
    """(N, frequent terms with df), a stage: counted from ``fpost``, where that is at hand, else from the texts."""
    n = P.n_docs(stored_lengths(spark, sf_dir))

    def build():
        if fpost is not None:
            return fpost.groupBy("term").agg(F.max("df").alias("df"))
        parts = fx.parts(fx.documents(spark, sf_dir))
        return P.frequent_terms(P.doc_freq(P.build_postings(fx.corpus(spark, sf_dir)), parts), MIN_DOCUMENTS, n)
    return n, stored(spark, sf_dir, "frequent-terms", build, min_documents=MIN_DOCUMENTS)


def _frequent_postings(spark, sf_dir, name, post, tables):
    """The frequent terms' postings with df, a stage in buckets by term: all postings are shuffled once and none are
    written but these, and what is counted or joined by term later (label counts, rf, weights) needs no shuffle."""
    # the more tasks they are dealt to, the less the few rows that a task sends to each compress
    parts, n = fx.parts(fx.documents(spark, sf_dir), fx.TERM_BYTES), P.n_docs(stored_lengths(spark, sf_dir))
    return stored(spark, sf_dir, name, lambda: P.frequent_postings(post, parts, MIN_DOCUMENTS, n), tables, (parts, "term"),
                  min_documents=MIN_DOCUMENTS)


def index_stats(spark, sf_dir):
    """Shared index pieces: corpus, postings, df, N, frequent terms and their postings with df (a stage)."""
    docs = fx.corpus(spark, sf_dir)
    post = P.build_postings(docs, keep_length=True)
    fpost = _frequent_postings(spark, sf_dir, "frequent-postings", post, ("documents",))
    n, freq = frequent(spark, sf_dir, fpost)
    return docs, post, P.doc_freq(post), n, freq, fpost


def labelled_stats(spark, sf_dir):
    """(N, frequent terms, their postings with df and ``kind``, the kinds of :func:`QS.document_kinds`): for what counts
    postings by label or split, which then joins the few kinds and not the documents."""
    of, kinds = QS.document_kinds(spark, sf_dir)
    docs = fx.corpus(spark, sf_dir).join(of.hint("shuffle_hash"), "doc_id", "left")
    fpost = _frequent_postings(spark, sf_dir, "kind-postings", P.build_postings(docs, keep_length=True, keep=("kind",)), ("documents", "labels"))
    n, freq = frequent(spark, sf_dir, fpost)
    return n, freq, fpost, kinds


@query("tokens_plain", f"""
WITH t AS (SELECT doc_id, {q.plain_tokens('text')} AS toks FROM documents)
SELECT doc_id, unnest(range(1, len(toks) + 1)) AS pos, unnest(toks) AS token FROM t""")
def tokens_plain(spark, sf_dir):
    docs = fx.corpus(spark, sf_dir)
    return P.token_table(docs, tx.plain_tokens(F.col("text")))


@query("tokens_bigrams", f"""
WITH {q.UNIGRAMS}, t AS (SELECT doc_id, list_concat(u, {q.bigrams('u')}) AS toks FROM uni)
SELECT doc_id, unnest(range(1, len(toks) + 1)) AS pos, unnest(toks) AS term FROM t""")
def tokens_bigrams(spark, sf_dir):
    docs = fx.corpus(spark, sf_dir)
    uni = docs.select("doc_id", tx.index_unigrams(F.col("text")).alias("u"))
    return P.token_table(uni, F.concat(F.col("u"), tx.bigrams(F.col("u"))), tok_col="term")


@query("postings", f"WITH {q.POSTINGS} SELECT term, doc_id, tf FROM postings")
def postings(spark, sf_dir):
    return P.build_postings(fx.corpus(spark, sf_dir))


@query("doc_freq", f"WITH {q.DFREQ} SELECT term, df FROM dfreq")
def doc_freq(spark, sf_dir):
    return P.doc_freq(P.build_postings(fx.corpus(spark, sf_dir)))


@query("doc_lengths", f"""
WITH {q.POSTINGS}, tl AS (SELECT doc_id, sum(tf) AS len_tf FROM postings GROUP BY doc_id)
SELECT d.doc_id, length(d.text) AS len_chars, coalesce(tl.len_tf, 0) AS len_tf
FROM documents d LEFT JOIN tl USING (doc_id)""")
def doc_lengths(spark, sf_dir):
    docs = fx.corpus(spark, sf_dir)
    post = P.build_postings(docs)
    chars = P.doc_lengths(docs, mode="chars").withColumnRenamed("length", "len_chars")
    tfl = P.doc_lengths(docs, post, mode="tf").withColumnRenamed("length", "len_tf")
    return chars.join(tfl, "doc_id", "left").fillna(0, ["len_tf"])


@query("min_df_terms", f"WITH {q.FREQ} SELECT term, df FROM freq")
def min_df_terms(spark, sf_dir):
    return frequent(spark, sf_dir)[1]


BM25_SQL = f"""{q.FREQ},
lens AS (SELECT doc_id, length(text) AS len FROM documents),
avgl AS (SELECT avg(len) AS a FROM lens),
bm AS (
  SELECT fp.term, fp.doc_id, fp.tf,
         greatest(0.0, log10((ndocs.n - fp.df + 0.5) / (fp.df + 0.5)))
         * (2.5 * fp.tf) / (1.5 * (0.25 + 0.75 * (lens.len / avgl.a)) + fp.tf) AS weight
  FROM fpost fp JOIN lens USING (doc_id), ndocs, avgl)"""


def _bm25(spark, sf_dir):
    docs, post, dfreq, n, freq, fpost = index_stats(spark, sf_dir)
    avg = average_chars(spark, sf_dir)
    return Wt.bm25(fpost, freq, None, n, avg)


@query("bm25_top_terms", f"""
WITH {BM25_SQL},
r AS (SELECT doc_id, term, round(weight, 6) AS weight,
             row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term) AS rank
      FROM bm)
SELECT doc_id, rank, term, weight FROM r WHERE rank <= {TOP_TERMS_PER_DOC}""")
def bm25_top_terms(spark, sf_dir):
    """The flagship: BM25 weights of frequent terms, 10 best per document."""
    bm = _bm25(spark, sf_dir).withColumn("weight", _r(F.col("weight")))
    # a document's rows are bounded by its vocabulary: one window, whose limit
    # Spark also applies before the shuffle
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), F.asc("term"))
    best = bm.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= TOP_TERMS_PER_DOC)
    return best.select("doc_id", "rank", "term", "weight")


def _tfidf_sql(expr):
    return f"""WITH {q.FREQ}
SELECT term, doc_id, round({expr}, 6) AS weight FROM fpost, ndocs"""


@query("tfidf", _tfidf_sql("tf * log10((ndocs.n + 1) / (df + 1))"))
def tfidf(spark, sf_dir):
    _, _, _, n, freq, fpost = index_stats(spark, sf_dir)
    return Wt.tfidf(fpost, freq, n).select("term", "doc_id", _r(F.col("weight")).alias("weight"))


@query("tfidf_intdiv", _tfidf_sql("tf * log10(CAST(floor((ndocs.n + 1) / (df + 1)) AS DOUBLE))"))
def tfidf_intdiv(spark, sf_dir):
    _, _, _, n, freq, fpost = index_stats(spark, sf_dir)
    return Wt.tfidf(fpost, freq, n, integer_division=True) \
        .select("term", "doc_id", _r(F.col("weight")).alias("weight"))


@query("sublinear_tfidf", _tfidf_sql("log10(1 + tf) * log10((ndocs.n + 1) / (df + 1))"))
def sublinear_tfidf(spark, sf_dir):
    _, _, _, n, freq, fpost = index_stats(spark, sf_dir)
    return Wt.tfidf(fpost, freq, n, sublinear=True) \
        .select("term", "doc_id", _r(F.col("weight")).alias("weight"))


@query("bm25", f"WITH {BM25_SQL} SELECT term, doc_id, round(weight, 6) AS weight FROM bm")
def bm25(spark, sf_dir):
    return _bm25(spark, sf_dir).select("term", "doc_id", _r(F.col("weight")).alias("weight"))


RF_SQL = f"""{q.FREQ},
a AS MATERIALIZED (SELECT fp.term, dl.label, count(*) AS a
      FROM fpost fp JOIN (SELECT doc_id, lang AS label FROM documents) dl USING (doc_id) GROUP BY fp.term, dl.label),
rf AS MATERIALIZED (SELECT a.term, a.label, a.a, f.df - a.a AS c,
              log2(2 + a.a / greatest(1, f.df - a.a)) AS rf
       FROM a JOIN freq f USING (term))"""


def _rf(spark, sf_dir):
    n, freq, fpost, kinds = labelled_stats(spark, sf_dir)
    return fpost, Wt.relevance_frequency(fpost, QS.kind_labels(kinds, 1), freq, on="kind")


@query("rf", f"WITH {RF_SQL} SELECT term, label, a, c, round(rf, 6) AS rf FROM rf")
def rf(spark, sf_dir):
    _, r = _rf(spark, sf_dir)
    return r.select("term", "label", "a", "c", _r(F.col("rf")).alias("rf"))


@query("tf_rf", f"""WITH {RF_SQL}
SELECT fp.term, fp.doc_id, round(fp.tf * coalesce(rf.rf, 1.0), 6) AS weight
FROM fpost fp LEFT JOIN (SELECT term, rf FROM rf WHERE label = 'en') rf USING (term)""")
def tf_rf(spark, sf_dir):
    fpost, r = _rf(spark, sf_dir)
    return Wt.tf_rf(fpost, r, "en").select("term", "doc_id", _r(F.col("weight")).alias("weight"))


@query("l2_tfidf", f"""
WITH t AS (SELECT doc_id, unnest({q.plain_tokens('text')}) AS term FROM documents),
p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY term, doc_id),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term HAVING count(*) >= 5),
{q.NDOCS},
w AS (SELECT p.term, p.doc_id, p.tf * (ln((1 + ndocs.n) / (1 + d.df)) + 1) AS w
      FROM p JOIN d USING (term), ndocs),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)
SELECT term, doc_id, round(w / norm, 6) AS weight FROM w JOIN nrm USING (doc_id)""")
def l2_tfidf(spark, sf_dir):
    docs = fx.corpus(spark, sf_dir)
    post = P.stored_postings(P.build_postings(docs, tx.plain_tokens(F.col("text"))))
    out = Wt.l2_tfidf(post, P.doc_freq(post), P.n_docs(fx.documents(spark, sf_dir)), min_df=5)
    return out.select("term", "doc_id", _r(F.col("weight")).alias("weight"))


CHI_SQL = f"""{q.FREQ}, {q.DOC_LABELS_SINGLE},
sub AS (SELECT doc_id, label FROM doc_labels WHERE level = 3),
sizes AS (SELECT label, count(*) AS s FROM sub GROUP BY label),
joint AS (SELECT fp.term, sub.label, count(*) AS n11 FROM fpost fp JOIN sub USING (doc_id)
          GROUP BY fp.term, sub.label),
pairs AS (
  SELECT f.term, f.df, sz.label, sz.s, coalesce(j.n11, 0) AS n11, ndocs.n AS n
  FROM freq f CROSS JOIN sizes sz CROSS JOIN ndocs
  LEFT JOIN joint j ON j.term = f.term AND j.label = sz.label
  WHERE sz.s < ndocs.n),
cells AS (
  SELECT term, df, n, s / n AS pc1, n11 / n AS p11, df / n AS pt1 FROM pairs),
chi AS (
  SELECT term, df,
         sum(pc1 * (n * power(p11 * (1 - (pt1 - p11) - (pc1 - p11) - p11) - (pt1 - p11) * (pc1 - p11), 2))
             / (pt1 * (1 - pt1) * pc1 * (1 - pc1))) AS chi
  FROM cells GROUP BY term, df),
best AS (
  SELECT term, df, round(chi, 4) AS chi,
         row_number() OVER (ORDER BY round(chi, 4) DESC, term) AS rank
  FROM chi)"""


def _chi_best(spark, sf_dir):
    n, freq, fpost, kinds = labelled_stats(spark, sf_dir)
    sub = fx.doc_labels_single(spark, sf_dir).filter(F.col("level") == 3)

    def build():
        # stored, so that the few sizes are known to be few
        sizes = stored(spark, sf_dir, "class-sizes", lambda: S.class_sizes(sub), ("documents", "labels"))
        chi = S.chi_squared(fpost, freq, QS.kind_labels(kinds, 3), n, on="kind", sizes=sizes).withColumn("chi", F.round("chi", 4))
        return S.top_terms(chi, TOP_N_FEATURES, decimals=4)
    return fpost, freq, n, stored(spark, sf_dir, "dictionary", build, ("documents", "labels"), features=TOP_N_FEATURES)


@query("chi_top_terms", f"WITH {CHI_SQL} SELECT rank, term, df, chi FROM best WHERE rank <= {TOP_N_FEATURES}")
def chi_top_terms(spark, sf_dir):
    return _chi_best(spark, sf_dir)[3].select("rank", "term", "df", "chi")


@query("chi_old", f"""WITH {q.FREQ}, {q.DOC_LABELS_SINGLE},
sizes AS (SELECT label, count(*) AS s FROM doc_labels WHERE level = 3 GROUP BY label),
cells AS (SELECT f.term, f.df, n.n, sz.s,
                 f.df * sz.s / n.n AS e1, (n.n - f.df) * sz.s / n.n AS e0
          FROM freq f CROSS JOIN sizes sz CROSS JOIN ndocs n)
SELECT term, df, round(sum(power(df - e1, 2) / e1 + power((n - df) - e0, 2) / e0), 4) AS chi
FROM cells GROUP BY term, df""")
def chi_old(spark, sf_dir):
    n, freq = frequent(spark, sf_dir)
    sub = fx.doc_labels_single(spark, sf_dir).filter(F.col("level") == 3)
    return S.chi_squared_old(freq, sub, n).select("term", "df", F.round("chi", 4).alias("chi"))


@query("term_dictionary", f"WITH {CHI_SQL} SELECT term, rank - 1 AS term_id FROM best WHERE rank <= {TOP_N_FEATURES}")
def term_dictionary(spark, sf_dir):
    return S.term_dictionary(_chi_best(spark, sf_dir)[3])


@query("dictionary_postings", f"""WITH {CHI_SQL}
SELECT fp.term, fp.doc_id, fp.tf FROM fpost fp JOIN (SELECT term FROM best WHERE rank <= {TOP_N_FEATURES}) USING (term)""")
def dictionary_postings(spark, sf_dir):
    """Postings of the selected terms (left semi join; the dictionary is bounded)."""
    fpost, _, _, best = _chi_best(spark, sf_dir)
    return P.restrict_terms(fpost, F.broadcast(S.term_dictionary(best))).select("term", "doc_id", "tf")


DOC_INDEX_SQL = f"""{CHI_SQL},
lens AS (SELECT doc_id, length(text) AS len FROM documents),
avgl AS (SELECT avg(len) AS a FROM lens),
dict AS (SELECT term, rank - 1 AS term_id FROM best WHERE rank <= {TOP_N_FEATURES}),
idx AS (SELECT fp.doc_id, dict.term_id,
        greatest(0.0, log10((ndocs.n - fp.df + 0.5) / (fp.df + 0.5)))
        * (2.5 * fp.tf) / (1.5 * (0.25 + 0.75 * (lens.len / avgl.a)) + fp.tf) AS weight
        FROM fpost fp JOIN dict USING (term) JOIN lens USING (doc_id), ndocs, avgl)"""


@query("doc_index", f"WITH {DOC_INDEX_SQL} SELECT doc_id, term_id, round(weight, 6) AS weight FROM idx")
def doc_index(spark, sf_dir):
    """T11+T12: chi-selected dictionary, reduced postings, BM25 doc index."""
    fpost, freq, n, best = _chi_best(spark, sf_dir)
    avg = average_chars(spark, sf_dir)
    # the join that numbers the terms is also the one that drops the others
    w = Wt.bm25(fpost, freq, None, n, avg)
    return Wt.doc_index(w, F.broadcast(S.term_dictionary(best))).select("doc_id", "term_id", _r(F.col("weight")).alias("weight"))


@query("feature_reorder", f"""WITH {BM25_SQL},
tot AS (SELECT term, round(sum(weight), 6) AS total FROM bm GROUP BY term)
SELECT term, total, row_number() OVER (ORDER BY total DESC, term) - 1 AS term_id FROM tot""")
def feature_reorder(spark, sf_dir):
    return S.reorder_by_total_weight(_bm25(spark, sf_dir)).select("term", "total", "term_id")


@query("word_search", f"WITH {q.TERMS} SELECT DISTINCT doc_id FROM terms WHERE term = 'tion'")
def word_search(spark, sf_dir):
    return P.word_search(P.build_postings(fx.corpus(spark, sf_dir)), "tion")


@query("top_df_terms", f"""WITH {q.DFREQ}
SELECT term, df FROM dfreq ORDER BY df DESC, term LIMIT 10""")
def top_df_terms(spark, sf_dir):
    """K4: the ten most frequent terms by document frequency."""
    d = P.doc_freq(P.build_postings(fx.corpus(spark, sf_dir)))
    return d.orderBy(F.desc("df"), F.asc("term")).limit(10)


@query("top_weights", f"""WITH {BM25_SQL}
SELECT term, doc_id, round(weight, 6) AS weight FROM bm
ORDER BY round(weight, 6) DESC, term, doc_id LIMIT 100""")
def top_weights(spark, sf_dir):
    """K5: the 100 highest weights of the whole doc index."""
    w = _bm25(spark, sf_dir).select("term", "doc_id", _r(F.col("weight")).alias("weight"))
    return w.orderBy(F.desc("weight"), "term", "doc_id").limit(100)


VOCAB_SIZE = 1000


@query("vocab_unk", f"""
WITH t AS (SELECT unnest({q.plain_tokens('text')}) AS word FROM documents),
c AS (SELECT word, count(*) AS n FROM t GROUP BY word),
r AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS word_id FROM c)
SELECT word, word_id, n FROM r WHERE word_id < {VOCAB_SIZE}
UNION ALL
SELECT 'UNK' AS word, 0 AS word_id, coalesce(sum(n), 0) AS n FROM r WHERE word_id >= {VOCAB_SIZE}""")
def vocab_unk(spark, sf_dir):
    """The V-1 most frequent words get ids 1..V-1; every other word is
    counted under UNK (id 0)."""
    docs = fx.corpus(spark, sf_dir)
    words = docs.select(F.explode(tx.plain_tokens(F.col("text"))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc("word")).limit(VOCAB_SIZE - 1)
    from pyspark.sql import Window
    top = top.withColumn("word_id", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("word"))))
    rest = counts.join(top.select("word"), "word", "left_anti") \
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    unk = rest.select(F.lit("UNK").alias("word"), F.lit(0).alias("word_id"), "n")
    return top.select("word", F.col("word_id").cast("int").alias("word_id"), "n").unionByName(unk)


CONTEXT_WINDOW = 2


@query("context_pairs", f"""
WITH t AS (SELECT doc_id, {q.plain_tokens('text')} AS toks FROM documents),
e AS (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM t),
p AS (SELECT toks[i] AS target, toks[j] AS context
      FROM (SELECT toks, i, unnest(range(greatest(1, i - {CONTEXT_WINDOW}), least(len(toks), i + {CONTEXT_WINDOW}) + 1)) AS j FROM e)
      WHERE j <> i)
SELECT target, context, count(*) AS n FROM p GROUP BY target, context""")
def context_pairs(spark, sf_dir):
    """(target, context) pairs within a fixed window, counted.

    For every offset o in 1..w the pairs are a shifted zip of the document's token array, so they are formed inside the
    row (no self join, no shuffle).  The window is the same on both sides: a pair of neighbours is two pairs of target and
    context with equal counts, so it is counted once, under its lesser word, and turned around after the shuffle."""
    docs = fx.corpus(spark, sf_dir)
    t = docs.select(tx.plain_tokens(F.col("text")).alias("toks"))
    pairs = _neighbours(lambda o: lambda a, b: F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))
    counts = t.select(F.explode(pairs).alias("p")).groupBy("p.lo", "p.hi").agg(F.count(F.lit(1)).alias("up"))
    return _both_ways(counts.withColumn("down", F.col("up")))


def _neighbours(pair):
    """``pair(offset)`` of the elements of ``toks`` that lie 1..w apart, the first one first."""
    toks, n = F.col("toks"), F.size("toks")
    zips = []
    for o in range(1, CONTEXT_WINDOW + 1):
        m = F.greatest(n - o, F.lit(0))
        zips.append(F.zip_with(F.slice(toks, 1, m), F.slice(toks, 1 + o, m), pair(o)))
    return F.concat(*zips)


def _both_ways(counts):
    """(target, context, n) from (lo, hi, up, down): ``up`` pairs have the target lo, ``down`` pairs the target hi."""
    def row(target, context, n):
        return F.struct(F.col(target).alias("target"), F.col(context).alias("context"), n.alias("n"))
    both = F.when(F.col("lo") == F.col("hi"), F.array(row("lo", "lo", F.col("up") + F.col("down")))) \
        .otherwise(F.array(row("lo", "hi", F.col("up")), row("hi", "lo", F.col("down"))))
    return counts.select(F.explode(both).alias("p")).select("p.target", "p.context", "p.n").filter(F.col("n") > 0)


# The window of a target, 1 to CONTEXT_WINDOW, drawn by a hash of its document and position.
REDUCED_SQL = q.md5_hash(7, "doc_id", "i")


@query("context_pairs_reduced", f"""
WITH t AS (SELECT doc_id, {q.plain_tokens('text')} AS toks FROM documents),
e AS (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM t),
w AS (SELECT toks, i, 1 + ascii(substr({REDUCED_SQL}, 1, 1)) % {CONTEXT_WINDOW} AS b FROM e),
p AS (SELECT toks[i] AS target, toks[j] AS context
      FROM (SELECT toks, i, unnest(range(greatest(1, i - b), least(len(toks), i + b) + 1)) AS j FROM w)
      WHERE j <> i)
SELECT target, context, count(*) AS n FROM p GROUP BY target, context""")
def context_pairs_reduced(spark, sf_dir):
    """W5, reduced window: each target's own window is drawn from 1..w by a hash.  As in :func:`context_pairs`, neighbours
    are shifted zips inside the row, counted once with both directions side by side; those beyond both words' windows are
    dropped there."""
    docs = fx.corpus(spark, sf_dir)
    t = docs.select("doc_id", tx.plain_tokens(F.col("text")).alias("toks"))
    drawn = F.transform("toks", lambda x, i: F.struct(x.alias("word"), (
        F.lit(1) + F.ascii(F.md5(F.concat_ws(":", F.lit("7"), F.col("doc_id").cast("string"), (i + 1).cast("string"))))
        % CONTEXT_WINDOW).alias("b")))

    def pair(o):
        def of(x, y):
            a, b = (F.when(w["b"] >= o, 1).otherwise(0) for w in (x, y))
            first = x["word"] <= y["word"]
            return F.struct(F.least(x["word"], y["word"]).alias("lo"), F.greatest(x["word"], y["word"]).alias("hi"),
                            F.when(first, a).otherwise(b).alias("up"), F.when(first, b).otherwise(a).alias("down"))
        return of
    pairs = F.filter(_neighbours(pair), lambda p: p["up"] + p["down"] > 0)
    e = t.select(drawn.alias("toks")).select(F.explode(pairs).alias("p"))
    return _both_ways(e.groupBy("p.lo", "p.hi").agg(F.sum("p.up").alias("up"), F.sum("p.down").alias("down")))


@query("natural_sort", """
WITH u AS (SELECT DISTINCT url FROM pages),
k AS (SELECT url, array_to_string(list_transform(regexp_extract_all(url, '[0-9]+|[^0-9]+'),
        lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN lpad(CAST(length(ltrim(x, '0')) AS VARCHAR), 10, '0') || ltrim(x, '0')
                  ELSE x END), '') AS k FROM u)
SELECT url, row_number() OVER (ORDER BY k, url) AS position FROM k""")
def natural_sort(spark, sf_dir):
    """K3: natural order of page urls.  A digit run is keyed by its number of
    digits without leading zeros and then those digits, so runs of any length
    compare as numbers."""
    urls = table(spark, sf_dir, "pages").select("url").distinct()
    runs = F.regexp_extract_all(F.col("url"), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    key = F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^[0-9]+$"), F.concat(
        F.lpad(F.length(F.ltrim(x, F.lit("0"))).cast("string"), 10, "0"), F.ltrim(x, F.lit("0")))).otherwise(x)), "")
    return S.global_rank(urls.withColumn("k", key), [F.asc("k"), F.asc("url")], "position") \
        .select("url", "position")


PUNCT_CLASS = r"[0-9!-/:-@\[-`{-~]"
STOP_EXTRA_SQL = "[" + ", ".join(q.lit(w) for w in tx.STOPWORDS + tx.EXTRA_STOPWORDS) + "]"


@query("tokens_nodigits", f"""
WITH t AS (SELECT doc_id, list_filter(list_filter(regexp_split_to_array(
              regexp_replace(lower(text), '{PUNCT_CLASS}', ' ', 'g'), {q.WS}), lambda x: x <> ''),
              lambda s: NOT list_contains({STOP_EXTRA_SQL}, s)) AS toks FROM documents)
SELECT doc_id, unnest(range(1, len(toks) + 1)) AS pos, unnest(toks) AS token FROM t""")
def tokens_nodigits(spark, sf_dir):
    """Digits and punctuation become spaces, split, stopwords (with the
    extra list) dropped; no lemmatizer."""
    docs = fx.corpus(spark, sf_dir)
    return P.token_table(docs, tx.digit_punct_tokens(F.col("text")))


@query("tokens_nodigits_stemmed")
def tokens_nodigits_stemmed(spark, sf_dir):
    """X12 with its stem step: the tokens of ``tokens_nodigits`` as Porter stems, valid ones only."""
    return P.token_table(fx.corpus(spark, sf_dir), St.digit_punct_stems(F.col("text")))


@query("incremental_doc_freq", f"WITH {q.DFREQ} SELECT term, df FROM dfreq")
def incremental_doc_freq(spark, sf_dir):
    """2.13: the documents' files ingested by a stream, one file an epoch, compacted, and df read from the sums."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/corpusmill-ingest-{uuid.uuid4().hex}"
    # a pattern, so that the table may be one file or a folder
    Inc.start_ingest(spark, os.path.join(sf_dir, "documents.parque[t]"), f"{base}/index", f"{base}/checkpoint",
                     max_files=1).awaitTermination()
    Inc.compact(spark, f"{base}/index")
    return Inc.read_df(spark, f"{base}/index")


@query("tokens_words", f"""
WITH t AS (SELECT doc_id, list_filter({q.stripped_list('text')}, lambda s: length(s) >= 3
             AND NOT list_contains({q.STOP}, s)) AS toks FROM documents)
SELECT doc_id, unnest(range(1, len(toks) + 1)) AS pos, unnest(toks) AS token FROM t""")
def tokens_words(spark, sf_dir):
    """X11: stripped words without stopwords and without indicators."""
    return P.token_table(fx.corpus(spark, sf_dir), tx.word_unigrams(F.col("text")))


@query("token_buckets", f"""
WITH t AS (SELECT unnest(string_split(text, ' ')) AS tok FROM documents)
SELECT CASE WHEN trim(tok) = '' THEN 'empty'
            WHEN {q.is_number('tok')} THEN 'number'
            WHEN list_contains({STOP_EXTRA_SQL}, tok) THEN 'stopword'
            ELSE 'word' END AS bucket, count(*) AS n
FROM t GROUP BY 1""")
def token_buckets(spark, sf_dir):
    """Raw space-separated tokens counted by bucket (empty, number,
    stopword, word)."""
    docs = fx.corpus(spark, sf_dir)
    toks = docs.select(F.explode(F.split(F.col("text"), " ")).alias("tok"))
    return toks.groupBy(tx.token_bucket(F.col("tok")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("valid_words", f"""
WITH t AS (SELECT unnest({q.plain_tokens('text')}) AS word FROM documents)
SELECT DISTINCT word FROM t
WHERE length(word) > 1 AND NOT {q.is_number('word')} AND NOT regexp_matches(word, '^[0-9]')""")
def valid_words(spark, sf_dir):
    """The distinct words that pass the valid-stem test."""
    docs = fx.corpus(spark, sf_dir)
    w = docs.select(F.explode(tx.plain_tokens(F.col("text"))).alias("word"))
    return w.filter(tx.is_valid_stem(F.col("word"))).distinct()


SENT_STRIP_SQL = q.lit(tx.SENTENCE_STRIP)
ABBR_SQL = "[" + ", ".join(q.lit(a) for a in tx.ABBREVIATIONS) + "]"
SW_PAT = q.lit(r"^([.,!?;:]*)(.+?)([.,!?;:]?)$")


def _sentence_words_sql(text: str) -> str:
    base = (f"list_filter(list_transform(list_filter(regexp_split_to_array({text}, {q.WS}), "
            f"lambda t: t <> ''), lambda t: trim(lower(t), {SENT_STRIP_SQL})), lambda s: s <> '')")
    mid = f"trim(regexp_extract(s, {SW_PAT}, 2), {SENT_STRIP_SQL})"
    lead = f"trim(regexp_extract(s, {SW_PAT}, 1), {SENT_STRIP_SQL})"
    tail = f"trim(regexp_extract(s, {SW_PAT}, 3), {SENT_STRIP_SQL})"
    split3 = (f"[{lead}, CASE WHEN list_contains({ABBR_SQL}, {mid}) THEN {mid} || {tail} ELSE {mid} END, "
              f"CASE WHEN list_contains({ABBR_SQL}, {mid}) THEN '' ELSE {tail} END]")
    per = (f"list_transform({base}, lambda s: CASE WHEN {q.is_number('s')} THEN ['num_indic'] "
           f"WHEN starts_with(s, '$') THEN ['curr_indic'] "
           f"WHEN ({q.hyphens('s')} > 2 AND length(s) >= 25) OR length(s) >= 40 THEN ['chem_indic'] "
           f"ELSE {split3} END)")
    return f"list_filter(flatten({per}), lambda x: x <> '')"


@query("tokens_sentence_words", f"""
WITH t AS (SELECT doc_id, {_sentence_words_sql('text')} AS toks FROM documents)
SELECT doc_id, unnest(range(1, len(toks) + 1)) AS pos, unnest(toks) AS token FROM t""")
def tokens_sentence_words(spark, sf_dir):
    """Words with their sentence punctuation as separate tokens;
    abbreviations keep the dot."""
    docs = fx.corpus(spark, sf_dir)
    return P.token_table(docs, tx.sentence_word_tokens(F.col("text")))
