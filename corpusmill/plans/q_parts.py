"""Queries over the document part hierarchy (documents table)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators import parts as Pt
from corpusmill.plans import fixtures as fx
from corpusmill.plans import sql as q
from corpusmill.plans.registry import query

N_CHUNKS = 4            # chunks per document (chunked hierarchy of the reference)
BATCH_TOKENS = 10_000   # token batch size for long documents


def _plain(c):
    return tx.plain_tokens(c)


LINE_TRIM_SQL = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
PARAS_SQL = (f"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {LINE_TRIM_SQL})), "
             "lambda x: x <> '')")
SENT_TRIM_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def sentences_sql(text: str) -> str:
    known = r"(?i)(^|[ \t\n\r\f\x0B(])(" + Pt.ABBREVIATION_ALTS + r")\."
    prot = f"regexp_replace({text}, {q.lit(known)}, '\\1\\2' || chr(2), 'g')"
    cut = f"regexp_replace({prot}, '([.!?])[ \\t\\n\\r\\f\\x0B]+', '\\1' || chr(1), 'g')"
    return (f"list_filter(list_transform(string_split({cut}, chr(1)), "
            f"lambda s: trim(replace(s, chr(2), '.'), {SENT_TRIM_SQL})), lambda s: s <> '')")


def chunk_sql(toks: str, parts: int) -> str:
    n = f"len({toks})"
    size = f"CAST(floor({n} / {parts}) AS BIGINT)"
    start = f"(CASE WHEN {size} = 0 THEN 0 ELSE (i - 1) * {size} END)"
    ln = (f"(CASE WHEN {size} = 0 THEN (CASE WHEN i = 1 THEN {n} ELSE 0 END) "
          f"WHEN i = {parts} THEN {n} - (i - 1) * {size} ELSE {size} END)")
    return (f"list_transform(range(1, {parts + 1}), lambda i: "
            f"{{'part_no': i, 'tokens': list_slice({toks}, {start} + 1, {start} + {ln})}})")


@query("paragraphs_lines", f"""WITH p AS (SELECT doc_id, {PARAS_SQL} AS ps FROM documents)
SELECT doc_id, unnest(range(1, len(ps) + 1)) AS part_no, unnest(ps) AS paragraph FROM p""")
def paragraphs_lines(spark, sf_dir):
    """Paragraph parts: trimmed non-blank lines."""
    d = fx.corpus(spark, sf_dir)
    return d.select("doc_id", F.posexplode(Pt.paragraphs(F.col("text"))).alias("part_no", "paragraph")) \
        .withColumn("part_no", F.col("part_no") + 1)


@query("chunks", f"""WITH t AS (SELECT doc_id, {q.plain_tokens('text')} AS toks FROM documents),
c AS (SELECT doc_id, unnest({chunk_sql('toks', N_CHUNKS)}) AS c FROM t)
SELECT doc_id, c.part_no AS part_no, len(c.tokens) AS n_tokens, array_to_string(c.tokens, ' ') AS chunk_text FROM c""")
def chunks(spark, sf_dir):
    """Four chunks of every document's tokens."""
    d = fx.corpus(spark, sf_dir).select("doc_id", _plain(F.col("text")).alias("toks"))
    c = d.select("doc_id", F.explode(Pt.chunks(F.col("toks"), N_CHUNKS)).alias("c"))
    return c.select("doc_id", F.col("c.part_no").alias("part_no"),
                    F.size("c.tokens").alias("n_tokens"),
                    F.array_join("c.tokens", " ").alias("chunk_text"))


@query("token_batches", f"""WITH t AS (SELECT doc_id, {q.plain_tokens('text')} AS toks FROM documents),
b AS (SELECT doc_id, toks, unnest(range(0, greatest(CAST(ceil(len(toks) / {BATCH_TOKENS}) AS BIGINT), 1))) AS i FROM t),
s AS (SELECT doc_id, i + 1 AS batch_no, list_slice(toks, i * {BATCH_TOKENS} + 1, (i + 1) * {BATCH_TOKENS}) AS bt FROM b)
SELECT doc_id, batch_no, len(bt) AS n_tokens, bt[1] AS first_token, bt[-1] AS last_token FROM s""")
def token_batches(spark, sf_dir):
    """Batches of at most 10,000 tokens per document."""
    d = fx.corpus(spark, sf_dir).select("doc_id", _plain(F.col("text")).alias("toks"))
    b = d.select("doc_id", F.explode(Pt.token_batches(F.col("toks"), BATCH_TOKENS)).alias("b"))
    return b.select("doc_id", F.col("b.batch_no").alias("batch_no"),
                    F.size("b.tokens").alias("n_tokens"),
                    F.try_element_at("b.tokens", F.lit(1)).alias("first_token"),     # none in a batch without tokens
                    F.try_element_at("b.tokens", F.lit(-1)).alias("last_token"))


PARTS_SQL = f"""t AS (SELECT doc_id, {q.plain_tokens('text')} AS toks, {PARAS_SQL} AS ps FROM documents),
parts AS (
  SELECT doc_id, 1 AS part_order, 'doc' AS part_type, 0 AS part_no, len(toks) AS n_tokens FROM t
  UNION ALL
  SELECT doc_id, 1 + i AS part_order, 'paragraph', i, len({q.plain_tokens('ps[i]')})
  FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM t)
  UNION ALL
  SELECT doc_id, 1 + len(ps) + c.part_no, 'chunk', c.part_no, len(c.tokens)
  FROM (SELECT doc_id, ps, unnest({chunk_sql('toks', N_CHUNKS)}) AS c FROM t))"""


@query("part_positions", f"""WITH {PARTS_SQL}
SELECT doc_id, part_order, part_type, part_no, n_tokens,
       coalesce(sum(n_tokens) OVER (PARTITION BY doc_id ORDER BY part_order
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS token_offset
FROM parts""")
def part_positions(spark, sf_dir):
    """Part sizes and running token offsets in each document."""
    parts = Pt.part_table(fx.corpus(spark, sf_dir), _plain, N_CHUNKS)
    return Pt.part_positions(parts)


@query("part_stats", f"""WITH p AS (SELECT doc_id, len({PARAS_SQL}) AS np, len({sentences_sql('text')}) AS ns FROM documents)
SELECT CAST(floor(quantile_cont(np, 0.5)) AS BIGINT) AS p50_paragraphs, max(np) AS max_paragraphs,
       CAST(floor(quantile_cont(ns, 0.5)) AS BIGINT) AS p50_sentences, max(ns) AS max_sentences FROM p""")
def part_stats(spark, sf_dir):
    """50th percentile (truncated) and maximum of paragraphs and
    sentences per document."""
    d = fx.corpus(spark, sf_dir).select(F.size(Pt.paragraphs(F.col("text"))).alias("np"),
                                        F.size(Pt.sentences(F.col("text"))).alias("ns"))
    return d.agg(F.floor(F.percentile("np", 0.5)).cast("long").alias("p50_paragraphs"),
                 F.max("np").alias("max_paragraphs"),
                 F.floor(F.percentile("ns", 0.5)).cast("long").alias("p50_sentences"),
                 F.max("ns").alias("max_sentences"))


@query("sequence_pad", f"""WITH t AS (SELECT doc_id, list_transform({PARAS_SQL}, lambda p: len({q.plain_tokens('p')})) AS sizes FROM documents),
m AS (SELECT CAST(floor(quantile_cont(len(sizes), 0.5)) AS BIGINT) AS l FROM t),
s AS (SELECT doc_id, list_concat(list_slice(sizes, 1, m.l),
                                 list_transform(range(0, greatest(m.l - len(list_slice(sizes, 1, m.l)), 0)), lambda x: 0)) AS seq FROM t, m)
SELECT doc_id, unnest(range(1, len(seq) + 1)) AS pos, unnest(seq) AS n_tokens FROM s""")
def sequence_pad(spark, sf_dir):
    """Paragraph token counts per document truncated or zero-padded to
    the median number of paragraphs (a scalar subquery)."""
    d = fx.corpus(spark, sf_dir).select(
        "doc_id", F.transform(Pt.paragraphs(F.col("text")), lambda p: F.size(_plain(p))).alias("sizes"))
    length = d.select(F.floor(F.percentile(F.size("sizes"), 0.5)).cast("int")).scalar()
    seq = Pt.padded_sequence(F.col("sizes"), length, 0)
    return d.select("doc_id", F.posexplode(seq).alias("pos", "n_tokens")) \
        .withColumn("pos", F.col("pos") + 1)


@query("sentences", f"""WITH s AS (SELECT doc_id, {sentences_sql('text')} AS ss FROM documents)
SELECT doc_id, unnest(range(1, len(ss) + 1)) AS pos, unnest(ss) AS sentence FROM s""")
def sentences(spark, sf_dir):
    """Rule-based sentences with the abbreviation list."""
    d = fx.corpus(spark, sf_dir)
    return d.select("doc_id", F.posexplode(Pt.sentences(F.col("text"))).alias("pos", "sentence")) \
        .withColumn("pos", F.col("pos") + 1)


MERGED_SQL = f"""
WITH d AS (SELECT doc_id, {sentences_sql('text')} AS ss FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ss) + 1)) AS pos, unnest(ss) AS x FROM d),
k AS (SELECT *, sum(CASE WHEN length(x) < {tx.MIN_SENTENCE_LENGTH} OR (length(x) < {tx.MAX_TABLE_ROW_LENGTH}
        AND length(x) - length(replace(x, '.', '')) > 2) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM s),
t AS (SELECT doc_id, g, CASE WHEN g = 0 THEN ' ' ELSE '' END || string_agg(x, ' ' ORDER BY pos) AS txt FROM k GROUP BY doc_id, g),
lead AS (SELECT doc_id, txt FROM t WHERE g = 0 AND length(txt) < {tx.MIN_SENTENCE_LENGTH}
         AND doc_id IN (SELECT doc_id FROM t WHERE g = 1)),
m AS (SELECT t.doc_id, g, CASE WHEN g = 1 AND lead.txt IS NOT NULL THEN lead.txt || ' ' || t.txt ELSE t.txt END AS sentence
      FROM t LEFT JOIN lead USING (doc_id) WHERE NOT (g = 0 AND lead.txt IS NOT NULL))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS pos, sentence FROM m"""


@query("merged_sentences", MERGED_SQL)
def merged_sentences(spark, sf_dir):
    """Short sentences merged into their neighbours."""
    d = fx.corpus(spark, sf_dir)
    return d.select("doc_id", F.posexplode(Pt.merge_short(Pt.sentences(F.col("text")))).alias("pos", "sentence")) \
        .withColumn("pos", F.col("pos") + 1)


@query("sentence_stats", f"""WITH s AS (SELECT doc_id, {sentences_sql('text')} AS ss FROM documents)
SELECT doc_id, len(ss) AS n_sentences,
       len(list_filter(ss, lambda x: length(x) < 5)) AS n_short,
       coalesce(list_max(list_transform(ss, lambda x: length(x))), 0) AS max_len
FROM s""")
def sentence_stats(spark, sf_dir):
    """Sentences per document, sentences under 5 characters, longest."""
    d = fx.corpus(spark, sf_dir).select("doc_id", Pt.sentences(F.col("text")).alias("ss"))
    lens = F.transform("ss", lambda x: F.length(x))
    return d.select("doc_id", F.size("ss").alias("n_sentences"),
                    F.size(F.filter("ss", lambda x: F.length(x) < 5)).alias("n_short"),
                    F.coalesce(F.array_max(lens), F.lit(0)).alias("max_len"))


@query("fewest_sentences", f"""WITH s AS (SELECT doc_id, len({sentences_sql('text')}) AS n FROM documents)
SELECT doc_id, n AS n_sentences FROM s ORDER BY n, doc_id LIMIT 20""")
def fewest_sentences(spark, sf_dir):
    """K7: the 20 documents with the fewest sentences."""
    d = fx.corpus(spark, sf_dir).select("doc_id", F.size(Pt.sentences(F.col("text"))).alias("n_sentences"))
    return d.orderBy("n_sentences", "doc_id").limit(20)


@query("text_checks", f"""
SELECT doc_id, trim(text, {SENT_TRIM_SQL}) = '' AS is_blank,
       len(list_filter({PARAS_SQL}, lambda x: length(x) < 20)) AS n_short_lines,
       length(regexp_replace(text, chr(10), ' ', 'g')) AS clean_chars
FROM documents""")
def text_checks(spark, sf_dir):
    """Blank texts, lines under 20 characters, newline cleaning."""
    d = fx.corpus(spark, sf_dir)
    return d.select("doc_id",
                    (F.btrim("text", F.lit(" \t\n\r\x0b\x0c")) == "").alias("is_blank"),
                    F.size(F.filter(Pt.paragraphs(F.col("text")), lambda x: F.length(x) < 20)).alias("n_short_lines"),
                    F.length(F.regexp_replace("text", "\n", " ")).alias("clean_chars"))


@query("docs_only", """SELECT doc_id, text FROM documents WHERE position('_' IN CAST(doc_id AS VARCHAR)) = 0""")
def docs_only(spark, sf_dir):
    """Whole-document entities (ids without an underscore)."""
    d = fx.corpus(spark, sf_dir)
    return d.filter(~F.col("doc_id").cast("string").contains("_")).select("doc_id", "text")


@query("entity_ids", f"""WITH p AS (SELECT doc_id, {PARAS_SQL} AS ps FROM documents),
e AS (SELECT CAST(doc_id AS VARCHAR) || '_p' || CAST(unnest(range(1, len(ps) + 1)) AS VARCHAR) AS entity_id FROM p)
SELECT entity_id, split_part(entity_id, '_', 1) AS doc_id, len(string_split(entity_id, '_')) AS level,
       substr(split_part(entity_id, '_', 2), 1, 1) AS part_letter
FROM e WHERE len(string_split(entity_id, '_')) = 2 AND substr(split_part(entity_id, '_', 2), 1, 1) = 'p'""")
def entity_ids(spark, sf_dir):
    """Paragraph entity ids ``<doc>_p<n>`` parsed back into the doc
    id and the level (number of ``_`` parts), filtered by level and the
    first letter of the part."""
    d = fx.corpus(spark, sf_dir)
    e = d.select("doc_id", F.posexplode(Pt.paragraphs(F.col("text"))).alias("i", "p")).select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_p"), (F.col("i") + 1).cast("string")).alias("entity_id"))
    parts = F.split("entity_id", "_")
    out = e.select("entity_id", parts[0].alias("doc_id"), F.size(parts).alias("level"),
                   F.substring(parts[1], 1, 1).alias("part_letter"))
    return out.filter((F.col("level") == 2) & (F.col("part_letter") == "p"))


@query("split_subset", """SELECT d.doc_id, d.lang FROM documents d
WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def split_subset(spark, sf_dir):
    """The corpus rows of a document-id subset (here the documents
    judged quality 1), taken with a left semi join."""
    from corpusmill.sources.io import table
    keep = table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(keep, "doc_id", "left_semi")
