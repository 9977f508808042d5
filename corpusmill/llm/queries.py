"""Registered queries ``op1_`` to ``op13_`` over whole tables, with the oracle
SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from corpusmill.llm.decontaminate import decontaminate
from corpusmill.llm.jaccard import jaccard_classes
from corpusmill.llm.common import text_of
from corpusmill.llm.ngramlm import score, train
from corpusmill.llm.phrases import collocations, phrase_counts
from corpusmill.llm.pieces import encode_decode
from corpusmill.llm.pivots import near_vectors
from corpusmill.llm.quality import quality
from corpusmill.llm.repeats import remove_repeats
from corpusmill.llm.secrets import find_secrets
from corpusmill.llm.sharding import shard_by_size
from corpusmill.llm.turns import damage, every_conversation, repair, summaries
from corpusmill.llm.urlfilter import host_of, judge_urls, path_of
from corpusmill.llm.warc import archive_pages
from corpusmill.sources.io import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ---- op2 ----------------------------------------------------------------

URL_SQL = """
WITH rest AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0
    THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, url,
    translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
listed AS (SELECT DISTINCT host || path AS k FROM p WHERE regexp_matches(url, '[?&]ref=')),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN host || path IN (SELECT k FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


@query("op2_url_filter", URL_SQL)
def op2(spark, sf_dir):
    """Rules, then a Bloom filter cascade over all host + path keys; listed
    are the keys that any page reaches through a referral link."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    key = F.concat(host_of(F.col("url")), path_of(F.col("url")))
    listed = pages.filter(F.col("url").rlike("[?&]ref=")).select(key.alias("key"))
    return judge_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


# ---- op7 ----------------------------------------------------------------

QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
      [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT r, g FROM tri GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM tri JOIN dup USING (r, g), (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
ln AS (SELECT r, regexp_replace(lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), '[0-9]+', '0', 'g') AS h,
       len([x FOR x IN string_split_regex(l, '[\x20\x09-\x0D]+') IF x <> '']) AS n
       FROM (SELECT r, unnest(ls) AS l FROM w)),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
freq AS (SELECT d.source, h FROM ln JOIN d USING (r) JOIN hosts ON hosts.source IS NOT DISTINCT FROM d.source
         GROUP BY d.source, h, hosts.n HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > hosts.n * 0.1),
cut AS (SELECT r, sum(ln.n) AS n FROM ln JOIN d USING (r)
        JOIN freq ON freq.source IS NOT DISTINCT FROM d.source AND freq.h = ln.h GROUP BY r),
s AS (SELECT d.r, doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
      len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(cut.n, 0) AS n_cut
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN cut USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - n_cut >= n_words * 0.5 AS kept FROM f
"""


@query("op7_quality_rules", QUALITY_SQL)
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality(docs).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols",
                                "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# ---- op1 ----------------------------------------------------------------

LEAK_SQL = r"""
WITH lo AS (SELECT row_number() OVER () AS r, doc_id, [x FOR x IN string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
it AS (SELECT item_id, [x FOR x IN string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark),
iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM it WHERE len(w) > 0)),
spans AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lo, spans)),
hit AS (SELECT r, dw.n, i, item FROM dw JOIN iw ON iw.g = dw.g AND iw.n = dw.n),
agg AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS k FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lo LEFT JOIN agg USING (r) LEFT JOIN its USING (r)
"""


@query("op1_decontamination", LEAK_SQL)
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


# ---- op9 ----------------------------------------------------------------

@query("op9_sharding")
def op9(spark, sf_dir):
    got = shard_by_size(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)
    return got.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      "slot", F.lit(None).cast("int").alias("grown_shard"))


# ---- op10 ---------------------------------------------------------------

WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN m ON m.d = p.d AND p.n >= 1000
"""


@query("op10_warc", WARC_SQL)
def op10(spark, sf_dir):
    """Digest and size of a response come from the payload read back, those
    of a revisit from its headers."""
    got = archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select(F.col("id").alias("page_id"),
                      F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
                      F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"),
                      F.col("type").alias("record_type"), "refers_to")


# ---- op6 ----------------------------------------------------------------

@query("op6_pieces")
def op6(spark, sf_dir, model: str = "piece_bpe_32k.model"):
    import public_tokenizers
    got = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(model))
    return got.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


# ---- op8 ----------------------------------------------------------------

@query("op8_jaccard_join")
def op8(spark, sf_dir):
    got = jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies")


# ---- op4 ----------------------------------------------------------------

@query("op4_secret_scan")
def op4(spark, sf_dir):
    got = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def n(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return got.select(F.col("id").alias("doc_id"), n("assign"), n("access"), n("hex"),
                      F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


# ---- op3 ----------------------------------------------------------------

@query("op3_lm_score")
def op3(spark, sf_dir, order: int = 3):
    """Trains on the documents that the hold-out rule leaves, scores all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(text_of(F.col("doc_id").cast("string")).cast("binary")) % 7 == 2
    model = train(docs.filter(~held), order=order)
    got = score(docs, model).withColumnRenamed("id", "doc_id")
    back = F.crc32(text_of(F.col("doc_id").cast("string")).cast("binary")) % 7 == 2
    return got.select("doc_id", back.alias("held_out"), "n_tokens", "n_known",
                      F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


# ---- op5 ----------------------------------------------------------------

@query("op5_repeats")
def op5(spark, sf_dir):
    got = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(F.col("id").alias("doc_id"), "n_bytes",
                      (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                      (F.size("spans") > 0).alias("repeats"))


# ---- op11 ---------------------------------------------------------------

NEAR_SQL = """
WITH RECURSIVE src AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT row_number() OVER () AS r, vec_id, v FROM src WHERE v IS NOT NULL AND len(v) > 0
       AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND list_dot_product(v, v) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.v) = len(b.v)
          AND list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.95),
reach AS (SELECT r AS a, r AS b FROM ok UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT reach.a AS r, min(vec_id) AS component_id FROM reach JOIN ok ON ok.r = reach.b GROUP BY reach.a),
n AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a),
good AS (SELECT ok.vec_id, coalesce(n_links, 0) AS n_links, component_id
         FROM ok JOIN comp USING (r) LEFT JOIN n USING (r)),
bad AS (SELECT vec_id, 0 AS n_links, vec_id AS component_id FROM src WHERE NOT coalesce(len(v) > 0
        AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND list_dot_product(v, v) > 0, false))
SELECT vec_id, n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM (SELECT * FROM good UNION ALL SELECT * FROM bad)
"""


@query("op11_pivot_index", NEAR_SQL)
def op11(spark, sf_dir):
    got = near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return got.select(F.col("id").alias("vec_id"), "n_links", "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


# ---- op12 ---------------------------------------------------------------

@query("op12_conversation_repair")
def op12(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    got = every_conversation(summaries(repair(damage(turns))), turns)
    return got.withColumnsRenamed({"conv": "conv_id", "digest": "repaired_sha256"})


# ---- op13 ---------------------------------------------------------------

PHRASE_SQL = r"""
WITH p AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
tot AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS c FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2),
        lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
      GROUP BY lang, k, phrase HAVING count(*) >= 10),
cand AS (SELECT lang, phrase, k AS m, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, m, a, w, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:m], ' ') AS y
         FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scored AS (SELECT cuts.lang, cuts.phrase, a, min({'s': (1000000::HUGEINT * a * a) // (l.c::HUGEINT * r.c), 'k': cuts.k, 'l': l.c, 'r': r.c}) AS b
           FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y
           GROUP BY cuts.lang, cuts.phrase, a),
around AS (SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM cand WHERE m = 3)
    GROUP BY lang, phrase),
ranked AS (SELECT s.lang, s.phrase, s.a, b, row_number() OVER (PARTITION BY s.lang ORDER BY b.s DESC, s.a DESC, s.phrase) AS rank
           FROM scored s LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * s.a)
SELECT lang, rank, phrase, a, b.l AS l, b.r AS r, n, b.s::BIGINT AS score FROM ranked JOIN tot USING (lang) WHERE rank <= 2000
"""


@query("op13_phrase_mining", PHRASE_SQL)
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return collocations(phrase_counts(docs)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


# ---- pipeline -----------------------------------------------------------

@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
