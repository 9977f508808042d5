"""DuckDB SQL fragments for the oracles, written from the same fixed values
as the Spark expressions (``corpusmill.functions.text``)."""

from __future__ import annotations

from corpusmill.functions import text as tx


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = lit(tx.WHITESPACE)
PUNCT = lit(tx.PUNCTUATION)
NUM_RE = lit(r"(?i)[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|nan|inf|infinity)")
STOP = "[" + ", ".join(lit(w) for w in tx.STOPWORDS) + "]"


def is_number(x: str) -> str:
    return f"regexp_full_match(replace({x}, ',', ''), {NUM_RE})"


def hyphens(x: str) -> str:
    return f"(length({x}) - length(replace({x}, '-', '')))"


def stripped_list(text: str) -> str:
    """Whitespace split, lower, strip punctuation, drop empties."""
    return (f"list_filter(list_transform(list_filter(regexp_split_to_array({text}, {WS}), "
            f"lambda t: t <> ''), lambda t: trim(lower(t), {PUNCT})), lambda s: s <> '')")


def plain_tokens(text: str, min_size: int = 1) -> str:
    inner = stripped_list(text)
    mapped = (f"list_transform({inner}, lambda s: CASE WHEN {is_number('s')} THEN 'num_indic' "
              f"WHEN starts_with(s, '$') THEN 'curr_indic' "
              f"WHEN {hyphens('s')} > 3 THEN 'chem_indic' ELSE s END)")
    return f"list_filter({mapped}, lambda s: length(s) >= {min_size})"


def index_unigrams(text: str, min_size: int = 3) -> str:
    inner = stripped_list(text)
    mapped = (f"list_transform({inner}, lambda s: CASE WHEN {is_number('s')} THEN 'number_inidicator' "
              f"WHEN starts_with(s, '$') THEN 'currency_inidicator' "
              f"WHEN {hyphens('s')} > 3 THEN 'chemical_inidicator' "
              f"WHEN list_contains({STOP}, s) THEN NULL ELSE s END)")
    return f"list_filter({mapped}, lambda s: s IS NOT NULL AND length(s) >= {min_size})"


def bigrams(u: str) -> str:
    return f"list_transform(range(2, len({u}) + 1), lambda i: {u}[i - 1] || ' ' || {u}[i])"


# Common CTEs ---------------------------------------------------------------

UNIGRAMS = f"uni AS MATERIALIZED (SELECT doc_id, {index_unigrams('text')} AS u FROM documents)"
TERMS = (UNIGRAMS + ", terms AS MATERIALIZED (SELECT doc_id, unnest(list_concat(u, " + bigrams("u")
         + ")) AS term FROM uni)")
POSTINGS = TERMS + ", postings AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM terms GROUP BY term, doc_id)"
DFREQ = POSTINGS + ", dfreq AS MATERIALIZED (SELECT term, count(*) AS df FROM postings GROUP BY term)"
NDOCS = "ndocs AS (SELECT count(*) AS n FROM documents)"
# terms kept for weighting: df > 5 and df < N
FREQ = (DFREQ + ", " + NDOCS + ", freq AS MATERIALIZED (SELECT d.term, d.df FROM dfreq d, ndocs "
        "WHERE d.df > 5 AND d.df < ndocs.n), fpost AS MATERIALIZED (SELECT p.term, p.doc_id, p.tf, f.df "
        "FROM postings p JOIN freq f USING (term))")

DOC_LABELS_SINGLE = """doc_labels AS (
  SELECT doc_id, level, label, section FROM (
    SELECT d.doc_id, d.lang AS section,
           unnest([1, 2, 3]) AS level,
           unnest([d.lang, d.lang || '-' || d.source,
                   d.lang || '-' || d.source || '-q' || coalesce(CAST(l.quality AS VARCHAR), 'x')]) AS label
    FROM documents d LEFT JOIN labels l USING (doc_id)))"""

LABEL_PATHS_MULTI = """paths AS (
  SELECT DISTINCT l.l_orderkey AS doc_id, p.p_type AS section,
         p.p_type || '-' || p.p_brand AS class,
         p.p_type || '-' || p.p_brand || '-' || CAST(p.p_size AS VARCHAR) AS subclass
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""

DOC_LABELS_MULTI = LABEL_PATHS_MULTI + """, doc_labels AS (
  SELECT DISTINCT doc_id, level, label, section FROM (
    SELECT doc_id, section, unnest([1, 2, 3]) AS level, unnest([section, class, subclass]) AS label
    FROM paths))"""

LABEL_CODE = "(ascii(label) + 3 * ascii(substr(label, 2, 1)) + length(label))"

PREDS_MULTI = f"""true_s AS (
  SELECT DISTINCT l.l_orderkey AS doc_id, p.p_type AS label
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
cand AS (
  SELECT doc_id, label FROM true_s
  UNION
  SELECT l.l_orderkey AS doc_id, p.p_type AS label FROM lineitem l JOIN part p ON l.l_suppkey = p.p_partkey),
preds0 AS (
  SELECT c.doc_id, c.label, CASE WHEN t.doc_id IS NULL THEN 0 ELSE 1 END AS y_true
  FROM cand c LEFT JOIN true_s t USING (doc_id, label)),
preds AS (
  SELECT doc_id, label, y_true,
         CAST(((doc_id * 37 + {LABEL_CODE} * 11) % 13) - 6 + 5 * y_true AS DOUBLE) AS score,
         CASE WHEN ((doc_id * 37 + {LABEL_CODE} * 11) % 13) - 6 + 5 * y_true > 0 THEN 1 ELSE 0 END AS y_pred
  FROM preds0),
universe AS (SELECT DISTINCT p_type AS label FROM part),
nd AS (SELECT count(DISTINCT doc_id) AS n FROM preds)"""


def md5_hash(seed, *cols: str) -> str:
    parts = [lit(str(seed))]
    for c in cols:
        parts += ["':'", f"CAST({c} AS VARCHAR)"]
    return "md5(" + " || ".join(parts) + ")"
