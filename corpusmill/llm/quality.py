"""Operator 7: quality rules with cross-document line frequency.

Base rules look at one text: words, their characters, symbols, repeated
lines, words inside repeated three-word windows.  The method then looks
across documents: each line is normalised (lower-cased, digit runs to 0, space
runs to one space), hashed, and its distinct documents are counted per
host.  Lines in more than ``max(min_docs, max_share * documents of the
host)`` documents are removed; a document that keeps less than
``min_left`` of its words is rejected as depleted.  Exact copies of one text
count as one document, so a copied document does not lose its own lines.

The three-word windows of a text are hashed, sorted with their positions and
compared with their neighbours: O(n log n) for one text of n words, with no
shuffle.  Line counting shuffles (host, line hash, text hash) triples that
are distinct per text; a line of a third of all documents is pre-aggregated in
every task.

Defined cases: a null text has no words (base_failed: fewer than 50 words); a
null host is a host of its own; repeated rows are judged alike and each
returned; lines without a word are never counted or removed; an empty table
gives an empty result.  Only the named columns are read, so extra columns
cannot clash; ``apply_quality`` returns all columns of its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import SPACES, fresh, indexes, let, null_safe, split_words, text_of
from corpusmill.session import materialize

SYMBOL = "[#*$%&|<>]"


def has_word(line: Column) -> Column:
    return F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))


def repeated_words(words: Column, n: int = 3) -> Column:
    """Words covered by n-word windows that occur twice or more."""
    def covered(s):
        twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["g"] == x["g"]) | (F.get(s, j + 1)["g"] == x["g"]))
        at = F.flatten(F.transform(twice, lambda x: F.array(*[x["p"] + F.lit(k) for k in range(n)])))
        return F.size(F.array_distinct(at))

    def of(w):
        grams = F.transform(indexes(1, F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
            let(F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("p")))), covered)))

    return of(words)


def base_stats(text: Column) -> Column:
    """Struct n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = text_of(text)
    dup = let(F.filter(F.split(t, "\n"), has_word), lambda a: F.size(a) - F.size(F.array_distinct(a)))
    symbols = F.regexp_count(t, F.lit(SYMBOL))
    return let(split_words(t, SPACES), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"), dup.cast("long").alias("n_dup_lines"),
        repeated_words(w).cast("long").alias("n_repeat_words")))


def failed(s: str = "") -> Column:
    return (F.col(s + "n_words") < 50) | (F.col(s + "n_repeat_words") * 100 > F.col(s + "n_words") * 50)


def normal_line(line: Column) -> Column:
    spaced = F.trim(F.regexp_replace(line, SPACES, " "))
    return F.regexp_replace(F.lower(spaced), "[0-9]+", "0")


def _lines(text: Column) -> Column:
    """Hash and words of each normalised line that has a word, in order."""
    return F.transform(F.filter(F.split(text_of(text), "\n"), has_word), lambda x: let(
        normal_line(x), lambda y: F.struct(F.xxhash64(y).alias("h"), F.size(F.split(y, " ")).alias("w"))))


def line_table(docs: DataFrame, id_col: str, text: str, host: str, stats: bool) -> DataFrame:
    """Stored once per call: id, th (text hash), host, the lines and, if asked
    for, the base figures, so that texts are split a single time."""
    cols = [F.col(id_col).alias("id"), F.xxhash64(text_of(F.col(text))).alias("th"),
            F.col(host).alias("host"), _lines(F.col(text)).alias("ls")]
    if stats:
        cols.append(base_stats(F.col(text)).alias("s"))
    return materialize(docs.select(*cols), "lines")


def frequent_lines(lines: DataFrame, min_docs: int = 20, max_share: float = 0.1) -> DataFrame:
    """(host, h): normalised line hashes above the host's limit."""
    per_host = lines.select("host", "th").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = lines.select("host", "th", F.explode("ls.h").alias("h")).distinct() \
        .groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs)
    return null_safe(counts, per_host, ["host"], "inner") \
        .filter(F.col("n") > F.col("n_docs") * F.lit(max_share)).select("host", "h")


def line_verdicts(lines: DataFrame, min_docs: int = 20, max_share: float = 0.1) -> DataFrame:
    """(id, th, host, n_cut, cut): for texts that lose lines, the words they
    lose and the distinct hashes of the lines."""
    freq = materialize(frequent_lines(lines, min_docs, max_share), "frequent-lines")
    rows = lines.select("id", "th", "host", F.explode("ls").alias("l")).select("id", "th", "host", "l.h", "l.w")
    copies = lines.groupBy("id", "th", "host").agg(F.count(F.lit(1)).alias("copies"))
    cut = null_safe(rows, freq, ["host", "h"], "left_semi").groupBy("id", "th", "host") \
        .agg(F.sum("w").alias("all_cut"), F.collect_set("h").alias("cut"))
    return null_safe(cut, copies, ["id", "th", "host"], "inner") \
        .select("id", "th", "host", (F.col("all_cut") / F.col("copies")).cast("long").alias("n_cut"), "cut")


def quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source",
            min_docs: int = 20, max_share: float = 0.1, min_left: float = 0.5) -> DataFrame:
    """Per row: id, th (text hash), host, the five base figures, base_failed,
    n_cut (words in removed lines) and kept."""
    lines = line_table(docs, id_col, text, host, stats=True)
    stats = lines.select("id", "th", "host", "s.*").withColumn("base_failed", failed())
    cut = line_verdicts(lines, min_docs, max_share).drop("cut")
    out = null_safe(stats, cut, ["id", "th", "host"], "left") \
        .withColumn("n_cut", F.coalesce("n_cut", F.lit(0)))
    left = F.col("n_words") - F.col("n_cut") >= F.col("n_words") * F.lit(min_left)
    return out.withColumn("kept", ~F.col("base_failed") & left)


def apply_quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source",
                  min_docs: int = 20, max_share: float = 0.1, min_left: float = 0.5) -> DataFrame:
    """The columns of ``docs``: rejected documents are gone, frequent lines
    are cut out of the texts that stay (``n_chars``, if present, follows)."""
    th, s, new_text = fresh(docs, "_th", "_stats", "_new_text")
    lines = line_table(docs, id_col, text, host, stats=False)
    cut = line_verdicts(lines, min_docs, max_share).select(
        F.col("id").alias(id_col), F.col("th").alias(th), F.col("host").alias(host), "n_cut", "cut")
    n_cut, hashes = fresh(docs, "_n_cut", "_cut")
    cut = cut.withColumnsRenamed({"n_cut": n_cut, "cut": hashes})
    base = docs.withColumns({th: F.xxhash64(text_of(F.col(text))), s: base_stats(F.col(text))}) \
        .filter(~failed(s + "."))
    j = null_safe(base, cut, [id_col, th, host], "left")
    words = F.col(s + ".n_words")
    j = j.filter(words - F.coalesce(F.col(n_cut), F.lit(0)) >= words * F.lit(min_left))
    stays = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(
        F.col(hashes), F.xxhash64(normal_line(x))) | ~has_word(x))
    new = F.when(F.col(hashes).isNull(), F.col(text)).otherwise(F.array_join(stays, "\n"))
    out = j.withColumn(new_text, new)
    cols = [F.col(new_text).alias(c) if c == text else
            F.when(F.col(hashes).isNull(), F.col(c)).otherwise(F.length(new_text)).cast(docs.schema[c].dataType)
            .alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*cols)
