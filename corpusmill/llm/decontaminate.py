"""Operator 1: benchmark decontamination by winnowing.

A window is ``span`` consecutive words of an item; an item with fewer words
is one window of its own length.  Every window is fingerprinted by the least
hash of the ``k``-word grams inside it (winnowing), so equal windows have
equal fingerprints: each shared run of ``span`` words is found, with no miss.

1. One pass over the documents stores word counts and the distinct
   fingerprints per document (a written table, also the lineage cut).
2. The fingerprints are semi-joined with those of the items.  The items' side
   is a stored table whose size Spark knows: broadcast below the session's
   threshold, shuffled above it.
3. Only documents with a match are split again; each matching fingerprint is
   extended to the windows it stands for, and these are joined with the
   items' windows on their words, so hash collisions drop out.
4. Hit word positions and items are gathered per document.

Items of fewer than ``span`` words add one fingerprint length each (at most
``span - 1`` of them, read from the items first).  No step pairs documents
with each other, and a passage that many documents share is one window row
with its list of items.

Defined cases: null or empty texts have no words, no windows and no hits;
items without words never match; repeated rows (same id and text) are judged
alike and each returned; rows that share an id but not the text are judged
apart; null ids are one id; equal items all count; an empty item table leaves
every document clean.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import (NOT_WORD, fresh, indexes, let, lower_ascii, null_safe,
                                   split_words, text_of)
from corpusmill.session import materialize


def item_words(text: Column) -> Column:
    return split_words(lower_ascii(text_of(text)), NOT_WORD)


def window_prints(words: Column, span: int, k: int) -> Column:
    """The winnowing fingerprint of each ``span``-word window, in order."""
    k = min(k, span)
    w = span - k + 1
    grams = F.transform(indexes(1, F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))
    if w == 1:
        return grams
    return let(grams, lambda g: F.transform(indexes(1, F.size(g) - (w - 1)),
                                            lambda i: F.array_min(F.slice(g, i, w))))


def _windows(words: Column, span: int, k: int) -> Column:
    return let(window_prints(words, span, k), lambda m: F.transform(m, lambda p, i: F.struct(
        p.alias("fp"), (i + 1).alias("s"), F.array_join(F.slice(words, i + 1, span), " ").alias("win"))))


def item_windows(items: DataFrame, item_id: str, item_text: str, span: int, k: int):
    """(stored table of fp, win, items; the window lengths in use)."""
    w = items.select(F.col(item_id).cast("string").alias("item"), item_words(F.col(item_text)).alias("w")) \
        .filter(F.size("w") > 0)
    # at most span - 1 short lengths, whatever the number of items
    short = [r["n"] for r in w.select(F.size("w").alias("n")).filter(F.col("n") < span).distinct().collect()]
    spans = sorted({span, *short})
    arms = [w.filter(F.size("w") >= span if t == span else F.size("w") == t)
            .select("item", F.explode(_windows(F.col("w"), t, k)).alias("x")) for t in spans]
    rows = arms[0]
    for a in arms[1:]:
        rows = rows.unionByName(a)
    got = rows.groupBy("x.fp", "x.win").agg(F.collect_set("item").alias("items"))
    return materialize(got, "item-windows"), spans


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", span: int = 10, k: int = 5) -> DataFrame:
    """Per row of ``docs``: id, th (text hash), n_words, n_hit, n_items,
    items (ids as strings, sorted) and contaminated."""
    wins, spans = item_windows(items, item_id, item_text, span, k)
    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"),
                      F.xxhash64(text_of(F.col(text))).alias("th"))
    prints = let(item_words(F.col("t")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.array_distinct(F.concat(*[window_prints(w, t, k) for t in spans])).alias("fps")))
    base = materialize(src.select("id", "th", prints.alias("p")).select("id", "th", "p.*"), "fingerprints")
    known = materialize(wins.select("fp").distinct(), "item-prints")
    cand = base.select("id", "th", F.explode("fps").alias("fp")).join(known, "fp", "left_semi") \
        .groupBy("id", "th").agg(F.collect_set("fp").alias("hs"))

    def matching(w):
        def of(t):
            found = F.filter(_windows(w, t, k), lambda x: F.array_contains("hs", x["fp"]))
            return F.transform(found, lambda x: F.struct(
                x["s"].alias("s"), F.lit(t).alias("t"), x["win"].alias("win")))
        return F.concat(*[of(t) for t in spans])

    near = null_safe(src, cand, ["id", "th"], "inner") \
        .select("id", "th", F.explode(let(item_words(F.col("t")), matching)).alias("x")).select("id", "th", "x.*")
    hits = near.join(wins.select("win", "items"), "win").groupBy("id", "th").agg(
        F.collect_set(F.struct("s", "t")).alias("at"), F.collect_set("items").alias("lists")) \
        .select("id", "th", F.size(F.array_distinct(F.flatten(F.transform(
            "at", lambda x: F.sequence(x["s"], x["s"] + x["t"] - 1))))).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten("lists"))).alias("items"))
    out = null_safe(base.drop("fps"), hits, ["id", "th"], "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "items": F.coalesce("items", none)}) \
        .withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
                      **options) -> DataFrame:
    """The columns of ``docs`` without the contaminated documents."""
    (th,) = fresh(docs, "_th")
    bad = decontaminate(docs, items, id_col, text, **options).filter("contaminated") \
        .select(F.col("id").alias(id_col), F.col("th").alias(th)).distinct()
    marked = docs.withColumn(th, F.xxhash64(text_of(F.col(text))))
    return null_safe(marked, bad, [id_col, th], "left_anti").select(*docs.columns)
