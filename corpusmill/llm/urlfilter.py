"""Operator 2: URL filter by host rules and a Bloom filter cascade.

Rules decide first: a rule ``host/path`` fits its host and every subdomain
when the url's path starts with the rule's path; the longest fitting rule
wins.  A page that no rule fits is judged by a list of blocked keys, held as a
Bloom filter cascade.  Level 1 encodes the listed keys.  The keys of the
corpus that level 1 accepts wrongly are encoded in level 2, the listed keys
that level 2 accepts are encoded in level 3, and so on until a level has no
false positive.  A key's membership is the parity of the number of levels
that accept it in sequence: exact for every key of the universe, with no join.

Each level's bits are one array of longs (a scalar subquery in the probing
plan).  Their number follows from the number of keys that a level encodes, so
the size is known before the first bit is set.  Keys are dealt by a hash to as many parts as keep a
part's cascade within ``max_filter_bytes``; each part has a cascade of its own, and its rows are judged by it alone.

Defined cases: null url or url without ``://``: host and path are empty and
the key is empty.  Repeated pages are each judged.  Null keys are never
listed.  Empty tables: an empty list blocks nothing, an empty page table gives
an empty result.  Extra columns are kept as they are; an input column named
like an output column is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh, lower_ascii
from corpusmill.session import materialize

# The rules (action, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    """Lower-cased text between the first ``://`` and the next /, ?, # or end."""
    return lower_ascii(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_verdicts(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule, null where none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def _positions(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(hashes)]


def _accepts(key: Column, words: Column, level: int, hashes: int, bits: int) -> Column:
    ok = F.lit(True)
    for p in _positions(key, level, hashes, bits):
        word = F.get(words, F.shiftrightunsigned(p, 6).cast("int"))
        ok = ok & (F.getbit(word, p.bitwiseAND(F.lit(63))) == 1)
    return ok


def filter_bytes(n: int, first_rate: float = 1 / 256) -> int:
    """About the size of a cascade over ``n`` listed keys: the first level and as much again for all later ones."""
    return 2 * math.ceil(n * max(1, round(-math.log2(first_rate))) / math.log(2) / 8)


def build_cascade(listed: DataFrame, universe: DataFrame, first_rate: float = 1 / 256, rate: float = 1 / 16):
    """Levels ``(level, hashes, bits, words DataFrame of one array)`` over the
    distinct keys (column ``key``) of ``listed`` and ``universe``."""
    spark = listed.sparkSession
    inside = materialize(listed.filter("key is not null").select("key").distinct(), "listed")
    outside = universe.filter("key is not null").select("key").distinct() \
        .join(inside, "key", "left_anti")
    levels, level = [], 1
    encode, other = inside, outside
    n = encode.count()
    while n:
        p = first_rate if level == 1 else rate
        hashes = max(1, round(-math.log2(p)))
        bits = 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))
        at = encode.select(F.explode(F.array(*_positions(F.col("key"), level, hashes, bits))).alias("p"))
        words = at.groupBy(F.shiftrightunsigned("p", 6).alias("id")).agg(F.bit_or(F.expr(
            "shiftleft(1L, cast(p & 63 as int))")).alias("w"))
        dense = spark.range(bits // 64).join(words, "id", "left") \
            .select("id", F.coalesce("w", F.lit(0)).alias("w"))
        row = materialize(dense.agg(F.transform(
            F.array_sort(F.collect_list(F.struct("id", "w"))), lambda x: x["w"]).alias("words")), "bloom")
        levels.append((level, hashes, bits, row))
        # what this level accepts wrongly is what the next one encodes
        wrong = materialize(other.filter(_accepts(
            F.col("key"), row.select("words").scalar(), level, hashes, bits)), "wrong")
        encode, other = wrong, encode
        n, level = encode.count(), level + 1
    return levels


def listed_by_cascade(key: Column, levels) -> Column:
    """Exact membership for any key of the universe that built ``levels``."""
    out = F.lit(len(levels) % 2 == 1)          # accepted by every level
    for level, hashes, bits, row in reversed(levels):
        ok = _accepts(key, row.select("words").scalar(), level, hashes, bits)
        out = F.when(ok, out).otherwise(F.lit(level % 2 == 0))
    return F.coalesce(out, F.lit(False))


def judge_urls(pages: DataFrame, listed: DataFrame, url_col: str = "url", rules=RULES,
               max_filter_bytes: int = 64 << 20) -> DataFrame:
    """``pages`` plus host, path, rule and verdict.

    ``listed`` has one column ``key`` of blocked ``host + path`` keys.  Keys are dealt by a hash to as many parts as keep
    a part's cascade within about ``max_filter_bytes``; with more than one, the rows are written by part, and
    each part is judged by a cascade of its own, so no task holds more than one part's filter."""
    base = pages.drop(*[c for c in pages.columns
                        if c.lower() in ("host", "path", "rule", "verdict") and c != url_col])
    u = F.col(url_col)
    base = base.withColumns({"host": host_of(u), "path": path_of(u)}) if url_col not in ("host", "path") \
        else base.withColumnRenamed(url_col, "_url").withColumns({"host": host_of(F.col("_url")),
                                                                  "path": path_of(F.col("_url"))})
    key = F.concat("host", "path")
    listed = listed.filter("key is not null").select("key").distinct()

    def judged(rows: DataFrame, mine: DataFrame) -> DataFrame:
        levels = build_cascade(mine, rows.select(key.alias("key")))
        rule, action = rule_verdicts(F.col("host"), F.col("path"), rules)
        return rows.withColumns({"rule": rule, "verdict": F.coalesce(action, F.when(
            listed_by_cascade(key, levels), F.lit("block")).otherwise(F.lit("allow")))})
    listed = materialize(listed, "listed-keys")
    parts = max(1, math.ceil(filter_bytes(listed.count()) / max_filter_bytes))
    if parts == 1:
        return judged(base, listed)
    (part,) = fresh(base, "_part")

    def part_of(c: Column) -> Column:
        return F.pmod(F.xxhash64(c, F.lit(0)), F.lit(parts)).cast("int")
    base = materialize(base.withColumn(part, part_of(key)), "url-parts", partition_by=part)
    listed = listed.withColumn("part", part_of(F.col("key")))
    out = None
    for i in range(parts):
        got = judged(base.filter(F.col(part) == i), listed.filter(F.col("part") == i).drop("part")).drop(part)
        out = got if out is None else out.unionByName(got)
    return out
