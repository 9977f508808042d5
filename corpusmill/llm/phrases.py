"""Operator 13: phrase collocation mining by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
those into words ``[^\\x20\\x09]+``.  Counts are per language.

1. A block of texts is one byte array with one space between words.  Prefix
   polynomials over it give the Rabin-Karp fingerprint of every n-gram by one
   subtraction and one product (numpy, modulo 2^64; the language and n are
   mixed in), and a second one to another base.  A block counts its own fingerprints first.
2. For n = 1, 2, ... the shuffle aggregates the fingerprints: the count, the least block that has one (the
   occurrence pointer; the place in the block is found again from the fingerprint) and the least and
   greatest second fingerprint.  An n-gram is only sent when both (n-1)-grams in it may be frequent: those with
   ``min_count`` are set in a bitmap of fixed size (``filter_bits``), which the
   tasks get (compressed: a bitmap with few bits is small).  A bit set by another fingerprint only lets an n-gram
   through that is dropped later, so nothing frequent is lost at any size.
3. A last pass materialises the frequent phrases only: a second bitmap is set for (fingerprint, block) of their
   pointers, and a block sends the texts whose bit is set.  Within a block all occurrences of such a
   fingerprint are compared byte by byte with the text at its first one.  Where two second fingerprints,
   or two texts, were found under one fingerprint, every block sends its texts with their counts, which are then
   summed by text: collisions are told apart by the text.  If a pointer leads to no text, since
   the input was split in another way, all texts are sent.
4. Cuts are scored in exact integers (decimals of 38 digits), phrases inside
   longer ones are dropped, and the best of each language are found in two rounds.

Defined cases: null texts are empty, null languages are ``und``; repeated rows
and shared ids count each time; an empty table gives an empty result; a text
of any length is read whole (a block holds one text at least, so memory grows
with the longest text).  Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import text_of
from corpusmill.operators.ranking import top_k
from corpusmill.session import materialize, ship_package

BASE, OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F      # any odd numbers
BREAKS = b".,;:!?\n\x0b\x0c\r"  # fixed values of the contract
SPACES = b" \t"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)     # 0 word, 1 space, 2 break
_KIND[list(SPACES)] = 1
_KIND[list(BREAKS)] = 2


class _Powers:
    """Powers of a base and of its inverse modulo 2^64, as far as needed; ``bits`` of a fingerprint are kept."""

    def __init__(self, base: int = BASE, bits: int = 64):
        self.base, self.mask = base, np.uint64((1 << bits) - 1)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int):
        if len(self.up) <= n:
            inverse = pow(self.base, -1, 1 << 64)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, self.base, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)])
        return self.up, self.down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """The words of some texts.

    ``text`` holds the words with one space after each; word i is
    ``text[start[i]:end[i]]``; ``piece`` numbers the pieces and ``row`` the texts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        rows = len(offsets) - 1
        size = np.diff(offsets)
        # a line break after every text, so that no word passes a text's end
        raw = np.full(int(offsets[-1] - offsets[0]) + rows, 10, np.uint8)
        row_of = np.repeat(np.arange(rows), size)
        raw[np.arange(len(row_of)) + row_of] = data[offsets[0]:offsets[-1]]
        kind = _KIND[raw]
        word = kind == 0
        after = np.zeros(len(raw), bool)
        after[1:] = word[:-1]
        first, stop = np.flatnonzero(word & ~after), np.flatnonzero(after & ~word)
        broken = np.cumsum(kind == 2, dtype=np.int64)
        self.piece = broken[first] if len(first) else np.zeros(0, np.int64)
        self.row = np.searchsorted(offsets[1:] - offsets[0] + np.arange(1, rows + 1), first, "right")
        self.text = np.where(word, _LOWER[raw], 32).astype(np.uint8)[word | after]
        length = stop - first
        self.start = np.cumsum(length + 1) - (length + 1)
        self.end = self.start + length
        self.prefix: dict = {}

    def fingerprints(self, n: int, seed: np.ndarray, powers: _Powers) -> np.ndarray:
        """Fingerprints of the n-grams that start at each word but the last n - 1;
        ``seed`` has a number for each text's language."""
        m = len(self.start) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        up, down = powers.to(len(self.text))
        if powers.base not in self.prefix:
            self.prefix[powers.base] = np.r_[np.uint64(0), np.cumsum((self.text.astype(np.uint64) + np.uint64(1))
                                                                     * down[1:len(self.text) + 1])]
        prefix = self.prefix[powers.base]
        s, e = self.start[:m], self.end[n - 1:]
        h = (prefix[e] - prefix[s]) * up[e]
        return _mix(h + _mix(seed[self.row[:m]] + np.uint64(n))) & powers.mask

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each word on are in one piece."""
        m = max(len(self.start) - n + 1, 0)
        return self.piece[:m] == self.piece[n - 1:n - 1 + m]

    def candidates(self, n: int, seed: np.ndarray, powers: _Powers, filters: list) -> tuple:
        """(first words, fingerprints) of the n-grams that may be frequent:
        those whose parts of n - 1 words are set in ``filters[n - 2]``."""
        fp = self.fingerprints(n, seed, powers)
        ok = self.whole(n)
        if n > 1 and len(fp):
            part = _is_set(filters[n - 2], self.fingerprints(n - 1, seed, powers))
            ok &= part[:-1] & part[1:]
        at = np.flatnonzero(ok)
        return at, fp[at]


def _bit(fp: np.ndarray, bits: int) -> np.ndarray:
    return fp & np.uint64(bits - 1)


def _is_set(filter_: np.ndarray, fp: np.ndarray) -> np.ndarray:
    b = _bit(fp, len(filter_) * 8)
    return (filter_[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _opened(filters) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(f), np.uint8) for f in filters.value] if filters else []


def _blocks(batch, size: int):
    """Blocks of about ``size`` bytes of the (lang, seed, text) batch."""
    text = batch.column(2)
    n = len(text)
    buffers = text.buffers()
    offsets = np.frombuffer(buffers[1], np.int32, n + 1, text.offset * 4).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    seed = np.asarray(batch.column(1)).astype(np.int64).view(np.uint64)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Block(data, offsets[at:to + 1]), seed[at:to], at
        at = to


COUNT = 24      # bits of a count next to the block's number


def _grouped(fp: np.ndarray, check: np.ndarray, count: np.ndarray | None = None) -> tuple:
    """Distinct (fp, check) with their counts."""
    got, first, inverse = np.unique(fp, return_index=True, return_inverse=True)
    if (check[first][inverse] != check).any():
        order = np.lexsort((check, fp))
        fp, check = fp[order], check[order]
        count = None if count is None else count[order]
        new = np.r_[True, (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])]
        first, inverse = np.flatnonzero(new), np.cumsum(new) - 1
        got = fp[first]
    return got, check[first], np.bincount(inverse, count, len(got)).astype(np.int64)


def _number(batch_no: int) -> int:
    """A block's number: that of its task and of the block in it."""
    from pyspark import TaskContext
    return (TaskContext.get().partitionId() << 16) + min(batch_no, (1 << 16) - 1)


def _count(n: int, filters, block: int, hold: int, fp_bits: int):
    """(fp, v, k): the n-grams of a task's texts; v is a block's number and the count, k the second fingerprint."""
    def run(batches):
        import pyarrow as pa
        powers, other = _Powers(bits=fp_bits), _Powers(OTHER)
        given = _opened(filters)
        held: list = []
        no = 0

        def rows(at, fp, k, c):
            over = (1 << COUNT) - 1
            while len(fp):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp.view(np.int64)), pa.array((at << COUNT) + np.minimum(c, over)), pa.array(k.view(np.int32))],
                    ["fp", "v", "k"])
                more = c > over
                at, fp, k, c = at[more], fp[more], k[more], c[more] - over

        def merged():
            at, fp, k, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            fp, k, c, at = _least(fp, k, c, at)
            return at, fp, k, c
        for batch in batches:
            for b, seed, _ in _blocks(batch, block):
                at, fp = b.candidates(n, seed, powers, given)
                k = (b.fingerprints(n, seed, other)[at] >> np.uint64(32)).astype(np.uint32)
                fp, k, c = _grouped(fp, k)
                held.append((np.full(len(fp), _number(no), np.int64), fp, k, c))
                no += 1
                if sum(len(x[1]) for x in held) > hold:
                    held.append(merged())
                    if len(held[0][1]) > hold // 2:
                        yield from rows(*held.pop())
        if held:
            yield from rows(*merged())
    return run


def _least(fp, k, c, at) -> tuple:
    """Sums of the counts of equal (fp, k) and their least block."""
    order = np.argsort(fp, kind="stable")       # blocks stay in order
    fp, k, c, at = fp[order], k[order], c[order], at[order]
    new = np.r_[True, fp[1:] != fp[:-1]] if len(fp) else np.zeros(0, bool)
    if (k != k[np.flatnonzero(new)][np.cumsum(new) - 1]).any():
        order = np.lexsort((at, k, fp))
        fp, k, c, at = fp[order], k[order], c[order], at[order]
        new = np.r_[True, (fp[1:] != fp[:-1]) | (k[1:] != k[:-1])]
    first = np.flatnonzero(new)
    return fp[first], k[first], np.add.reduceat(c, first) if len(first) else c, at[first]


def _same_text(text: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray,
               chunk: int = 1 << 22) -> np.ndarray:
    """Whether span i has the bytes of span ``other[i]``."""
    length = end - start
    same = length == length[other]
    todo = np.flatnonzero(same & (np.arange(len(start)) != other))
    ends = np.cumsum(length[todo])
    at = 0
    while at < len(todo):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, "right")))
        part = todo[at:to]
        size = length[part]
        offset = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(offset, size)
        differs = text[np.repeat(start[part], size) + step] != text[np.repeat(start[other[part]], size) + step]
        same[part] = ~np.logical_or.reduceat(differs, offset)
        at = to
    return same


def read_phrases(block: Block, at: np.ndarray, fp: np.ndarray, n: int) -> tuple:
    """(first words, counts, fingerprints) of the distinct n-grams at words ``at`` with
    fingerprints ``fp``, told apart by their text."""
    out_at, out_c, out_fp = [], [], []
    while len(at):
        fp, first, inverse = np.unique(fp, return_index=True, return_inverse=True)
        pointer = first[inverse]
        same = _same_text(block.text, block.start[at], block.end[at + n - 1], pointer) \
            & (block.row_key[block.row[at]] == block.row_key[block.row[at[pointer]]])
        out_at.append(at[first])
        out_c.append(np.bincount(inverse[same], minlength=len(fp)))
        out_fp.append(fp)
        at, fp = at[~same], fp[inverse[~same]]      # another text under the same fingerprint
    if not out_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_at), np.concatenate(out_c), np.concatenate(out_fp)


def _owned(fp: np.ndarray, number: int) -> np.ndarray:
    """A fingerprint of (fingerprint, block)."""
    return _mix(fp ^ _mix(np.full(1, number, np.uint64)))


def _materialise(words: int, filters, owners, torn, block: int, hold: int, fp_bits: int):
    """(fp, lang, n, phrase, c, torn): the texts that the pointers lead to, those of colliding fingerprints in every
    block, and for each language a row with n = 0 and the number of its words.  ``owners`` None: all texts."""
    def run(batches):
        import pyarrow as pa
        powers, given, apart = _Powers(bits=fp_bits), _opened(filters), _opened(torn)
        mine = _opened(owners) if owners else None

        def rows(found):
            keys = list(found)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()),
                 pa.array([k[2] for k in keys], pa.int32()), pa.array([k[3] for k in keys], pa.binary()),
                 pa.array(list(found.values()), pa.int64())], ["fp", "lang", "n", "phrase", "c"])
        found: dict = {}
        no = 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for b, seed, base in _blocks(batch, block):
                langs = names[base:base + len(seed)]
                known = {x: i for i, x in enumerate(dict.fromkeys(langs))}
                b.row_key = np.array([known[x] for x in langs], np.int32)
                for lang, i in known.items():
                    key = (0, lang, 0, b"")
                    found[key] = found.get(key, 0) + int((b.row_key[b.row] == i).sum())
                raw = b.text.tobytes()
                for n in range(1, words + 1):
                    at, fp = b.candidates(n, seed, powers, given)
                    some = _is_set(given[n - 1], fp)
                    if mine is not None:
                        some &= _is_set(mine[n - 1], _owned(fp, _number(no))) | _is_set(apart[n - 1], fp)
                    at, fp = at[some], fp[some]
                    at, c, fp = read_phrases(b, at, fp, n)
                    for f, i, k, row, s, e in zip(fp.view(np.int64).tolist(), at.tolist(), c.tolist(), b.row[at].tolist(),
                                                  b.start[at].tolist(), b.end[at + n - 1].tolist(), strict=True):
                        key = (f, langs[row], n, raw[s:e])
                        found[key] = found.get(key, 0) + k
                no += 1
                if len(found) > hold:
                    yield rows(found)
                    found = {}
        if found:
            yield rows(found)
    return run


def _bitmap(bits_of: DataFrame, bits: int) -> bytes:
    """A bit for every ``fp`` of the table."""
    chunk_bits = min(bits, 1 << 15)
    bit = F.col("fp").bitwiseAND(F.lit(bits - 1))

    def chunk(pdf):
        import pandas as pd
        got = np.zeros(chunk_bits, np.uint8)
        got[pdf["bit"].to_numpy() % chunk_bits] = 1
        return pd.DataFrame({"chunk": [int(pdf["bit"].iloc[0]) // chunk_bits],
                             "data": [np.packbits(got, bitorder="little").tobytes()]})
    rows = bits_of.select(bit.alias("bit")).withColumn("chunk", F.floor(F.col("bit") / chunk_bits)) \
        .groupBy("chunk").applyInPandas(chunk, "chunk long, data binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r["chunk"] * chunk_bits // 8:(r["chunk"] + 1) * chunk_bits // 8] = np.frombuffer(r["data"], np.uint8)
    return zlib.compress(out.tobytes(), 1)      # mostly zeros as long as few bits are set


def _owner_bits(frequent: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            at = np.asarray(batch.column(1)).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_mix(fp ^ _mix(at)).view(np.int64))], ["fp"])
    return frequent.select("fp", "at").mapInArrow(run, "fp long")


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = 3, min_count: int = 10,
                  filter_bits: int = 1 << 27, block: int = 1 << 20, hold: int = 1 << 20,
                  fp_bits: int = 64) -> DataFrame:
    """(lang, n, phrase, c) of all phrases of up to ``words`` words that occur
    ``min_count`` times in their language, and with n = 0 the number of all words
    of each language.  ``filter_bits`` is a power of two; three filters of an eighth of
    as many bytes (compressed on the way) go to every task for each n."""
    spark = docs.sparkSession
    ship_package(spark)
    give = spark.sparkContext.broadcast
    name = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    src = docs.select(name.alias("lang"), F.xxhash64(name).alias("seed"), text_of(F.col(text)).alias("text"))
    filters, owners, torn = [], [], []
    tables = None
    for n in range(1, words + 1):
        # summed per task already: shuffled as they are, summed once behind the shuffle
        given = give(filters) if filters else None
        counts = src.mapInArrow(_count(n, given, block, hold, fp_bits),
                                "fp long, v long, k int").repartition("fp")
        frequent = counts.groupBy("fp").agg(
            F.sum(F.col("v").bitwiseAND(F.lit((1 << COUNT) - 1))).alias("c"), F.min(F.shiftright("v", COUNT)).alias("at"),
            (F.min("k") != F.max("k")).alias("torn")).filter(F.col("c") >= min_count)
        frequent = materialize(frequent, "frequent")
        if given:
            given.destroy()
        filters.append(_bitmap(frequent, filter_bits))
        owners.append(_bitmap(_owner_bits(frequent), filter_bits))
        torn.append(_bitmap(frequent.filter("torn"), min(filter_bits, 1 << 20)))     # hardly any
        own = frequent.select("fp", F.lit(n).alias("n"), "c", "torn")
        tables = own if tables is None else tables.unionByName(own)

    def read(owners):
        return materialize(src.mapInArrow(_materialise(words, give(filters), owners, give(torn), block, hold // 2, fp_bits),
                                          "fp long, lang string, n int, phrase binary, c long"), "texts")
    texts = read(give(owners))
    several = texts.filter("n > 0").join(tables.filter("not torn"), ["fp", "n"]).groupBy("fp", "n") \
        .agg(F.count_distinct("lang", "phrase").alias("texts")).filter("texts > 1")
    if tables.join(texts, ["fp", "n"], "left_anti").limit(1).count() or several.limit(1).count():
        texts = read(None)
        tables = tables.withColumn("torn", F.lit(True))
    texts = texts.withColumn("phrase", F.col("phrase").cast("string"))
    totals = texts.filter("n = 0").groupBy("lang", "n", "phrase").agg(F.sum("c").alias("c"))
    found = texts.filter("n > 0").withColumnRenamed("c", "seen").join(tables, ["fp", "n"])
    whole = found.filter("not torn").select("lang", "n", "phrase", "c").distinct()
    apart = found.filter("torn").groupBy("lang", "n", "phrase").agg(F.sum("seen").alias("c")).filter(F.col("c") >= min_count)
    return materialize(totals.unionByName(whole).unionByName(apart), "phrases")


def _part(words: Column, first, n) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)), exact up to 10^15 occurrences."""
    big = [c.cast("decimal(15,0)") for c in (a, left, right)]
    return F.call_function("div", big[0] * big[0] * F.lit(1000000).cast("decimal(7,0)"), big[1] * big[2])


def collocations(counts: DataFrame, top: int = 2000, words: int = 3, share: int = 50) -> DataFrame:
    """(lang, rank, phrase, n_words, cut, a, l, r, n, score): the best phrases of each
    language in :func:`phrase_counts`.  A phrase's score is that of its worst cut; a phrase inside
    a longer one with ``share`` per cent of its occurrences or more is dropped."""
    parts = counts.filter("n > 0").select("lang", "phrase", "c")
    cand = counts.filter("n > 1").select("lang", "phrase", F.col("n").alias("n_words"), F.col("c").alias("a"),
                                         F.split("phrase", " ").alias("w"))
    cuts = cand.select("lang", "phrase", "n_words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")) \
        .select("lang", "phrase", "n_words", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("first"),
                _part(F.col("w"), F.col("k") + 1, F.col("n_words") - F.col("k")).alias("rest"))
    left = parts.withColumnsRenamed({"phrase": "first", "c": "l"})
    right = parts.withColumnsRenamed({"phrase": "rest", "c": "r"})
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]) \
        .groupBy("lang", "phrase", "n_words", "a").agg(F.min(F.struct(
            score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("x"))
    longer = cand.filter("n_words > 2").select("lang", F.col("a").alias("longer"), "n_words", "w")
    if words > 2:
        sub = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda m: F.transform(
            F.sequence(F.lit(1), F.col("n_words") - m + 1), lambda i: _part(F.col("w"), i, m))))
        around = longer.select("lang", "longer", F.explode(sub).alias("phrase")) \
            .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        scored = scored.join(around, ["lang", "phrase"], "left") \
            .filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    total = counts.filter("n = 0").select("lang", F.col("c").alias("n"))
    best = top_k(scored.select("lang", "phrase", "n_words", "a", "x.*"), ["lang"],
                 [F.desc("score"), F.desc("a"), F.asc("phrase")], top, salt_cols=["phrase"])
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "n_words",
                                           F.col("k").alias("cut"), "a", "l", "r", "n", "score")
