"""Operator 8: n-gram Jaccard join by MinHash banding.

Words are those of operator 1; a text's set is its hashed five-word
shingles (a text of one to four words is one shingle).  Rows with equal sets
are one class member ("copies") and are joined through one representative.

1. Each set gets ``rows * bands`` MinHashes; rows and bands are chosen for the
   target recall at the threshold (:func:`choose_bands`).
2. Band hashes are shuffled.  Buckets of one set are dropped, and of buckets
   with the same members only that of the lowest band stays.
3. A bucket's members are dealt to blocks of about ``block`` sets; every pair of
   blocks is one task group that verifies all its pairs on the full sets with
   blocked 0/1 matrix products.  A pair counts in the first band it shares, so
   it counts once.  A group returns one row per member (its number of links
   and a root that it is linked to), never the pairs.
4. Components of those root links give the classes.

Links are exact on the pairs that meet (equal to a brute-force Jaccard); a
pair at the threshold meets with the target recall, closer pairs more often.

Defined cases: null texts and texts without words are linked to nothing and
are a class each; repeated rows are copies; rows that share an id but not the
text are judged apart; null ids are ids like others (and are the class id if
least); an empty table gives an empty result.  Only the named columns are
read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh, indexes, let, null_safe, text_of
from corpusmill.llm.decontaminate import item_words
from corpusmill.operators.components import connected_components
from corpusmill.session import materialize


def choose_bands(threshold: float, recall: float, max_hashes: int = 64) -> tuple[int, int]:
    """(rows, bands): the most rows per band, so the fewest false candidates,
    whose bands reach ``recall`` at ``threshold`` within ``max_hashes``."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold ** rows
        bands = 1 if p >= recall else math.ceil(math.log1p(-recall) / math.log1p(-p))
        if rows * bands <= max_hashes:
            best = (rows, bands)
    if best is None:
        raise ValueError("no banding reaches the recall within max_hashes")
    return best


def shingles(text: Column, n: int = 5) -> Column:
    """Sorted distinct hashes of the n-word shingles."""
    return let(item_words(text), lambda w: F.array_sort(F.array_distinct(F.transform(
        indexes(1, F.greatest(F.size(w) - (n - 1), F.least(F.size(w), F.lit(1)))),
        lambda i: F.xxhash64(F.slice(w, i, n))))))


def _set_key(a: np.ndarray) -> str:
    return hashlib.blake2b(a.tobytes(), digest_size=16).hexdigest()


def signatures(flat: np.ndarray, starts: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """Band hashes (sets x bands) of non-empty sets given as flat hashes."""
    rng = np.random.default_rng(20)
    x = flat.astype(np.uint64)
    out = np.empty((len(starts), bands), np.uint64)
    for b in range(bands):
        h = np.zeros(len(starts), np.uint64)
        for _ in range(rows):
            s, a = rng.integers(0, 2 ** 63, 2, dtype=np.uint64)
            least = np.minimum.reduceat((x ^ s) * (a | np.uint64(1)), starts)
            h = (h ^ least) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, b] = h
    return out.view(np.int64)


def _lists(col):
    """(flat values, starts, sizes) of an Arrow list column without nulls."""
    offsets = np.asarray(col.offsets)
    return np.asarray(col.values)[offsets[0]:offsets[-1]], offsets[:-1] - offsets[0], np.diff(offsets)


def _sign(rows: int, bands: int):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            key, th, col = batch.columns
            flat, starts, sizes = _lists(col)
            some = np.flatnonzero(sizes)
            names = [None] * len(sizes)
            sig = np.zeros((len(sizes), bands), np.int64)
            for part in np.array_split(some, max(1, int(sizes.sum()) >> 20)):
                if len(part):
                    lo, hi = starts[part[0]], starts[part[-1]] + sizes[part[-1]]
                    sig[part] = signatures(flat[lo:hi], starts[part] - lo, rows, bands)
            for i in some.tolist():
                names[i] = _set_key(flat[starts[i]:starts[i] + sizes[i]])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands),
                                             pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([key, th, pa.array(names, pa.string()), lists],
                                             ["id", "th", "key", "bands"])
    return run


def _send(batches):
    """One row per task group of a member: its set goes where it is due."""
    import pyarrow as pa
    import pyarrow.compute as pc
    for batch in batches:
        key, bands, jobs, sets = batch.columns
        flat, starts, sizes = _lists(sets)
        names = key.to_pylist()
        for i, name in enumerate(names):
            own = np.ascontiguousarray(flat[starts[i]:starts[i] + sizes[i]])
            if not len(own) or _set_key(own) != name:     # another text under the same id
                continue
            due = jobs.slice(i, 1).flatten()
            n = len(due)
            sig = np.asarray(bands.slice(i, 1).flatten()).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pc.struct_field(due, f) for f in ("band", "h", "lo", "hi", "block")] +
                [pa.array([name] * n), pa.array([sig] * n, pa.binary()),
                 pa.array([own.tobytes()] * n, pa.binary())],
                ["band", "h", "lo", "hi", "block", "key", "sig", "own"])


def _common(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Matrix of the sizes of all intersections."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[at] > 1
    row = row[shared]
    _, col = np.unique(at[shared], return_inverse=True)
    out = np.zeros((m, m), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, chunk):
        a, b = np.searchsorted(col, (lo, lo + chunk))
        x = np.zeros((m, chunk), np.float32)
        x[row[a:b], col[a:b] - lo] = 1
        out += x @ x.T
    return out


def _verify(threshold: float):
    def run(pdf):
        import pandas as pd
        pdf = pdf.drop_duplicates("key").sort_values("key")
        band, lo, hi = int(pdf["band"].iloc[0]), int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        sets = [np.frombuffer(b, np.int64) for b in pdf["own"]]
        sig = np.array([np.frombuffer(b, np.int64) for b in pdf["sig"]])
        common = _common(sets)
        size = np.array([len(s) for s in sets], np.float32)
        link = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-3
        for b in range(band):                       # the pair counts in an earlier band
            link &= sig[:, None, b] != sig[None, :, b]
        if lo != hi:
            block = pdf["block"].to_numpy()
            link &= block[:, None] != block[None, :]
        np.fill_diagonal(link, False)
        root = np.arange(len(sets))
        while True:                                 # least row reached through links
            near = np.where(link, root[None, :], len(sets)).min(axis=1)
            new = np.minimum(root, near)
            if (new == root).all():
                break
            root = new
        keys = pdf["key"].to_numpy()
        return pd.DataFrame({"key": keys, "links": link.sum(axis=1), "root": keys[root]})
    return run


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5,
                    threshold: float = 0.8, recall: float = 0.999, max_hashes: int = 64,
                    block: int = 384) -> DataFrame:
    """Per row of ``docs``: id, th (text hash), class_id (least id of the
    component), n_links (other sets at the threshold or above), n_copies
    (other rows with the same set) and first (id and th of the class's first row)."""
    rows, bands = choose_bands(threshold, recall, max_hashes)
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(F.col(text))).alias("th"),
                      shingles(F.col(text), n).alias("sets"))
    sig = materialize(src.mapInArrow(_sign(rows, bands), f"id {id_type}, th long, key string, bands array<long>"),
                      "signatures")
    sets = sig.filter("key is not null").groupBy("key").agg(
        F.min(F.struct("id", "th")).alias("first"), F.min("bands").alias("bands"),
        F.count(F.lit(1)).alias("rows"))
    sets = materialize(sets, "sets")
    member = sets.select("key", F.posexplode("bands").alias("band", "h"))
    buckets = member.groupBy("band", "h").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("key")).alias("x"),
        F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).filter("m > 1")
    kept = buckets.groupBy("m", "x", "y").agg(F.min(F.struct("band", "h")).alias("b")).select("m", "b.band", "b.h")
    g = F.ceil(F.col("m") / F.lit(block)).cast("int")
    mine = member.join(kept, ["band", "h"]).withColumn("g", g) \
        .withColumn("block", F.pmod(F.xxhash64("key", F.lit(2)), F.col("g")).cast("int"))
    jobs = mine.select("key", F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct(
        F.col("band"), F.col("h"), F.least("block", j).alias("lo"), F.greatest("block", j).alias("hi"),
        F.col("block"))).alias("js")).groupBy("key").agg(F.flatten(F.collect_list("js")).alias("jobs"))
    due = sets.join(jobs, "key").select("key", "bands", "jobs", F.col("first.id").alias("id"),
                                        F.col("first.th").alias("th"))
    due = materialize(due, "band-jobs")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(F.col(text))).alias("th"),
                        F.col(text).alias("text"))
    sent = null_safe(texts, due, ["id", "th"], "inner") \
        .select("key", "bands", "jobs", shingles(F.col("text"), n).alias("sets")) \
        .mapInArrow(_send, "band int, h long, lo int, hi int, block int, key string, sig binary, own binary")
    found = materialize(sent.groupBy("band", "h", "lo", "hi").applyInPandas(
        _verify(threshold), "key string, links long, root string").filter("links > 0"), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    comp = connected_components(found, "key", "root")
    named = sets.select("key", "first", "rows").join(comp.withColumnRenamed("id", "key"), "key", "left") \
        .join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    firsts = named.groupBy("root").agg(F.min("first").alias("class"))
    per_set = named.drop("first").join(firsts, "root").select("key", "class", "n_links", "rows")
    own = F.struct("id", "th")
    return sig.select("id", "th", "key").join(per_set, "key", "left").select(
        "id", "th", F.coalesce("class", own).alias("first"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (F.coalesce("rows", F.lit(1)) - 1).alias("n_copies")) \
        .withColumn("class_id", F.col("first.id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The columns of ``docs``, one row of each class: that of the least id."""
    (th,) = fresh(docs, "_th")
    keep = jaccard_classes(docs, id_col, text, **options) \
        .filter(F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.th") == F.col("th"))) \
        .select(F.col("id").alias(id_col), F.col("th").alias(th)).distinct()
    marked = docs.withColumn(th, F.xxhash64(text_of(F.col(text))))
    wordless = F.size(item_words(F.col(text))) == 0     # never a copy of another
    stays = null_safe(marked, keep, [id_col, th], "left_semi")
    once = stays.filter(~wordless).dropDuplicates([id_col, th])
    return once.unionByName(stays.filter(wordless)).select(*docs.columns)
