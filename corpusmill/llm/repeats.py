"""Operator 5: removal of long repeated byte strings with a run-length index.

A byte goes when some ``length``-byte string over it also starts anywhere
else, in the same text or in another; strings never cross texts and are judged
on the input.

1. Candidates.  Every ``length``-byte window has a least hash among the
   ``gram``-byte grams inside it.  Windows that follow each other with the same
   least hash form a segment, so each window lies in exactly one segment and
   equal windows have equal keys: all places of a repeated string meet under
   one key.  Only hashes are shuffled at this step.
2. Copies are folded first: equal texts into one, equal segments of a key into
   one.  A segment found twice is repeated as a whole.
3. Keys with two or more different segments, or whose gram occurs twice in
   one, are dealt to shards of about
   ``shard_bytes``.  A shard builds the Burrows-Wheeler transform of its segments
   in run-compressed form, with the suffix positions sampled at both ends of
   every run.  Matching statistics are streamed in text order: at a run end the
   longest match with the neighbouring suffix is measured, and between them it
   falls by one per byte.  Positions whose match reaches ``length`` are
   marked.
4. A key whose different segments exceed ``key_bytes`` is not put into one
   task: the hashes of its windows are counted in a shuffle instead, which
   marks the same windows.
5. Spans are gathered per text and cut from every copy.

Defined cases: null is the empty text; texts under ``length`` bytes stay
whole; repeated rows are copies of each other and lose everything from
``length`` bytes on; overlapping occurrences count; null ids are kept; an empty
table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import null_safe, text_of
from corpusmill.session import materialize

SEPARATOR = 0xFF      # no byte of UTF-8


# ---- the index ------------------------------------------------------------

def _words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, big-endian, zeros past the end."""
    x = np.zeros(len(data) + 8, np.uint64)
    x[:len(data)] = data
    for s in (1, 2, 4):
        y = x << np.uint64(8 * s)
        y[:-s] |= x[s:]
        x = y
    return x[:len(data)]


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling over the
    groups that are still tied."""
    n = len(data)
    first = _words8(data)
    order = np.argsort(first, kind="stable")
    new = np.r_[True, first[order][1:] != first[order][:-1]]
    start = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(start, np.diff(np.r_[start, n]))
    rank[n] = -1
    size = np.repeat(np.diff(np.r_[start, n]), np.diff(np.r_[start, n]))
    tied, h = order[size > 1], 8
    while len(tied):
        a, b = rank[tied], rank[np.minimum(tied + h, n)]
        by = np.argsort((a.astype(np.uint64) << np.uint64(32)) | (b + 1).astype(np.uint64), kind="stable")
        tied, a, b = tied[by], a[by], b[by]
        group = np.r_[True, a[1:] != a[:-1]]
        sub = group | np.r_[True, b[1:] != b[:-1]]
        at = np.arange(len(tied))
        head = np.maximum.accumulate(np.where(sub, at, 0))
        rank[tied] = a + head - np.maximum.accumulate(np.where(group, at, 0))
        cut = np.flatnonzero(sub)
        size = np.diff(np.r_[cut, len(tied)])
        tied, h = tied[np.repeat(size > 1, size)], 2 * h
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of texts, each ended by a
    separator, with the suffix positions at the first and last row of each run.
    Separators count as different from each other."""

    def __init__(self, texts: list[bytes]):
        sep = bytes([SEPARATOR])
        self.data = np.frombuffer(sep.join(texts) + sep, np.uint8)
        sa = suffix_array(self.data)
        bwt = self.data[sa - 1]
        head = np.r_[True, (bwt[1:] != bwt[:-1]) | (bwt[1:] == SEPARATOR)]
        self.starts = np.flatnonzero(head)
        self.chars = bwt[self.starts]
        self.first = sa[self.starts]
        self.last = sa[np.r_[self.starts[1:], len(sa)] - 1]
        ends = np.flatnonzero(self.data == SEPARATOR)
        self.room = ends[np.searchsorted(ends, np.arange(len(self.data)))] - np.arange(len(self.data))

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the texts from a and from b share, within their texts."""
        most = np.minimum(self.room[a], self.room[b])
        x, n = _words8(self.data), len(self.data)
        out, todo = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(todo):
            at = out[todo]
            diff = x[np.minimum(a[todo] + at, n - 1)] ^ x[np.minimum(b[todo] + at, n - 1)]
            same = np.where(diff == 0, 8, (64 - _bit_length(diff)) // 8)
            out[todo] = np.minimum(at + same, most[todo])
            todo = todo[(same == 8) & (out[todo] < most[todo])]
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match that also starts elsewhere."""
        before, after = self.last[:-1], self.first[1:]     # neighbours across a run border
        shared = self._common(before, after)
        reach = np.zeros((2, len(self.data)), np.int64)
        reach[0, after] = after + shared
        reach[1, before] = before + shared
        reach = np.maximum.accumulate(reach, axis=1).max(axis=0)
        return np.minimum(reach - np.arange(len(self.data)), self.room)


def _bit_length(x: np.ndarray) -> np.ndarray:
    out, x = np.zeros(len(x), np.int64), x.copy()
    for s in (32, 16, 8, 4, 2, 1):
        big = x >= np.uint64(1 << s)
        out += s * big
        x = np.where(big, x >> np.uint64(s), x)
    return out + (x > 0)


def _cover(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs covered by strings of ``length`` at ascending starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist(),
                    strict=True))


def repeated_spans(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Per text the maximal runs covered by strings that occur twice."""
    if not texts:
        return []
    index = RunLengthIndex(texts)
    hit = np.flatnonzero(index.matching_statistics() >= length)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    cut = np.searchsorted(hit, at)
    return [_cover(hit[cut[i]:cut[i + 1]] - at[i], length) for i in range(len(texts))]


# ---- candidate segments ---------------------------------------------------

def _window_least(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, the least of every window)."""
    x = _words8(data)
    h = np.zeros(len(data) - gram + 1, np.uint64)
    for i, a in zip(range(0, gram, 8), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                        0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB), strict=False):
        h = (h ^ x[i:i + len(h)]) * np.uint64(a)
        h ^= h >> np.uint64(32)
    w = length - gram + 1
    n = len(h) - w + 1
    full = -(-len(h) // w) * w
    pad = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    pad[:len(h)] = h
    grid = pad.reshape(-1, w)
    fore = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return h, np.minimum(back[:n], fore[w - 1:w - 1 + n])


def segments(data: bytes, length: int, gram: int) -> list[tuple[int, int, int, int, bool]]:
    """(key, start, bytes, content hash, whether the least gram occurs twice in
    it, as it must if the segment repeats a window of its own)."""
    if len(data) < length:
        return []
    grams, least = _window_least(np.frombuffer(data, np.uint8), length, gram)
    start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    end = np.r_[start[1:], len(least)] + length - 1
    keys = least[start].view(np.int64).tolist()
    return [(k, a, b - a, int.from_bytes(hashlib.blake2b(data[a:b], digest_size=8).digest(), "big", signed=True),
             np.count_nonzero(grams[a:b - gram + 1] == least[a]) > 1)
            for k, a, b in zip(keys, start.tolist(), end.tolist(), strict=True)]


def _window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Two 64-bit polynomial hashes of every window (windows x 2)."""
    out = []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        inv = pow(base, -1, 1 << 64)
        up = np.cumprod(np.full(len(data), base, np.uint64)) * np.uint64(inv)
        down = np.cumprod(np.full(len(data), inv, np.uint64)) * np.uint64(base)
        total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down)]
        out.append((total[length:] - total[:-length]) * up[:len(data) - length + 1])
    return np.stack(out, axis=1)


def _segment_rows(length: int, gram: int):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [segments(t, length, gram) if t else [] for t in part.column(3).to_pylist()]
                flat = list(zip(*[s for r in rows for s in r], strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
                items = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(flat, kinds, strict=True)],
                                                   ["h", "s", "len", "sh", "own"])
                offsets = pa.array(np.cumsum([0] + [len(r) for r in rows]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(offsets, items)],
                                                 ["id", "md5", "n", "segs"])
    return run


def _send_segments(length: int):
    """The bytes of the wanted segments; for keys in windows (``shard`` -1)
    the hashes of their windows."""
    def run(batches):
        import pyarrow as pa
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        names = ["shard", "h", "sh", "seg", "w1", "w2"]
        for batch in batches:
            for data, want in zip(batch.column(0), batch.column(1), strict=True):
                data, out = data.as_py(), []
                for w in want.as_py():
                    seg = data[w["s"]:w["s"] + w["len"]]
                    if w["shard"] >= 0:
                        out.append((w["shard"], w["h"], w["sh"], seg, [], []))
                    else:
                        hashes = _window_hashes(np.frombuffer(seg, np.uint8), length).view(np.int64)
                        out.append((-1, w["h"], w["sh"], None, hashes[:, 0], hashes[:, 1]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in
                                                  zip(zip(*out, strict=True), kinds, strict=True)], names)
    return run


def _index_shard(length: int):
    def run(table):
        import pyarrow as pa
        spans = repeated_spans(table.column("seg").to_pylist(), length)
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.table({"h": table.column("h"), "sh": table.column("sh"),
                         "spans": pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], kind)})
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 400,
                   gram: int = 32, shard_bytes: int = 2 << 20, key_bytes: int = 4 << 20) -> DataFrame:
    """Per row of ``docs``: id, n_bytes, spans (removed runs, byte offsets) and
    kept (the remaining bytes)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    raw = text_of(F.col(text)).cast("binary")
    src = docs.select(F.col(id_col).alias("id"), F.md5(raw).alias("md5"), raw.alias("data"))
    found = materialize(src.select("id", "md5", F.octet_length("data").alias("n"), "data").mapInArrow(
        _segment_rows(length, gram),
        f"id {id_type}, md5 string, n int, segs array<struct<h:long,s:int,len:int,sh:long,own:boolean>>"), "segments")
    texts = found.filter(F.col("n") >= length).groupBy("md5").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
        F.first("segs").alias("segs"))
    texts = materialize(texts, "texts")
    seg = texts.select("md5", "id", F.explode("segs").alias("x")).select("md5", "id", "x.*")
    twice = seg.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.max("own").alias("own")) \
        .filter("m > 1 or own").select("h")
    cand = materialize(seg.join(twice, "h", "left_semi"), "candidates")
    folded = cand.groupBy("h", "sh").agg(F.count(F.lit(1)).alias("m"), F.max("own").alias("own"),
                                         F.min(F.struct("md5", "id", "s", "len")).alias("at"))
    folded = materialize(folded, "folded")
    keys = materialize(folded.groupBy("h").agg(F.count(F.lit(1)).alias("d"), F.max("own").alias("own"),
                                               F.sum("at.len").alias("bytes"))
                       .filter("d > 1 or own").select("h", "bytes"), "keys")
    total = keys.filter(F.col("bytes") <= key_bytes).agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    shard = F.when(F.col("bytes") <= key_bytes, F.pmod(F.xxhash64("h"), F.lit(shards))).otherwise(-1).cast("int")
    want = folded.join(keys, "h").select("at.md5", "at.id", F.struct(
        shard.alias("shard"), "h", "sh", "at.s", "at.len").alias("w")) \
        .groupBy("md5", "id").agg(F.collect_list("w").alias("want"))
    once = null_safe(src, want, ["id", "md5"], "inner").select("data", "want")
    sent = once.mapInArrow(_send_segments(length), "shard int, h long, sh long, seg binary, "
                                                   "w1 array<long>, w2 array<long>")
    if keys.filter(F.col("bytes") > key_bytes).limit(1).count():
        sent = materialize(sent, "sent")
        win = sent.filter("shard < 0").select("h", "sh", F.posexplode(F.arrays_zip("w1", "w2")).alias("o", "w"))
        seen = win.groupBy("w.w1", "w.w2").agg(F.count_distinct("sh", "o").alias("c")).filter("c > 1")
        hot = win.select("h", "sh", "o", "w.*").join(seen, ["w1", "w2"], "left_semi").select(
            "h", "sh", F.array(F.struct(F.col("o").alias("a"), (F.col("o") + length).alias("b"))).alias("spans"))
    else:
        hot = None
    index = sent.filter("shard >= 0").repartition(int(min(shards, 1 << 20)), "shard").groupBy("shard") \
        .applyInArrow(_index_shard(length), "h long, sh long, spans array<struct<a:int,b:int>>").filter("size(spans) > 0")
    inner = index if hot is None else index.unionByName(hot)
    own = F.struct("a", "b")
    parts = cand.join(inner.select("h", "sh", F.explode("spans").alias("p")), ["h", "sh"]).select(
        "md5", (F.col("s") + F.col("p.a")).alias("a"), (F.col("s") + F.col("p.b")).alias("b"))
    whole = cand.join(folded.filter("m > 1").select("h", "sh"), ["h", "sh"], "left_semi") \
        .select("md5", F.col("s").alias("a"), (F.col("s") + F.col("len")).alias("b"))
    copied = texts.filter("copies > 1").select("md5", F.lit(0).alias("a"), F.col("n").alias("b"))
    # stored, so that the join has an exchange of its own, whose large keys can be split
    cuts = materialize(parts.unionByName(whole).unionByName(copied).groupBy("md5")
                       .agg(F.collect_set(own).alias("cuts")), "cuts")
    return src.join(cuts, "md5", "left").select("id", "data", "cuts").mapInArrow(
        _cut_rows(), f"id {id_type}, n_bytes long, spans array<struct<a:int,b:int>>, kept binary")


def _cut_rows():
    def run(batches):
        import pyarrow as pa
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                spans, kept, size = [], [], []
                for data, cuts in zip(part.column(1), part.column(2), strict=True):
                    data, runs = data.as_py(), []
                    for a, b in sorted((c["a"], c["b"]) for c in cuts.as_py() or []):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                    ends = [0, *[x for r in runs for x in r], len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
                    spans.append([{"a": a, "b": b} for a, b in runs])
                    size.append(len(data))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(spans, kind),
                                                  pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])
    return run
