"""Operator 3: language-model scoring with an Elias-Fano n-gram trie.

The model is interpolated with a Dirichlet prior at every order:
``p(w | h) = (c(hw) + mu p(w | h')) / (c(h) + mu)``, down to the add-one
unigram.  Level 1 maps word hashes to ids and counts; level k holds the k-grams
as (node of the first k-1 words, last word).

* Monotone sequences are Elias-Fano coded: low bits packed, high bits in unary
  with a directory of zeros.  A level shard has its contexts, the monotone
  pointers to each context's children (in unary), and the children's words,
  packed and ascending under each context.  A query finds its context by
  successor search, then its word by interpolation search between that
  context's two pointers.
* Smoothed log10 probabilities are quantised to 16 bits.
* A level is cut into shards by a hash of the key, so the children of a word
  that makes up a third of the corpus lie in all shards.  A shard is one file
  in the folder that all executors share, and is memory-mapped by the tasks that
  query it (copied to the worker's own folder first when the store is not a
  mounted one).

Counting is two aggregations: words per task, then k-grams per block of
``block_tokens`` tokens as sorted, delta-coded key arrays.  Scoring is a map over the
documents.  The number of shards follows the number of training tokens; a
task holds one block or one shard.

Defined cases: null and empty texts are one end token; an unknown word has
count zero; repeated rows are counted and scored each; a null id counts as
the empty text in the hold-out rule; with no training row every token has
probability one (N = V = 0).  Hash collisions among words raise.  Only the named columns
are read.
"""

from __future__ import annotations

import json
import math
import os
import re
import tempfile
import uuid
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import checkpoint_dir, materialize

END = b"\n"               # the end token; no word holds a newline
CODE_STEP = 12 / 65535    # log10 probabilities from 0 down to -12
PROBABILITY = 10.0 ** (np.arange(65536) * -CODE_STEP)     # by code


# ---- Elias-Fano -----------------------------------------------------------

def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros((len(values) * bits >> 6) + 2, np.uint64)
    if bits and len(values):
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, values << off)
        over = off + np.uint64(bits) > 64
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - off[over]))
    return out


def _unpack(data: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), np.uint64)
    pos = at.astype(np.uint64) * np.uint64(bits)
    word, off = (pos >> np.uint64(6)).astype(np.int64), pos & np.uint64(63)
    # the next word's bits, shifted in two steps: none of them where off is 0
    out = (data.take(word) >> off) | (data.take(word + 1) << (np.uint64(63) - off) << np.uint64(1))
    return out & np.uint64((1 << bits) - 1)


def _search(data: np.ndarray, bits: int, lo: np.ndarray, hi: np.ndarray, want: np.ndarray):
    """(index of the first packed value >= want in lo..hi, whether it is equal); each range is ascending."""
    out, same = lo.copy(), np.zeros(len(lo), bool)
    at = np.flatnonzero(lo < hi)
    lo, hi, want = lo[at], hi[at], want[at]
    equal = np.zeros(len(at), bool)
    while len(at):
        mid = (lo + hi) >> 1
        value = _unpack(data, mid, bits)
        less = value < want
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
        equal = np.where(less, equal, value == want)      # of the value at hi
        more = np.flatnonzero(lo < hi)
        if len(more) < len(at):
            out[at], same[at] = lo, equal           # those with more to do are written again
            at, lo, hi, want, equal = (x.take(more) for x in (at, lo, hi, want, equal))
    return out, same


def _among(data: np.ndarray, bits: int, size: int, lo: np.ndarray, hi: np.ndarray, want: np.ndarray):
    """(index, whether it is there) of a packed value in lo..hi; each range is strictly ascending, below ``size``.  Ids
    follow the words' hashes, so values are spread evenly: two of three steps go by proportion, the third halves."""
    out, same = lo.copy(), np.zeros(len(lo), bool)
    at = np.flatnonzero(lo < hi)
    lo, hi, want = lo.take(at), hi.take(at), want.take(at).astype(np.int64)
    below, above = np.full(len(at), -1), np.full(len(at), size)      # values beside the range
    step = 0
    while len(at):
        step += 1
        if step % 3:
            mid = lo + ((want - below) * ((hi - lo) / (above - below))).astype(np.int64)
            mid = np.minimum(mid, hi - 1)
        else:
            mid = (lo + hi) >> 1
        value = _unpack(data, mid, bits).view(np.int64)
        less = value < want
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
        more = np.flatnonzero((lo < hi) & (value != want))
        if len(more) < len(at):
            out[at], same[at] = mid, value == want
            less, value = less.take(more), value.take(more)
            at, lo, hi, want, below, above = (x.take(more) for x in (at, lo, hi, want, below, above))
        below, above = np.where(less, value, below), np.where(less, above, value)
    return out, same


def ef_build(values: np.ndarray, universe: int, bits: int | None = None) -> dict:
    """Arrays of an Elias-Fano coded non-decreasing sequence of uint64."""
    n = len(values)
    if bits is None:
        bits = max(0, min(63, int(math.log2(max(1, universe // max(1, n))))))
    high = (values >> np.uint64(bits)).astype(np.int64)
    buckets = int(high[-1]) + 1 if n else 1
    size = n + buckets + 1
    unary = np.zeros((size >> 6) + 1, np.uint64)
    at = high + np.arange(n)
    np.bitwise_or.at(unary, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    ones = np.bitwise_count(unary).astype(np.int64)
    zeros = 64 * np.arange(len(unary) + 1) - np.r_[0, np.cumsum(ones)]
    return {"n": np.array([n, bits, buckets], np.int64), "low": _pack(values & np.uint64((1 << bits) - 1), bits),
            "high": unary, "zeros": zeros.astype(np.uint32 if len(unary) < 1 << 26 else np.int64)}


_BYTES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)
#: Position of the k-th set bit of each byte.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8).ravel()


def _select(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th set bit (from 0) of each word: its byte by the running counts of bytes, then a table."""
    s = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    s = (s & np.uint64(0x3333333333333333)) + ((s >> np.uint64(2)) & np.uint64(0x3333333333333333))
    s = ((s + (s >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES     # byte i: set bits of bytes 0 to i
    full = (((r * _BYTES) | _TOPS) - s) & _TOPS                                     # bytes whose count is at most r
    place = np.minimum(np.bitwise_count(full), 7).astype(np.uint64) * np.uint64(8)
    within = r - ((s << np.uint64(8)) >> place & np.uint64(0xFF))
    byte = (x >> place) & np.uint64(0xFF)
    return (place + _IN_BYTE[(byte << np.uint64(3) | (within & np.uint64(7))).astype(np.int64)]).astype(np.int64)


class EliasFano:
    """Queries over the arrays of :func:`ef_build`, in memory or mapped."""

    def __init__(self, arrays: dict):
        self.n, self.bits, self.buckets = (int(x) for x in arrays["n"])
        self.low, self.high, self.zeros = arrays["low"], arrays["high"], arrays["zeros"]

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Bit position of the k-th zero, -1 for k = -1."""
        at = np.maximum(k, 0)
        # in the directory's own type, or it would be copied whole to that of k
        j = np.searchsorted(self.zeros[:len(self.high)], at.astype(self.zeros.dtype), "right") - 1
        r = (at - self.zeros[j]).astype(np.uint64)
        return np.where(k < 0, -1, 64 * j + _select(~self.high[j], r))

    def _run(self, at: np.ndarray) -> np.ndarray:
        """Number of ones from bit ``at`` to the next zero."""
        off = at & 63
        x = ~self.high.take(at >> 6) >> off.astype(np.uint64)
        out = np.bitwise_count((x & -x) - np.uint64(1)).astype(np.int64)
        todo = np.flatnonzero(x == 0)               # the run goes on in the next word
        out[todo] = 64 - off[todo]
        while len(todo):
            x = ~self.high[(at[todo] + out[todo]) >> 6]
            out[todo] += np.bitwise_count((x & -x) - np.uint64(1))
            todo = todo[x == 0]
        return out

    def successor(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first element >= q, whether it equals q)."""
        if not self.n:
            return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        h = np.minimum(q >> np.uint64(self.bits), np.uint64(self.buckets)).astype(np.int64)
        start = self._zero(h - 1) + 1
        lo = start - h
        return _search(self.low, self.bits, lo, lo + self._run(start), q & np.uint64((1 << self.bits) - 1))

    def _one(self, i: np.ndarray) -> np.ndarray:
        """Bit position of the i-th one."""
        ones = 64 * np.arange(len(self.zeros)) - self.zeros.astype(np.int64)
        j = np.searchsorted(ones, i, "right") - 1
        return 64 * j + _select(self.high.take(j), (i - ones.take(j)).astype(np.uint64))

    def at(self, i: np.ndarray) -> np.ndarray:
        """Elements by index (a search for the ones)."""
        high = (self._one(i) - i).astype(np.uint64)
        return (high << np.uint64(self.bits)) | _unpack(self.low, i, self.bits)

    # pointers have no low bits: a one for each context, followed by a zero for each child

    def children(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first child, first child of the next context)."""
        bit = self._one(rank)
        lo = bit - rank
        x = self.high.take(bit >> 6) >> (bit & 63).astype(np.uint64) >> np.uint64(1)
        hi = lo + np.bitwise_count((x & -x) - np.uint64(1))
        far = np.flatnonzero(x == 0)
        if len(far):
            hi[far] = self._one(rank[far] + 1) - (rank[far] + 1)
        return lo, hi

    def parent(self, child: np.ndarray) -> np.ndarray:
        return self._zero(child) - child - 1


# ---- level files ----------------------------------------------------------

def _local(uri: str) -> str | None:
    """Path of a file in a mounted store, else None."""
    if uri.startswith("/"):
        return uri
    m = re.match(r"file:/+(.*)", uri)
    return "/" + m[1] if m else None


def _fs(uri: str):
    from pyarrow import fs
    path = _local(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)


def save_arrays(uri: str, arrays: dict) -> None:
    """One file: a JSON header line, then the arrays at multiples of 8 bytes."""
    heads, at, body = [], 0, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        heads.append([name, a.dtype.str, len(a), at])
        body.append(a.tobytes() + b"\0" * (-a.nbytes % 8))
        at += len(body[-1])
    head = json.dumps(heads).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    fs, path = _fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp) as f:
        f.write(head)
        for b in body:
            f.write(b)
    fs.move(temp, path)


def map_arrays(uri: str) -> dict:
    path = _local(uri)
    if path is None:
        path = os.path.join(tempfile.gettempdir(), "corpusmill-lm-" + re.sub(r"\W", "_", uri))
        if not os.path.exists(path):
            fs, src = _fs(uri)
            temp = f"{path}.{uuid.uuid4().hex}"
            with fs.open_input_stream(src) as a, open(temp, "wb") as b:
                while block := a.read(1 << 22):
                    b.write(block)
            os.replace(temp, path)
    with open(path, "rb") as f:
        head = f.readline()
    raw = np.asarray(np.memmap(path, np.uint8, "r"))       # a plain view: slices of a memmap cost more
    out = {}
    for name, kind, n, at in json.loads(head):
        start = len(head) + at
        out[name] = raw[start:start + n * np.dtype(kind).itemsize].view(kind)
    return out


def _named(prefix: str, arrays: dict) -> dict:
    return {f"{prefix}.{k}": a for k, a in arrays.items()}


def _part(arrays: dict, prefix: str) -> dict:
    return {k[len(prefix) + 1:]: a for k, a in arrays.items() if k.startswith(prefix + ".")}


def _mix(keys: np.ndarray) -> np.ndarray:
    x = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def _by_shard(shard: np.ndarray) -> np.ndarray:
    """Stable order by shard; two-byte numbers are sorted by their digits."""
    return np.argsort(shard.astype(np.uint16) if not len(shard) or shard.max() < 1 << 16 else shard, kind="stable")


def _planes(values: np.ndarray) -> bytes:
    """Byte planes, compressed: small numbers cost what their low bytes do."""
    import pyarrow as pa
    v = np.ascontiguousarray(values)
    planes = v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unplanes(data: bytes, kind) -> np.ndarray:
    import pyarrow as pa
    size = np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    raw = np.frombuffer(planes, np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


class Model:
    """A built trie: sizes, the level folders, and memory-mapped queries."""

    def __init__(self, folder: str, mu: float):
        self.folder, self.mu, self.order = folder, mu, 1
        self.tokens = self.words = self.docs = 0
        self.word_shards, self.offsets = 1, [0]     # ids of shard s start at offsets[s]
        self.shards, self.bases = {}, {}
        self._open = {}

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def _file(self, level: int, shard: int) -> dict:
        at = (level, shard)
        if at not in self._open:
            a = map_arrays(f"{self.folder}/level{level}/{shard:06d}.ef")
            own = dict(a)
            for p in ("words", "contexts", "pointers"):
                if f"{p}.n" in a:
                    own[p] = EliasFano(_part(a, p))
            self._open[at] = own
        return self._open[at]

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of word hashes (uint64)."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = (hashes % np.uint64(self.word_shards)).astype(np.int64)
        for s in np.unique(shard) if self.words else []:
            at = np.flatnonzero(shard == s)
            f = self._file(1, int(s))
            i, same = f["words"].successor(hashes[at])
            at, i = at[same], i[same]
            ids[at], counts[at] = i + self.offsets[s], f["counts"][i]
        return ids, counts

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.tokens + self.words + 1)

    def width(self) -> int:
        """Bits of a word's id in the levels."""
        return self.words.bit_length()

    def lookup(self, level: int, context: np.ndarray, word: np.ndarray, nodes_only: bool = False):
        """(node or -1, probability, count) of (context node, word)."""
        node = np.full(len(context), -1, np.int64)
        p, count = (None, None) if nodes_only else (np.ones(len(context)), np.zeros(len(context), np.int64))
        known = np.flatnonzero((context >= 0) & (word >= 0))
        if not len(known) or level not in self.shards:
            return node, p, count
        size = np.uint64(self.words + 1)
        keys, back = np.unique(context[known].astype(np.uint64) * size + word[known].astype(np.uint64), return_inverse=True)
        shard = (_mix(keys) % np.uint64(self.shards[level])).astype(np.int64)
        order = _by_shard(shard)
        keys, shard = keys[order], shard[order]         # ascending within each shard
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ctx = keys // size
        w = keys - ctx * size
        first = np.r_[True, (ctx[1:] != ctx[:-1]) | (shard[1:] != shard[:-1])]
        u_node = np.full(len(keys), -1, np.int64)
        u_p, u_count = (None, None) if nodes_only else (np.ones(len(keys)), np.zeros(len(keys), np.int64))
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            s = int(shard[a])
            f = self._file(level, s)
            head = np.flatnonzero(first[a:b])
            rank, here = f["contexts"].successor(ctx[a:b][head])
            lo, hi = np.zeros((2, len(head)), np.int64)
            lo[here], hi[here] = f["pointers"].children(rank[here])
            times = np.diff(np.r_[head, b - a])
            i, same = _among(f["children"], self.width(), self.words + 1, np.repeat(lo, times), np.repeat(hi, times), w[a:b])
            at, i = np.flatnonzero(same) + a, i[same]
            u_node[at] = i + self.bases[level][s]
            if not nodes_only:
                u_p[at] = PROBABILITY.take(f["codes"].take(i))
                if "counts" in f:
                    u_count[at] = f["counts"].take(i)
        back = place.take(back)
        node[known] = u_node.take(back)
        if not nodes_only:
            p[known], count[known] = u_p.take(back), u_count.take(back)
        return node, p, count

    def walk(self, ids: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """p(word | longest known context) for every position.  ``first`` marks the first position of each text."""
        p = self.unigram(counts)
        start = np.int64(self.words)                       # node of the text start
        context = np.r_[start, ids[:-1]] if len(ids) else ids
        context[first] = start
        seen = np.r_[0, counts[:-1]] if len(ids) else counts
        seen[first] = self.docs
        for level in range(2, self.order + 1):
            node, own, count = self.lookup(level, context, ids)
            p = np.where(node >= 0, own, self.mu * p / (seen + self.mu))
            context = np.r_[-1, node[:-1]] if len(ids) else ids
            context[first] = -1
            seen = np.r_[0, count[:-1]] if len(ids) else counts
            seen[first] = 0
        return p

    def contexts(self, ids: np.ndarray, first: np.ndarray, level: int) -> np.ndarray:
        """The node of the ``level - 1`` words before every position (-1 unknown or cut off by the text's start)."""
        start = np.int64(self.words)
        context = np.r_[start, ids[:-1]] if len(ids) else ids
        context[first] = start
        for below in range(2, level):
            node = self.lookup(below, context, ids, nodes_only=True)[0]
            context = np.r_[-1, node[:-1]] if len(ids) else ids
            context[first] = -1
        return context


# ---- blocks of documents --------------------------------------------------

def split_text(text: str | None) -> list[bytes]:
    """Lower-cased words and the end token.  On bytes, lower() touches A-Z only
    and split() cuts at 0x20 and 0x09-0x0D only."""
    return [*(text or "").encode().lower().split(), END]


def _words(text) -> tuple:
    """(words of all texts of an Arrow column, tokens of each text), as by :func:`split_text` without the ends, which
    are counted only.  Arrow's split leaves an empty word where a text begins or ends with a space."""
    import pyarrow as pa
    import pyarrow.compute as pc
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    flat = lists.flatten()
    full = np.asarray(pc.binary_length(flat)) > 0
    upto = np.r_[0, np.cumsum(full)]
    ends = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(lists)))]
    return flat.filter(pa.array(full)), np.diff(upto[ends]) + 1


def _numbered(words: list, sizes: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(different words and the end token, number of the word at each token)."""
    import pyarrow as pa
    coded = pa.concat_arrays(words).dictionary_encode()
    table = [*coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), END]
    numbers = np.full(int(sizes.sum()), len(table) - 1, np.int64)
    inside = np.ones(len(numbers), bool)
    inside[np.cumsum(sizes) - 1] = False
    numbers[inside] = np.asarray(coded.indices)
    del coded
    words.clear()
    pa.default_memory_pool().release_unused()       # a worker would keep the memory of its largest block
    return table, numbers


def _blocks(batches, block_tokens: int):
    """(rows before the text column, words table, word numbers, tokens per text)."""
    words, sizes, rows, total = [], [], [], 0
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        others = [batch.column(i) for i in range(batch.num_columns - 1)]
        for at in range(0, batch.num_rows, 64):
            w, n = _words(text.slice(at, 64))
            words.append(w)
            sizes.append(n)
            total += int(n.sum())
            rows.append([c.slice(at, 64) for c in others])
            if total >= block_tokens:
                sizes = np.concatenate(sizes)
                yield rows, *_numbered(words, sizes), sizes
                words, sizes, rows, total = [], [], [], 0
    if rows:
        sizes = np.concatenate(sizes)
        yield rows, *_numbered(words, sizes), sizes


def _hashes(words) -> np.ndarray:
    import xxhash
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words))


def _firsts(sizes: np.ndarray) -> np.ndarray:
    first = np.zeros(int(sizes.sum()), bool)
    first[np.cumsum(sizes) - sizes] = True
    return first


def _count_words(block_tokens):
    def run(batches):
        import pyarrow as pa
        for _, table, numbers, _ in _blocks(batches, block_tokens):
            yield pa.RecordBatch.from_arrays(
                [pa.array(table, pa.binary()).cast(pa.string()), pa.array(np.bincount(numbers, minlength=len(table)))],
                ["word", "n"])
    return run


def _count_grams(model: Model, level: int, block_tokens: int, shards: int):
    def run(batches):
        import pyarrow as pa
        for _, table, numbers, sizes in _blocks(batches, block_tokens):
            ids = model.word_ids(_hashes(table))[0][numbers]
            context = model.contexts(ids, _firsts(sizes), level)
            at = np.flatnonzero(context >= 0)
            keys = context[at].astype(np.uint64) * np.uint64(model.words + 1) + ids[at].astype(np.uint64)
            keys, n = np.unique(keys, return_counts=True)
            shard = (_mix(keys) % np.uint64(shards)).astype(np.int64)
            order = _by_shard(shard)
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            out = []
            for s in range(shards):
                mine = order[cuts[s]:cuts[s + 1]]
                if len(mine):
                    k = keys[mine]
                    out.append((s, _planes(np.diff(k, prepend=np.uint64(0))), _planes(n[mine].astype(np.uint32))))
            if out:
                s, k, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.binary()),
                                                  pa.array(c, pa.binary())], ["shard", "keys", "counts"])
    return run


def _build_level(model: Model, level: int, last: bool):
    def run(table):
        import pyarrow as pa
        shard = table.column("shard")[0].as_py()
        keys = np.concatenate([np.cumsum(_unplanes(k.as_py(), np.uint64)) for k in table.column("keys")])
        n = np.concatenate([_unplanes(c.as_py(), np.uint32) for c in table.column("counts")]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, n = keys[cut], np.add.reduceat(n, cut)
        size = np.uint64(model.words + 1)
        ctx, word = (keys // size).astype(np.int64), keys % size
        p = _smoothed(model, level, ctx, word.astype(np.int64), n)
        codes = np.clip(np.rint(-np.log10(p) / CODE_STEP), 0, 65535).astype(np.uint16)
        head = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
        contexts = ctx[head].astype(np.uint64)
        arrays = {**_named("contexts", ef_build(contexts, int(contexts[-1]) + 1)),
                  **_named("pointers", ef_build(np.r_[head, len(ctx)].astype(np.uint64), len(ctx) + 1, 0)),
                  "children": _pack(word, model.width()), "codes": codes}
        if not last:
            arrays["counts"] = n.astype(np.uint32)
        save_arrays(f"{model.folder}/level{level}/{shard:06d}.ef", arrays)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64())})
    return run


def _smoothed(model: Model, level: int, ctx, word, n) -> np.ndarray:
    """(c(hw) + mu p(w | h')) / (c(h) + mu) for the k-grams of one shard."""
    lower = model.lower(level, ctx, word)
    return (n + model.mu * lower) / (model.counts_of(level - 1, ctx) + model.mu)


def _by_file(self, level: int, nodes: np.ndarray):
    """(file, slice of the ascending nodes in it, their places in it)."""
    base = np.array(self.offsets if level == 1 else self.bases[level])
    shard = np.searchsorted(base, nodes, "right") - 1
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]).tolist() if len(nodes) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        s = int(shard[a])
        yield self._file(level, s), slice(a, b), nodes[a:b] - base[s]


def _counts_of(self, level: int, node: np.ndarray) -> np.ndarray:
    """Counts of the nodes of a level; the start node of level 1 counts texts."""
    uniq, back = np.unique(node, return_inverse=True)
    got = np.zeros(len(uniq), np.int64)
    inner = int(np.searchsorted(uniq, self.words)) if level == 1 else len(uniq)
    for f, part, i in self.by_file(level, uniq[:inner]):
        got[part] = f["counts"][i]
    if level == 1:
        got[inner:] = self.docs
    return got[back]


def _gram(self, level: int, node: np.ndarray):
    """(context node, word) of ascending nodes of a level above 1."""
    ctx, word = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
    for f, part, i in self.by_file(level, node):
        if level > 2:                   # a suffix of two words needs no more than the last
            ctx[part] = f["contexts"].at(f["pointers"].parent(i)).astype(np.int64)
        word[part] = _unpack(f["children"], i, self.width()).astype(np.int64)
    return ctx, word


def _suffix(self, level: int, node: np.ndarray) -> np.ndarray:
    """Node of a level's gram without its first word, one level lower."""
    uniq, back = np.unique(node, return_inverse=True)
    ctx, word = self.gram(level, uniq)
    return (word if level == 2 else self.lookup(level - 1, self.suffix(level - 1, ctx), word, nodes_only=True)[0])[back]


def _lower(self, level: int, ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    """p(word | context without its first word)."""
    if level == 2:
        return self.unigram(self.counts_of(1, word))
    node, p, _ = self.lookup(level - 1, self.suffix(level - 1, ctx), word)
    if len(other := np.flatnonzero(node < 0)):
        p[other] = self.unigram(self.counts_of(1, word[other]))
    return p


Model.by_file, Model.counts_of, Model.gram, Model.suffix, Model.lower = _by_file, _counts_of, _gram, _suffix, _lower


def train(docs: DataFrame, text: str = "text", order: int = 2, mu: float = 50.0, folder: str | None = None,
          block_tokens: int = 1 << 21, shard_tokens: int = 1 << 21) -> Model:
    """Builds the levels from the texts of ``docs``; returns the model (its
    sizes and folder; the levels stay in their files)."""
    spark = docs.sparkSession
    model = Model(folder or f"{checkpoint_dir(spark).rstrip('/')}/corpusmill-lm-{uuid.uuid4().hex}", mu)
    model.order = order
    texts = docs.select(F.col(text).alias("text"))
    words = materialize(texts.mapInArrow(_count_words(block_tokens), "word string, n long")
                        .groupBy("word").agg(F.sum("n").alias("n"))
                        .select(F.xxhash64("word").alias("h"), "n",
                                F.when(F.col("word") == END.decode(), F.col("n")).alias("ends")), "words")
    size = words.agg(F.count(F.lit(1)), F.countDistinct("h"), F.sum("n"), F.max("ends")).first()
    if size[0] != size[1]:
        raise ValueError("two words share a hash")
    model.words, model.tokens, model.docs = size[0], size[2] or 0, size[3] or 0
    if not model.words:
        return model
    model.word_shards = max(1, -(-model.words // (1 << 20)))

    def build_words(table):
        import pyarrow as pa
        shard = table.column("shard")[0].as_py()
        h = np.asarray(table.column("h")).view(np.uint64)
        order = np.argsort(h)
        save_arrays(f"{model.folder}/level1/{shard:06d}.ef", {
            **_named("words", ef_build(h[order], 1 << 64)),
            "counts": np.asarray(table.column("n"))[order].astype(np.int64)})
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(h)], pa.int64())})

    # the unsigned remainder, as the queries take it
    s = model.word_shards
    unsigned = F.pmod(F.col("h"), F.lit(s)) + F.when(F.col("h") < 0, F.lit((1 << 64) % s)).otherwise(0)
    sizes = words.select(F.pmod(unsigned, F.lit(s)).cast("int").alias("shard"), "h", "n").groupBy("shard") \
        .applyInArrow(build_words, "shard int, n long").collect()        # one row per shard
    n = {r["shard"]: r["n"] for r in sizes}
    model.offsets = [sum(n.get(i, 0) for i in range(k)) for k in range(s)]
    shards = max(1, -(-model.tokens // shard_tokens))
    for level in range(2, order + 1):
        parts = texts.mapInArrow(_count_grams(model, level, block_tokens, shards),
                                 "shard int, keys binary, counts binary")
        sizes = parts.repartition(shards, "shard").groupBy("shard") \
            .applyInArrow(_build_level(model, level, level == order), "shard int, n long").collect()
        n = {r["shard"]: r["n"] for r in sizes}
        for k in range(shards):
            if k not in n:
                save_arrays(f"{model.folder}/level{level}/{k:06d}.ef", {
                    **_named("contexts", ef_build(np.empty(0, np.uint64), 1)),
                    **_named("pointers", ef_build(np.zeros(1, np.uint64), 1, 0)),
                    "children": _pack(np.empty(0, np.uint64), model.width()), "codes": np.empty(0, np.uint16),
                    **({} if level == order else {"counts": np.empty(0, np.uint32)})})
        model.bases[level] = [sum(n.get(i, 0) for i in range(k)) for k in range(shards)]
        model.shards[level] = shards
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text",
          block_tokens: int = 1 << 20) -> DataFrame:
    """Per row of ``docs``: id, n_tokens, n_known, base_score and score
    (log10 probabilities under the add-one unigram and the trie)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        for rows, table, numbers, sizes in _blocks(batches, block_tokens):
            ids, counts = model.word_ids(_hashes(table))
            alone = np.log10(model.unigram(counts))[numbers]       # once for each word of the block
            ids, counts = ids[numbers], counts[numbers]
            p = model.walk(ids, counts, _firsts(sizes))
            at = np.cumsum(sizes) - sizes
            base = np.add.reduceat(alone, at)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([r[0] for r in rows]), pa.array(sizes),
                 pa.array(np.add.reduceat((counts > 0).astype(np.int64), at)), pa.array(base),
                 pa.array(np.add.reduceat(np.log10(p), at))],
                ["id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {id_type}, n_tokens long, n_known long, base_score double, score double")
