"""Operator 6: SentencePiece BPE encoding and decoding by vectorised merge
rounds.

A text is prefixed with one space and cut before each run of spaces; no piece
of the vocabulary crosses such a cut (checked when the model is loaded), so
equal words have equal pieces.  The distinct words of a block that a worker has not yet met are
encoded together, in flat numpy symbol arrays.  In each round

1. the least pair rank of every word is found with a segmented minimum,
2. all pairs of that rank merge at once, leftmost first where they overlap,
3. the arrays are compacted and finished words leave,

until no pair remains.  A merge that could create a pair of the same or a
better rank is done only at its leftmost place per round, so the result is
that of merging one pair at a time.  Characters outside the vocabulary become
byte pieces.  Decoding gathers the pieces' bytes and drops the space that
encoding had put in front.

The model file is read on the driver (its size is that of the vocabulary, under
1 MB here) and sent with the task.  Rows are encoded in blocks of about a
million characters and the word table is emptied at ``max_words``, so memory
is bounded whatever the documents are; one text is the smallest block.

Defined cases: null and empty texts have no ids and decode to the empty
text; U+2581 in a text decodes to a space, as in the library; repeated rows are
each encoded; an empty table gives an empty result.  Ids outside the vocabulary raise.  Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"          # fixed value: how the vocabulary writes a space
NO_PAIR = np.iinfo(np.int32).max


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(s, s + n)`` for each start and length."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class PieceModel:
    """Vocabulary tables of one SentencePiece BPE model."""

    def __init__(self, proto: bytes):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.size = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        scores = [sp.get_score(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.byte_id = np.full(256, -1)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(names[i][3:-1], 16)] = i
        self.unk = sp.unk_id()
        own = {p: i for i, p in enumerate(names) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in own):
            raise ValueError("a piece crosses a word start; this model cannot be cut into words")
        cut = "" if any("\n" in p for p in own) else "\\n"
        self.words = re.compile(rf" +[^ {cut}]*" + (r"|\n" if cut else "") + rf"|[^ {cut}]+").findall
        distinct = sorted({scores[i] for i in own.values()}, reverse=True)
        place = {s: r for r, s in enumerate(distinct)}
        rank = {i: place[scores[i]] for i in own.values()}
        count = np.zeros(len(distinct), int)
        for r in rank.values():
            count[r] += 1
        # symbols: a piece's id, or n + code point for a character that is no piece
        keys, merged = [], []
        unsafe = np.zeros(n, bool)
        for p, i in own.items():
            unsafe[i] |= count[rank[i]] > 1
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                left, right = own.get(a), own.get(b)
                for x in (left, right):
                    if x is not None and rank[i] <= rank[x]:
                        unsafe[x] = True
                if (left is None and len(a) > 1) or (right is None and len(b) > 1):
                    continue
                keys.append(((n + ord(a) if left is None else left) << 32) | (n + ord(b) if right is None else right))
                merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.merged = np.array(merged, np.int32)[order]
        self.rank = np.full(n, NO_PAIR, np.int32)
        for i, r in rank.items():
            self.rank[i] = r
        self.unsafe = unsafe
        self.single = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in own.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        raw = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else
               bytes([int(names[i][3:-1], 16)]) if sp.is_byte(i) else names[i].replace(SPACE, " ").encode()
               for i in range(n)]
        self.lengths = np.array([len(b) for b in raw])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(raw), np.uint8)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged piece of each pair, -1 where there is none."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids per word)."""
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        sym = self.single[points]
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []

        def pair_up(sym, word):
            m = np.full(len(sym), -1, np.int32)
            same = np.flatnonzero(word[1:] == word[:-1])
            m[same] = self._pairs(sym[same], sym[same + 1])
            return m

        m = pair_up(sym, word)
        while len(sym):
            r = np.where(m >= 0, self.rank[m], NO_PAIR)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(r, first)
            count = np.diff(np.r_[first, len(sym)])
            live = np.repeat(best < NO_PAIR, count)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, m, r = sym[live], word[live], m[live], r[live]
                best, count = best[best < NO_PAIR], count[best < NO_PAIR]
                if not len(sym):
                    break
            hit = np.flatnonzero(r == np.repeat(best, count))
            # leftmost of each overlapping run: the even places in runs of neighbours
            new_run = np.r_[True, hit[1:] != hit[:-1] + 1]
            run_start = np.flatnonzero(new_run)
            place = np.arange(len(hit)) - np.repeat(run_start, np.diff(np.r_[run_start, len(hit)]))
            new_word = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            hit = hit[np.where(self.unsafe[m[hit]], new_word, place % 2 == 0)]
            sym[hit] = m[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[hit]
            sym, word, m = sym[keep], word[keep], m[keep]
            # only the merged symbols and their left neighbours have new pairs
            changed = np.unique(np.r_[at, at[at > 0] - 1])
            has = changed[(changed + 1 < len(sym))]
            has = has[word[has] == word[has + 1]]
            m[changed] = -1
            m[has] = self._pairs(sym[has], sym[has + 1])
        sym = np.concatenate(done_sym) if done_sym else np.empty(0, np.int32)
        word = np.concatenate(done_word) if done_word else np.empty(0, np.int64)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        # characters that are no piece: their UTF-8 bytes
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):
            spelled = [chr(c - self.size).encode("utf-8", "surrogatepass") for c in sym[odd].tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(b) for b in spelled]
            at = np.cumsum(times) - times
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            ids = self.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
            sym[_ranges(at[odd], times[odd])] = np.where(ids < 0, self.unk, ids)
        return sym.astype(np.int32), np.bincount(word, minlength=len(words))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, bytes per text) of texts given as flat ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("id outside the vocabulary")
        size = self.lengths[ids]
        data = self.blob[_ranges(self.starts[ids], size)]
        ends = np.r_[0, np.cumsum(size)]
        last = np.cumsum(counts)
        per = ends[last] - ends[last - counts]
        start = ends[last - counts]
        lead = np.zeros(len(per), bool)
        some = per > 0
        first_piece = np.zeros(len(per), np.int64)
        first_piece[counts > 0] = ids[(last - counts)[counts > 0]]
        lead[some] = (data[start[some]] == 32) & (first_piece[some] != self.byte_id[32])
        keep = np.ones(len(data), bool)
        keep[start[lead]] = False
        return data[keep], per - lead


class _Words(dict):
    """Word to number; new words are listed for encoding."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, w):
        self.new.append(w)
        n = self[w] = len(self)
        return n


class Encoder:
    """Encodes blocks of texts, keeping the words met so far."""

    def __init__(self, proto: bytes, max_words: int = 400_000):
        self.model, self.max_words = PieceModel(proto), max_words
        self._clear()

    def _clear(self):
        self.table = _Words()
        self.ids, self.count = np.empty(0, np.int32), np.empty(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text)."""
        if len(self.table) > self.max_words:
            self._clear()
        split = self.model.words
        words, per = [], []
        for t in texts:
            w = split(" " + t.replace(SPACE, " ")) if t else []
            words += w
            per.append(len(w))
        at = np.fromiter(map(self.table.__getitem__, words), np.int64, len(words))
        if self.table.new:
            ids, count = self.model.encode_words(self.table.new)
            self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count])
            self.table.new = []
        start = np.cumsum(self.count) - self.count
        n = self.count[at]
        ids = self.ids[_ranges(start[at], n)]
        bounds = np.fromiter(accumulate(per, initial=0), np.int64, len(per) + 1)
        total = np.r_[0, np.cumsum(n)]
        return ids, total[bounds[1:]] - total[bounds[:-1]]


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(proto: bytes) -> Encoder:
    """One encoder per model and Python worker."""
    key = hashlib.sha1(proto).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(proto)
    return _ENCODERS[key]


def texts_of(data: np.ndarray, sizes: np.ndarray):
    """Arrow strings of concatenated UTF-8; a text that is not UTF-8 (ids made
    by hand) has its stray bytes replaced."""
    import pyarrow as pa
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    out = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:
        raw = data.tobytes()
        out = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:], strict=False)],
                       pa.string())
    return out


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text",
                  block_chars: int = 1 << 20) -> DataFrame:
    """Per row of ``docs``: id, ids and decoded (the text of the ids)."""
    with open(model_path, "rb") as f:
        proto = f.read()
    id_type = docs.schema[id_col].dataType

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        enc = encoder(proto)
        for batch in batches:
            key, col = batch.column(0), batch.column(1)
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0)))
            at = 0
            while at < batch.num_rows:
                base = int(sizes[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, base + block_chars, "right")))
                ids, counts = enc.encode(col.slice(at, end - at).to_pylist())
                data, length = enc.model.decode(ids, counts)
                offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([key.slice(at, end - at), lists, texts_of(data, length)],
                                                 ["id", "ids", "decoded"])
                at = end

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {id_type.simpleString()}, ids array<int>, decoded string")
