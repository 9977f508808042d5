import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm.ngramlm import (EliasFano, _among, _blocks, _by_shard, _pack, _planes, _select, _unplanes, ef_build,
                                     score, split_text, train)
from corpusmill.llm.queries import QUERIES


@pytest.mark.parametrize("universe,n", [(1 << 64, 5000), (1 << 30, 20000), (1000, 400), (50, 50), (10 ** 12, 1), (9, 0)])
def test_elias_fano(universe, n):
    rng = np.random.default_rng(0)
    v = np.unique(rng.integers(0, universe - 1, n, dtype=np.uint64))
    e = EliasFano(ef_build(v, universe))
    assert (e.at(np.arange(len(v))) == v).all()
    q = np.concatenate([v, rng.integers(0, universe - 1, 3000, dtype=np.uint64)])
    i, same = e.successor(q)
    assert (same == np.isin(q, v)).all() and (i == np.searchsorted(v, q)).all()


def test_elias_fano_is_small():
    v = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 100_000, dtype=np.uint64))
    assert sum(a.nbytes for a in ef_build(v, 1 << 40).values()) < 0.5 * v.nbytes


def test_words():
    assert split_text("AÄb \x0b\x0c\r\n c d\x1c") == ["aÄb".encode(), "c d\x1c".encode(), b"\n"]
    assert split_text(None) == split_text("") == [b"\n"]


def tokens(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + ["\n"]


def brute(train_rows, rows, order, mu):
    c = [Counter() for _ in range(order + 1)]
    ctx = [Counter() for _ in range(order + 1)]
    for t in map(tokens, train_rows):
        c[1].update(t)
        for k in range(2, order + 1):
            s = [""] + t
            for i in range(len(s) - k + 1):
                g = tuple(s[i:i + k])
                c[k][g] += 1
    n, v = sum(c[1].values()), len(c[1])

    def count(h):
        if len(h) == 1:
            return len(train_rows) if h[0] == "" else c[1][h[0]]
        return c[len(h)][h]

    def p(h, w):
        if not h:
            return (c[1][w] + 1) / (n + v + 1)
        return (c[len(h) + 1][(*h, w)] + mu * p(h[1:], w)) / (count(h) + mu)

    out = []
    for r in rows:
        t = tokens(r)
        s = [""] + t
        total = sum(math.log10(p(tuple(s[max(0, i - order + 1):i]), s[i])) for i in range(1, len(s)))
        out.append((len(t), sum(c[1][w] > 0 for w in t), sum(math.log10(p((), w)) for w in t), total))
    del ctx
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(docs, rows, order):
    model = train(docs.filter("doc_id % 2 = 0"), order=order, mu=5.0, block_tokens=3000, shard_tokens=4000)
    fit = [r[1] for r in rows if r[0] is not None and r[0] % 2 == 0]
    assert model.docs == len(fit) and model.tokens == sum(len(tokens(t)) for t in fit)
    got = sorted(((r["id"] is None, r["id"] or 0, r["n_tokens"], r["n_known"], r["base_score"], r["score"])
                  for r in score(docs, model, block_tokens=5000).collect()))
    exp = sorted((r[0] is None, r[0] or 0, *b) for r, b in zip(rows, brute(fit, [r[1] for r in rows], order, 5.0),
                                                             strict=True))
    for a, b in zip(got, exp, strict=True):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9)
        assert a[5] == pytest.approx(b[5], abs=2e-4 * a[2] + 1e-6)       # the codes' rounding


def test_held_out_text_scores_above_the_unigram(docs, rows):
    model = train(docs.filter("doc_id <> 9"), mu=5.0)
    r = {x["id"]: x for x in score(docs, model).collect()}
    assert r[8]["score"] > r[8]["base_score"]


def test_the_registered_query_scores_trigrams(spark, tmp_path):
    texts = ["a b c", "x b d"] * 40 + ["a b d", "x b c"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    fit = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    got = sorted(QUERIES["op3_lm_score"](spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"])
    for r, exp in zip(got, brute(fit, texts, 3, 50.0), strict=True):
        assert r["score"] == pytest.approx(exp[3], abs=2e-3)
    assert got[0]["score"] > got[80]["score"] + 0.1                 # the bigrams are alike


def test_empty(empty, docs):
    model = train(empty)
    assert score(empty, model).count() == 0
    assert all(r["n_known"] == 0 and r["base_score"] == 0 for r in score(docs, model).collect())


def test_select_and_runs_in_long_and_empty_words():
    """Set bits of every word, runs of ones over several words, and a search that does not copy its directory."""
    rng = np.random.default_rng(3)
    for v in [0xFFFFFFFFFFFFFFFF, 1, 1 << 63, 0x8000000000000001, *(int(x) for x in rng.integers(0, 1 << 63, 40))]:
        bits = [i for i in range(64) if v >> i & 1]
        assert _select(np.full(len(bits), v, np.uint64), np.arange(len(bits), dtype=np.uint64)).tolist() == bits
    for n, universe in ((0, 1), (1, 1), (1, 1 << 40), (900, 3), (700, 700), (5000, 1 << 20), (3000, 1 << 60)):
        v = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
        e = EliasFano(ef_build(v, universe))
        q = np.unique(np.r_[v, rng.integers(0, universe + 3, 500, dtype=np.uint64), np.uint64(universe + 5), np.uint64(0)])
        lo, same = e.successor(q)
        assert lo.tolist() == np.searchsorted(v, q).tolist() and same.tolist() == np.isin(q, v).tolist()
        if n:
            assert e.at(np.arange(n)).tolist() == v.tolist()


def test_shards_beyond_two_bytes_are_ordered():
    for shard in ([], [3, 0, 3, 1], [70_000, 4464, 70_000, 0, 65_535]):
        got = _by_shard(np.array(shard, np.int64))
        assert got.tolist() == sorted(range(len(shard)), key=lambda i: shard[i])


def test_blocks_hold_the_words_of_each_text():
    """Numbered tokens are those of split_text for nulls, empty texts, spaces at the ends and any block size."""
    import pyarrow as pa
    texts = ["AÄb \x0b\x0c\r\n c d\x1c", None, "", "  ", "\n", " lead", "trail\t", "same Same SAME", "x y\u0085z w", "\x00 \x1f İ"] * 15
    batch = pa.record_batch({"id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    for size in (1, 40, 1 << 20):
        got, ids = [], []
        for rows, table, numbers, sizes in _blocks([batch.slice(0, 70), batch.slice(70, 0), batch.slice(70)], size):
            ids += [x for r in rows for x in r[0].to_pylist()]
            assert len(set(table)) == len(table) and len(numbers) == sizes.sum()
            words = [table[i] for i in numbers]
            ends = [0, *sizes.cumsum().tolist()]
            got += [words[a:b] for a, b in zip(ends, ends[1:])]
        assert ids == list(range(len(texts))) and got == [split_text(t) for t in texts]
    assert list(_blocks([batch.slice(0, 0)], 5)) == []


def test_children_are_searched_between_their_contexts_pointers():
    """Pointers give each context's range (of one child, or of more than a word of bits) and each child's context; a
    word of another context's range is not found, however unevenly the words lie."""
    rng = np.random.default_rng(5)
    sizes = np.r_[rng.integers(1, 4, 300), 1, 500, 1, 64, 63, 65, 1, rng.integers(1, 200, 20)]
    heads = np.r_[0, sizes.cumsum()]
    pointers = EliasFano(ef_build(heads.astype(np.uint64), int(heads[-1]) + 1, 0))
    rank = rng.permutation(len(sizes))
    lo, hi = pointers.children(rank)
    assert pointers.bits == 0 and lo.tolist() == heads[rank].tolist() and hi.tolist() == heads[rank + 1].tolist()
    assert pointers.parent(np.arange(heads[-1])).tolist() == np.repeat(np.arange(len(sizes)), sizes).tolist()
    for top in (600, 5000):
        own = [np.sort(rng.choice(top if i % 2 else 550, n, replace=False)) for i, n in enumerate(sizes)]
        own[301] = np.r_[np.arange(499), top]                            # all but one at the lower end
        bits = (top + 1).bit_length()
        data = _pack(np.concatenate(own).astype(np.uint64), bits)
        r = np.r_[rng.integers(0, len(sizes), 4000), np.repeat(301, 600)]
        want = np.r_[rng.integers(0, top + 1, 4000), np.arange(600)]
        at, there = _among(data, bits, top + 1, heads[r], heads[r + 1], want.astype(np.uint64))
        exp = [int(w) in set(own[x].tolist()) for x, w in zip(r, want, strict=True)]
        assert there.tolist() == exp
        assert np.concatenate(own)[at[there]].tolist() == want[there].tolist()
        assert (heads[r] <= at)[there].all() and (at < heads[r + 1])[there].all()


def test_planes_come_back():
    for values in ([], [7], [1, 1 << 40, 3, 0] * 50):
        assert _unplanes(_planes(np.array(values, np.uint64)), np.uint64).tolist() == values
