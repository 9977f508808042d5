"""Phrase mining against a brute-force count."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import phrases as P
from tests.llm.conftest import DOCS


def brute(rows, words, min_count, top, share):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        total[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, words + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i:i + n])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out = {}
    for (lang, p), a in cand.items():
        best = min((10 ** 6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(g == lang and len(q) > len(p) and 100 * b >= share * a and
                     any(q[i:i + len(p)] == p for i in range(len(q))) for (g, q), b in cand.items())
        if not inside:
            k = best[1]
            out.setdefault(lang, []).append((-best[0], -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, x, y, total[lang], -s) for lang, c in out.items()
                  for i, (s, a, p, x, y) in enumerate(sorted(c)[:top], start=1))


def corpus():
    rng = random.Random(6)
    pool = ["new", "York", "city", "été", "a", "b", "The", "\U0001F600", "x y"]
    rows = []
    for i in range(150):
        t = "".join(rng.choice(pool) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), t if i % 9 else t.strip()))
    rows += [("en", None), (None, ""), ("de", None), ("fr", ". , ;"), ("en", "one word"), rows[3], rows[3],
             ("en", " ".join(rng.choice(pool) for _ in range(30_000)))]
    return rows


def run(spark, rows, top=40, share=50, words=3, **options):
    df = spark.createDataFrame([(i, t, lang, "s", 1, "x", 1, "k", 2, "i", True, 3, 4) for i, (lang, t) in enumerate(rows)], DOCS)
    got = P.collocations(P.phrase_counts(df.repartition(3), words=words, **options), top=top, share=share, words=words)
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect())


@pytest.mark.parametrize("options", [{}, {"filter_bits": 64, "block": 300, "hold": 50}, {"words": 4, "filter_bits": 1 << 16}])
def test_equals_brute_force(spark, options):
    rows = corpus()
    got = run(spark, rows, min_count=10, **options)
    assert got == brute(rows, options.get("words", 3), 10, 40, 50) and got


def test_top_and_share(spark):
    rows = corpus()
    assert run(spark, rows, top=3, share=90, min_count=4) == brute(rows, 3, 4, 3, 90)


def test_empty(spark, empty):
    assert P.collocations(P.phrase_counts(empty)).collect() == []
    assert run(spark, [("en", None), (None, "")]) == []


def test_collisions_between_blocks_are_told_apart_by_text(spark):
    """First fingerprints of 7 bits: nearly all collide, in a block and between blocks."""
    rows = corpus()
    assert run(spark, rows, min_count=10, block=300, fp_bits=7) == brute(rows, 3, 10, 40, 50)


def test_lost_pointers_fall_back_to_all_texts(spark, monkeypatch):
    rows = corpus()
    real = P._owner_bits
    monkeypatch.setattr(P, "_owner_bits", lambda t: real(t.withColumn("at", P.F.lit(99).cast("long"))))
    assert run(spark, rows, min_count=10, filter_bits=1 << 16) == brute(rows, 3, 10, 40, 50)


def test_colliding_fingerprints_are_told_apart():
    text = b"ab cd ab cd xy zz ab"
    b = P.Block(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    b.row_key = np.zeros(1, np.int32)
    at, c, _ = P.read_phrases(b, np.arange(7), np.full(7, 5, np.uint64), 1)
    got = {b.text[b.start[i]:b.end[i]].tobytes(): k for i, k in zip(at.tolist(), c.tolist(), strict=True)}
    assert got == {b"ab": 3, b"cd": 2, b"xy": 1, b"zz": 1}


def test_equal_phrases_have_equal_fingerprints():
    rows = [b"x One  two", b"one\ttwo three.", b"two", b"", b"one", b"two"]
    data = np.frombuffer(b"".join(rows), np.uint8)
    b = P.Block(data, np.cumsum([0] + [len(r) for r in rows]))
    assert [b.text[s:e].tobytes() for s, e in zip(b.start, b.end, strict=True)] == \
        [b"x", b"one", b"two", b"one", b"two", b"three", b"two", b"one", b"two"]
    powers, seed = P._Powers(), np.zeros(len(rows), np.uint64)
    fp, ok = b.fingerprints(2, seed, powers), b.whole(2)
    assert fp[1] == fp[3] == fp[7] and len(set(fp.tolist())) == 5 and not ok[7] and not ok[2] and ok[1] and ok[3]


def test_products_beyond_64_bits(spark):
    big = 9 * 10 ** 14
    row = spark.range(1).select(*[P.F.lit(x).cast("long").alias(n) for n, x in (("a", big), ("l", big + 7), ("r", big + 5))])
    got = row.select(P.score(P.F.col("a"), P.F.col("l"), P.F.col("r"))).first()[0]
    assert got == 10 ** 6 * big * big // ((big + 7) * (big + 5))
