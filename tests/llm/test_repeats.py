import random
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm.queries import QUERIES
from corpusmill.llm.repeats import RunLengthIndex, remove_repeats, repeated_spans, suffix_array


def brute(texts, length):
    c = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if c[t[i:i + length]] > 1:
                m[i:i + length] = True
        out.append(m)
    return out


def test_suffix_array():
    for data in (b"banana", b"a" * 50, b"ab" * 30 + b"b", bytes(range(200)), b"mississippi" * 4):
        exp = sorted(range(len(data)), key=lambda i: data[i:])
        assert suffix_array(np.frombuffer(data, np.uint8)).tolist() == exp


def test_runs_are_compressed():
    index = RunLengthIndex([b"abcdefgh" * 50 + bytes([65 + i]) for i in range(20)])
    assert len(index.chars) < len(index.data) / 10
    assert len(index.first) == len(index.last) == len(index.starts)


def test_index_equals_brute_force():
    rng = random.Random(3)
    for trial in range(200):
        ts = [bytes(rng.choice(b"ab" if trial % 2 else b"abcd") for _ in range(rng.randint(0, 60)))
              for _ in range(rng.randint(1, 6))]
        ts = list(dict.fromkeys([*ts, ts[0] + b"c" + ts[-1], b"a" * rng.randint(0, 30)]))
        length = rng.choice([3, 5, 8, 12])
        for t, spans, exp in zip(ts, repeated_spans(ts, length), brute(ts, length), strict=True):
            m = np.zeros(len(t), bool)
            for a, b in spans:
                m[a:b] = True
            assert (m == exp).all()


@pytest.mark.parametrize("key_bytes", [4 << 20, 0])      # indexes, and the way for keys too large for one
@pytest.mark.parametrize("length", [400, 60])
def test_documents_equal_brute_force(docs, rows, key_bytes, length):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    exp = Counter()
    for (i, t), m in zip(data, brute([t for _, t in data], length), strict=True):
        runs = int((np.diff(np.r_[0, m.astype(int)]) == 1).sum())
        exp[(i, len(t), runs, np.frombuffer(t, np.uint8)[~m].tobytes())] += 1
    got = Counter((r["id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"]))
                  for r in remove_repeats(docs, length=length, key_bytes=key_bytes, shard_bytes=20_000).collect())
    assert got == exp


def test_empty(empty):
    assert remove_repeats(empty).count() == 0


def test_planted_passages_go_from_400_bytes_on(spark, tmp_path):
    """Passages of over 50 words in two documents: the query removes those of 400 bytes or more, and no shorter one."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    texts, long = [], {}
    for i in range(24):
        passage = " ".join(word(5 if i % 2 else 8) for _ in range(52 + i))      # 311 bytes and more, 476 and more
        for j in range(2):
            long[len(texts)] = len(passage) >= 400
            texts.append(" ".join([*(word(6) for _ in range(40 + i + j)), passage, *(word(6) for _ in range(30))]))
    texts += [" ".join(word(6) for _ in range(120)) for _ in range(10)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op5_repeats"](spark, str(tmp_path)).collect()}
    masks = brute([t.encode() for t in texts], 400)
    assert {True, False} == set(long.values())
    for i, m in enumerate(masks):
        assert (got[i]["n_bytes"], got[i]["n_removed"]) == (len(texts[i]), int(m.sum()))
        assert got[i]["repeats"] == long.get(i, False)
