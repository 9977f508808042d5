import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.pieces import Encoder, encode_decode, texts_of

PATH = public_tokenizers.path("piece_bpe_32k.model")
with open(PATH, "rb") as f:
    PROTO = f.read()
LIB = sentencepiece.SentencePieceProcessor(model_proto=PROTO)
ENC = Encoder(PROTO)


def check(texts, enc=ENC):
    ids, counts = enc.encode(texts)
    data, sizes = enc.model.decode(ids, counts)
    back = texts_of(data, sizes).to_pylist()
    at = np.r_[0, np.cumsum(counts)]
    for i, t in enumerate(texts):
        exp = LIB.encode(t) if t else []
        assert ids[at[i]:at[i + 1]].tolist() == exp, t
        assert back[i] == (LIB.decode(exp) if t else "")


def test_odd_texts():
    check([None, "", " ", "  ", "a", " a  b ", "\n", "\t\r\n x", "a▁b", "▁", "\x00", "\U0001F600 ١", "﻿x", "<s>", "<0x0A>"])


def test_long_words():
    check(["a" * 3000, " " * 400, "ab" * 1500, "=-" * 999, "." * 2048, "é" * 500, "the" * 700])


def test_random_texts_and_a_full_word_table():
    rng = random.Random(1)
    small = Encoder(PROTO, max_words=50)
    for _ in range(20):
        check(["".join(rng.choice("ab  \n\t▁éèx<>0A.,eethn\x00") for _ in range(rng.randint(0, 60)))
               for _ in range(100)], small)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t):
    check([t])


def test_ids_made_by_hand():
    data, sizes = ENC.model.decode(np.array([3 + 0xC3, 264, 1]), np.array([3]))
    assert texts_of(data, sizes).to_pylist() == ["� a"]
    with pytest.raises(ValueError):
        ENC.model.decode(np.array([32000]), np.array([1]))


def test_rows(docs, rows, empty):
    got = Counter((r["id"], tuple(r["ids"]), r["decoded"]) for r in encode_decode(docs, PATH, block_chars=2000).collect())
    exp = Counter((r[0], tuple(LIB.encode(r[1])) if r[1] else (), LIB.decode(LIB.encode(r[1])) if r[1] else "") for r in rows)
    assert got == exp
    assert encode_decode(empty, PATH).count() == 0
