import random

import pytest

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # names that the operators use inside
                     T.StructField("th", T.StringType()), T.StructField("_th", T.LongType()),
                     T.StructField("key", T.StringType()), T.StructField("n_words", T.LongType()),
                     T.StructField("id", T.StringType()), T.StructField("kept", T.BooleanType()),
                     T.StructField("size", T.LongType()), T.StructField("__r_doc_id", T.LongType())])


def words(rng, n):
    syl = ["ta", "re", "mo", "li", "ne", "Ka", "é", "su", "ö", "pi"]
    return [rng.choice(syl) + rng.choice(syl) + rng.choice(syl) for _ in range(n)]


def texts():
    """Random texts with copies, near copies, repeated lines, ties and oddities."""
    rng = random.Random(5)
    out = [None, "", " \n\t ", "one", "One two three four", "one two three four five"]
    for _ in range(14):
        out.append("\n".join(" ".join(words(rng, rng.randint(4, 30))) for _ in range(rng.randint(2, 12))))
    long = out[8].split(" ")
    near = list(long)
    near[len(near) // 2] = "changed"
    out += [out[7], out[7], out[8], " ".join(near), " ".join(words(rng, 30_000)), "ab " * 500,
            "x" * 3000, "\U0001F600 a\u2581b  c\x00\u0007 " + out[9], out[10] + "\n" + out[11]]
    return out


@pytest.fixture(scope="session")
def rows():
    t = texts()
    got = [(i, x, "en", f"s{i % 3}" if i % 7 else None, len(x or "")) for i, x in enumerate(t)]
    got += [got[8], got[8], (None, t[9], None, None, None), (12, "another text under one id", "en", "s0", 25)]
    return got


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "k", 2, "i", True, 3, 4) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
