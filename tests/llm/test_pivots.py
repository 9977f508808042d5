"""Pivot index: links and classes against a brute-force cosine."""
import numpy as np
import pytest
from pyspark.sql import types as T

from corpusmill.llm.pivots import choose_pivots, describe, near_vectors

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       # names that the operator uses inside
                       T.StructField("id", T.StringType()), T.StructField("key", T.LongType()),
                       T.StructField("list", T.StringType())])


def vectors(width=48, seed=4):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(width) for _ in range(120)]
    for base, n, noise in ((out[3], 60, 0.1), (out[7], 9, 0.22), (out[9], 6, 0.3)):
        out += [base + noise * rng.standard_normal(width) * np.linalg.norm(base) / np.sqrt(width) for _ in range(n)]
    out += [out[5], out[5], out[5] * 2, out[5] * 3, out[130], -out[3]]
    return out


def brute(rows, threshold):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    near = [set() for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                    near[i].add(j)
    comp = list(range(n))
    while True:
        new = [min([comp[i], *[comp[j] for j in near[i]]]) for i in range(n)]
        if new == comp:
            break
        comp = new
    least = {}
    for i, (vid, _) in enumerate(rows):
        if vid is not None:
            least[comp[i]] = min(least.get(comp[i], vid), vid)
    return sorted(((vid, len(near[i]), least.get(comp[i])) for i, (vid, _) in enumerate(rows)), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1, "y")
                                for i, v in rows], SCHEMA).repartition(3)
    return sorted(((r.id, r.n_links, r.component_id) for r in near_vectors(df, **options).collect()), key=str)


@pytest.mark.parametrize("block", [512, 8])
def test_equals_brute_force(spark, block):
    rows = list(enumerate(vectors()))
    odd = [None, [], [0.0] * 48, [float("nan")] * 48, [float("inf")] + [1.0] * 47, [None] + [1.0] * 47,
           [1.0, 2.0], [1.0, 2.1], [1e300] * 48, [1e-300] * 48, [-0.0, 1.0], [0.0, 1.0]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[6][1]), (None, [5.0, -1.0, 2.0])]
    assert run(spark, rows, pivots=64, near=8, shared=2, block=block) == brute(rows, 0.95)


def test_recall_at_the_threshold():
    """Pairs of a cosine between 0.95 and 0.955, with the registered parameters."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.standard_normal((4000, 64))
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = rng.uniform(0.95, 0.955, 4000)[:, None]
    b = cos * a + np.sqrt(1 - cos * cos) * side
    points = choose_pivots(list(rng.standard_normal((2000, 64))), 1024, 0.6)
    p, q = describe(a, points, 8), describe(b, points, 8)
    shared = np.array([len(set(x) & set(y)) for x, y in zip(p.tolist(), q.tolist(), strict=True)])
    print("recall", (shared >= 3).mean())
    assert (shared >= 3).mean() >= 0.9


def test_pivots_of_copies_and_none():
    one = np.ones(6)
    got = choose_pivots([one, one * 2, np.array([1.0, 0, 0, 0, 0, 0])], 4, 0.6)
    assert got.shape == (4, 6) and np.allclose(np.linalg.norm(got, axis=1), 1)
    assert np.allclose(got[0], one / np.sqrt(6)) and got[1][0] == 1
    assert choose_pivots([], 3, 0.6).shape == (3, 1)


def test_empty_and_unusable(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1), (2, 0, 2)]


def test_all_equal(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(700)]
    assert run(spark, rows) == sorted(((i, 699, 0) for i in range(700)), key=str)
