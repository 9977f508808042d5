"""What each group of blocks keeps of its pairs, and how often a vector is shuffled."""
import numpy as np
import pytest

from pyspark.sql import functions as F

from corpusmill.operators import vectors as V
from tests.test_pairs import brute, clustered, frame, kruskal


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_least_forest_equals_kruskal(seed):
    rng = np.random.default_rng(seed)
    edges = sorted({(int(min(p)), int(max(p)), float(rng.integers(1, 4))) for p in rng.integers(0, 50, (120, 2)) if p[0] != p[1]})
    a, b, d = (np.array(x) for x in zip(*edges, strict=True))
    keep = V.least_forest(a, b, d)
    assert sorted(zip(a[keep].tolist(), b[keep].tolist(), d[keep].tolist(), strict=True)) == kruskal(edges)
    names = np.array([f"n{i:03d}" for i in range(50)], object)
    assert (V.least_forest(names[a], names[b], d) == keep).all()
    assert not len(V.least_forest(a[:0], b[:0], d[:0]))


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_kept_edges_have_the_forest_of_all_pairs(spark, monkeypatch, held):
    monkeypatch.setattr(V, "HELD", held)
    monkeypatch.setattr(V, "MEETING", 32)
    x = clustered()
    want = kruskal([(a, b, d) for (a, b), d in brute(x, 7.0).items()])
    kept = V.epsilon_pairs(frame(spark, x), 7.0, block=128, keeper=V.forest_only)
    got = kept.collect()
    assert len(got) < len(brute(x, 7.0)) / 4
    found = kruskal([(r["a"], r["b"], r["dist"]) for r in got])
    assert [e[:2] for e in found] == [e[:2] for e in want]


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 8))
    x[10:20] = x[0]                                             # ties
    u = x / np.linalg.norm(x, axis=1)[:, None]
    cos = np.round(1.0 - ((u[:, None] - u[None]) ** 2).sum(axis=2) / 2.0, 6)
    want = {i: sorted(((-c, j) for j, c in enumerate(cos[i].tolist()) if j != i and c >= 0.3))[:4] for i in range(len(x))}
    got: dict = {}
    for r in V.cosine_neighbours(frame(spark, x), 0.3, 4).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"], r["cos"]))
    for i, w in want.items():
        g = sorted(got.get(i, []))
        assert [o for _, o, _ in g] == [j for _, j in w]


def test_copies_of_a_vector_are_bounded(spark):
    x = np.random.default_rng(8).standard_normal((3000, 4))
    small, large = frame(spark, x), frame(spark, np.concatenate([x] * 8))
    from corpusmill.session import temporary_paths

    def blocks(df):
        V.epsilon_pairs(df, 100.0)                              # one cell: the sample finds nothing to leave out
        placed = spark.read.parquet(temporary_paths(spark)[-1])
        return placed.groupBy("cell").count().agg(F.max("count")).first()[0]
    n = blocks(large)
    assert n == 24000 and blocks(small) == 3000
    plan = V.epsilon_pairs(large, 100.0)._jdf.queryExecution().analyzed().toString()
    assert "1500" in plan and "1024" not in plan                # 16 blocks, not 24
