"""The exact distance join and the dendrogram."""
import itertools

import numpy as np
import pytest

from corpusmill.operators import vectors as V


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)


def clustered(n=400, width=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, width))
    x = centres[rng.integers(0, 12, n)] + 0.02 * rng.standard_normal((n, width))
    x[5] = x[6] = x[7]
    x[9] = x[10] + np.r_[0.25, np.zeros(width - 1)]      # exactly at a threshold
    return x


def brute(x, t):
    return {(i, j): d for i, j in itertools.combinations(range(len(x)), 2) if (d := float(np.sqrt(((x[i] - x[j]) ** 2).sum()))) <= t}


@pytest.mark.parametrize("t, block", [(0.15, 1024), (0.15, 16), (0.25, 64), (7.0, 64), (0.0, 64)])
def test_pairs_equal_brute_force(spark, t, block):
    x = clustered()
    got = {(r["a"], r["b"]): r["dist"] for r in V.epsilon_pairs(frame(spark, x), t, block=block).collect()}
    want = brute(x, t)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("cells", [1, 4, 64])
def test_every_close_pair_meets_whatever_the_cells(cells):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 16))
    for t in (0.5, 2.0, 4.0):
        home, near = V.visits(x, x[:cells], t)
        for i, j in brute(x, t):
            assert near[i, home[j]] and near[j, home[i]]


def test_few_candidates_at_a_near_duplicate_threshold():
    """Random unit vectors of 64 dimensions: at 0.1 a few per cent of all pairs meet, at 1.15 one cell is chosen."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((8192, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    cells = V.choose_cells(x[:4096], 10 ** 6, 0.1)
    home, near = V.visits(x, cells, 0.1)
    meet = float((near.sum(axis=0) * np.bincount(home, minlength=len(cells))).sum())
    assert len(cells) >= 256 and meet < 0.05 * len(x) * (len(x) - 1) / 2
    assert near.sum() < 40 * len(x)
    assert len(V.choose_cells(x[:4096], 10 ** 6, 1.15)) == 1


def test_small_inputs(spark):
    assert V.epsilon_pairs(frame(spark, np.zeros((0, 3))), 1.0).collect() == []
    assert V.epsilon_pairs(frame(spark, np.zeros((1, 3))), 1.0).collect() == []
    assert [tuple(r) for r in V.epsilon_pairs(frame(spark, np.ones((2, 3))), 0.5).collect()] == [(0, 1, 0.0)]


def kruskal(edges):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v
    out = []
    for d, a, b in sorted((d, a, b) for a, b, d in edges):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.append((a, b, d))
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_spanning_forest_and_cuts_equal_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    # ties in distance, several components, a long chain
    edges = {(int(min(p)), int(max(p))): float(rng.integers(1, 5)) for p in rng.integers(0, 60, (110, 2)) if p[0] != p[1]}
    edges |= {(i, i + 1): 2.0 for i in range(100, 130)}
    rows = [(a, b, d) for (a, b), d in edges.items()]
    df = spark.createDataFrame(rows, "a long, b long, dist double")
    forest = V.spanning_forest(df)
    got = sorted(map(tuple, forest.collect()))
    assert got == kruskal(rows)
    nodes = spark.range(0, 135).withColumnRenamed("id", "id")
    found = {(r["t"], r["id"]): r["cluster"] for r in V.cuts(nodes, forest, [1.0, 2.0, 4.0]).collect()}
    for t in (1.0, 2.0, 4.0):
        root = {v: v for v in range(135)}
        for _ in range(135):
            for a, b, d in rows:
                if d <= t:
                    root[a] = root[b] = min(root[a], root[b])
        assert all(found[t, v] == root[v] for v in range(135))


def test_forest_of_no_edges(spark):
    assert V.spanning_forest(spark.createDataFrame([], "a long, b long, dist double")).collect() == []


def test_four_byte_components_give_the_pairs_of_their_eight_byte_values(spark):
    x = clustered().astype(np.float32)
    large = frame(spark, x.astype(float))
    small = large.selectExpr("id", "cast(v as array<float>) v")
    a, b = (V.epsilon_pairs(d, 0.25, block=64) for d in (large, small))
    assert "array<float>" in [f.dataType.simpleString() for f in small.schema]
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_stored_components_are_shuffled_as_they_are(spark, tmp_path, monkeypatch):
    from corpusmill.plans import q_vectors as QV
    seen = []
    real = V.epsilon_pairs
    monkeypatch.setattr(V, "epsilon_pairs", lambda d, *a, **k: seen.append(d.schema["v"].dataType.simpleString()) or real(d, *a, **k))
    for kind in ("float", "double"):
        rows = spark.createDataFrame([(i, [float(i == j) for j in range(4)], 0) for i in range(4)], f"vec_id long, embedding array<{kind}>, label int")
        rows.write.parquet(f"{tmp_path}/{kind}/embeddings.parquet")
        assert QV.single_link(spark, f"{tmp_path}/{kind}").count() == 4
    assert seen == ["array<float>", "array<double>"]
