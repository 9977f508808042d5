import math
import random

from corpusmill.functions.stem import porter
from corpusmill.operators import vectors as V


def test_porter_examples():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop",
             "relational": "relat", "generalizations": "gener", "adjustment": "adjust",
             "controll": "control", "happy": "happi", "filing": "file"}
    assert {w: porter(w) for w in pairs} == pairs


def test_epsilon_join_and_components_match_brute_force(spark):
    rnd = random.Random(9)
    pts = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    t = 1.0
    got = {(r["a"], r["b"]) for r in V.epsilon_pairs(df, t, block=16).collect()}
    expect = {(a, b) for a, va in pts for b, vb in pts
              if a < b and math.dist(va, vb) <= t}
    assert got == expect
    edges = spark.createDataFrame(sorted(expect), "a long, b long")
    comp = {r["id"]: r["cluster"] for r in V.connected_components(df.select("id"), edges).collect()}
    parent = {i: i for i, _ in pts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in expect:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    roots = {i: find(i) for i in parent}
    groups = {}
    for i, r in roots.items():
        groups.setdefault(r, []).append(i)
    for members in groups.values():
        assert {comp[m] for m in members} == {min(members)}


def test_long_json_export_chunks_hot_keys(spark, tmp_path):
    from corpusmill.sources import io
    rows = [("hot", d, 1.0) for d in range(250)] + [("cold", 1, 2.0)]
    df = spark.createDataFrame(rows, "term string, doc_id long, tf double")
    path = str(tmp_path / "j")
    io.write_long_json(df, path, "term", "doc_id", "tf", max_entries=100)
    lines = spark.read.text(path).count()
    assert lines == 4  # 251 rows: three chunks for each key, of which the cold one fills one
    back = io.read_long_json(spark, path, "term", "string", "doc_id", "bigint", "tf")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
