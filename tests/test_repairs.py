"""Hand-made cases of the split repair, the stemmed index, literal lines, the
global rank and the components."""

import math
import random

import pytest
from pyspark.sql import functions as F


def test_repair_moves_only_single_label_documents(spark):
    """Eight training documents carry another label too, so validation is filled
    from the six single-label test documents."""
    from corpusmill.operators.models import repair_splits
    rows = [(d, x) for d in range(8) for x in ("L", "M")] + [(d, "L") for d in range(8, 15)]
    split = [(d, "train") for d in range(8)] + [(8, "validation")] + [(d, "test") for d in range(9, 15)]
    got = repair_splits(spark.createDataFrame(rows, "doc_id long, label string"),
                        spark.createDataFrame(split, "doc_id long, split string")).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(8, 15))
    moved = [r for r in got if r["split"] != r["new_split"]]
    assert [(r["split"], r["new_split"]) for r in moved] == [("test", "validation")] * 2


MINIMA = {"train": 0.3, "validation": 0.15, "test": 0.15}


def shares(rows, assign):
    """{(label, split): (have, least)} of the labels with three documents or more."""
    out = {}
    for label in {x for _, x in rows}:
        docs = [d for d, x in rows if x == label]
        if len(docs) >= 3:
            for s, share in MINIMA.items():
                least = next(c for c in range(len(docs) + 1) if c / len(docs) >= share)
                out[label, s] = (sum(assign[d] == s for d in docs), least)
    return out


def helpful_moves(rows, assign):
    """All single moves that lessen what is missing and push no label below a minimum."""
    now = shares(rows, assign)
    out = []
    for d, s in assign.items():
        mine = [x for e, x in rows if e == d and (x, s) in now]
        if all(now[x, s][0] > now[x, s][1] for x in mine):
            out += [(d, t) for t in MINIMA if t != s and any(now[x, t][0] < now[x, t][1] for x in mine)]
    return out


@pytest.mark.parametrize("weights", [(0.9, 0.05, 0.05), (0.05, 0.05, 0.9), (0.1, 0.8, 0.1)])
def test_multilabel_repair_leaves_no_helpful_move(spark, weights):
    from corpusmill.operators.models import repair_splits_multilabel
    rnd = random.Random(str(weights))
    rows, assign = [], {}
    for d in range(300):
        rows += [(d, f"s{i}") for i in rnd.sample(range(14), rnd.choice([1, 2, 2, 3]))]
        assign[d] = rnd.choices(["train", "validation", "test"], weights=weights)[0]
    rows += [(0, "rare"), (1, "rare")]                      # too small to be checked
    moves, left = repair_splits_multilabel(
        spark.createDataFrame(rows + rows[:9], "doc_id long, label string"),
        spark.createDataFrame(list(assign.items()), "doc_id long, split string"), seed=2)
    new = dict(assign)
    for r in moves.collect():
        assert assign[r["doc_id"]] == r["old_split"] != r["split"]
        new[r["doc_id"]] = r["split"]
    before, after = shares(rows, assign), shares(rows, new)
    assert helpful_moves(rows, assign) and not helpful_moves(rows, new)
    assert all(after[k][0] >= min(before[k]) for k in before)
    assert {(r["label"], r["split"], r["have"], r["least"]) for r in left.collect()} == \
        {(*k, *v) for k, v in after.items() if v[0] < v[1]}


def test_multilabel_repair_out_of_test(spark):
    """A label without a spare training document is repaired out of the test documents."""
    from corpusmill.operators.models import repair_splits_multilabel
    rows = [(d, "L") for d in range(10)]
    split = [(d, "train" if d < 3 else "test") for d in range(10)]
    moves, left = repair_splits_multilabel(spark.createDataFrame(rows, "doc_id long, label string"),
                                           spark.createDataFrame(split, "doc_id long, split string"))
    got = [(r["old_split"], r["split"]) for r in moves.collect()]
    assert got == [("test", "validation")] * math.ceil(0.15 * 10) and left.count() == 0


def test_stemmed_index(spark):
    from corpusmill.functions.stem import stemmed_postings
    df = spark.createDataFrame([(1, "Using 12 connections, connected 5 the us."), (2, ""), (3, "as")],
                               "doc_id long, text string")
    got = {(r["term"], r["doc_id"]): r["tf"] for r in stemmed_postings(df).collect()}
    assert got == {("number_inidicator", 1): 2, ("connect", 1): 2, ("number_inidicator connect", 1): 1,
                   ("connect connect", 1): 1, ("connect number_inidicator", 1): 1}


def test_literal_lines(spark, tmp_path):
    from corpusmill.sources import io
    lines = [r"(u'US1', u'caf\xe9 \u20ac\n\'q\' \\x41 \x41\x42')", r"""('US2', "it's \"so\" \t.")""", "('US3', '')",
             "not a pair", "('US4', 'bad \\q escape')"]
    (tmp_path / "l.txt").write_text("\n".join(lines))
    got = {r["doc_id"]: r["text"] for r in io.read_tuple_text(spark, str(tmp_path / "l.txt")).collect()}
    assert got == {"US1": "caf\xe9 \u20ac\n'q' \\x41 AB", "US2": "it's \"so\" \t.", "US3": ""}
    left = [r["value"] for r in io.tuple_text_rejects(spark, str(tmp_path / "l.txt")).collect()]
    assert left == [lines[3], lines[4]]


def test_global_rank_with_other_columns(spark):
    from corpusmill.operators.select import global_rank
    df = spark.range(0, 60_000, 1, 40).select(F.hash("id").alias("k"), "id", F.repeat(F.lit("x"), 50).alias("payload"))
    got = global_rank(df, [F.asc("k"), F.asc("id")], "r", start=0)
    assert got.agg(F.countDistinct("r"), F.min("r"), F.max("r")).first() == (60_000, 0, 59_999)
    first = [r["id"] for r in got.orderBy("r").limit(50).collect()]
    assert first == [r["id"] for r in df.orderBy("k", "id").limit(50).collect()]


def test_a_long_chain_is_one_component(spark):
    from corpusmill.operators.components import connected_components
    edges = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    more = spark.createDataFrame([(5000, 5001), (5001, 5000), (6000, 6000), (None, 1)], "a long, b long")
    got = connected_components(edges.unionByName(more)).groupBy("root").count().collect()
    assert {r["root"]: r["count"] for r in got} == {0: 1001, 5000: 2}
