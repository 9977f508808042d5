"""Neighbours are counted once for both directions."""
import hashlib
from collections import Counter

import pytest

from corpusmill.plans import q_text as QT

TEXTS = {1: "a b a a c", 2: "a", 3: "", 4: None, 5: "a a a a", 6: "z y x y z b a", 7: "c b"}


def brute(window):
    got = Counter()
    for d, text in TEXTS.items():
        toks = (text or "").split()
        for i, target in enumerate(toks):
            w = window(d, i + 1)
            for j in range(max(0, i - w), min(len(toks), i + w + 1)):
                if j != i:
                    got[target, toks[j]] += 1
    return dict(got)


@pytest.mark.parametrize("name", ["context_pairs", "context_pairs_reduced"])
def test_pairs_equal_a_loop_and_one_row_is_shuffled_for_both(spark, tmp_path, name):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    windows = {"context_pairs": lambda d, i: 2,
               "context_pairs_reduced": lambda d, i: 1 + ord(hashlib.md5(f"7:{d}:{i}".encode()).hexdigest()[0]) % 2}
    out = {"context_pairs": QT.context_pairs, "context_pairs_reduced": QT.context_pairs_reduced}[name](spark, str(tmp_path))
    rows = out.collect()
    assert {(r["target"], r["context"]): r["n"] for r in rows} == brute(windows[name]) and len(rows) == len(brute(windows[name]))
    # a row is turned around after the shuffle
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Generate explode(") == 2
