import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from corpusmill.llm.jaccard import _common, choose_bands, jaccard_classes, one_of_each


def shingle_set(t, n=5):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if x]
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else None


def brute(texts, threshold):
    """(class members as sets of row numbers, links and copies by row number)."""
    sets = [shingle_set(t) for t in texts]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        by[s if s else i].append(i)
    keys = [s for s in by if isinstance(s, frozenset)]
    links, near = Counter(), defaultdict(set)
    for a, b in combinations(keys, 2):
        if len(a & b) >= threshold * len(a | b) - 1e-9:
            links[a] += 1
            links[b] += 1
            near[a].add(b)
            near[b].add(a)
    out, seen = [None] * len(texts), set()
    for s in by:
        if s in seen:
            continue
        comp, todo = set(), [s]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp.add(x)
                todo += near.get(x, ())
        seen |= comp
        rows = sorted(i for x in comp for i in by[x])
        for x in comp:
            for i in by[x]:
                out[i] = (tuple(rows), links[x], len(by[x]) - 1)
    return out


def test_bands_reach_the_recall():
    for t, r in ((0.8, 0.999), (0.5, 0.9), (0.9, 0.99999)):
        rows, bands = choose_bands(t, r)
        assert rows * bands <= 64 and 1 - (1 - t ** rows) ** bands >= r
    with pytest.raises(ValueError):
        choose_bands(0.1, 0.9999, max_hashes=4)


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 80)) for _ in range(30)]
    exp = [[len(set(a) & set(b)) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = _common(sets, chunk=17)
    assert all(got[i][j] == exp[i][j] for i in range(30) for j in range(30) if i != j)


def near_copies(rng, n, edits):
    """One text and copies of it with word changes, as chains drift."""
    text = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(120)]
    out = []
    for _ in range(n):
        for _ in range(edits):
            text[rng.randrange(120)] = f"v{rng.randint(0, 10 ** 6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("block", [384, 7])
def test_equals_brute_force(spark, rows, block):
    rng = random.Random(4)
    texts = [r[1] for r in rows] + near_copies(rng, 60, 1) + near_copies(rng, 12, 3) + near_copies(rng, 5, 0)
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # a recall so near 1 that no link of this fixture is missed
    got = {r["id"]: r for r in jaccard_classes(df, recall=1 - 1e-9, max_hashes=256, block=block).collect()}
    for i, (members, links, copies) in enumerate(brute(texts, 0.8)):
        assert (got[i]["class_id"], got[i]["n_links"], got[i]["n_copies"]) == (members[0], links, copies)


def test_one_of_each(docs, rows, empty):
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    sets = {shingle_set(r[1]) for r in rows} - {None}
    plain = [r for r in rows if shingle_set(r[1]) is None]
    assert sum(got.values()) >= len(plain) + 1 and all(got[(r[0], r[1])] for r in plain)
    assert {shingle_set(t) for _, t in got} - {None} <= sets
    left = [shingle_set(t) for _, t in got if shingle_set(t)]
    assert all(len(a & b) < 0.8 * len(a | b) for a, b in combinations(left, 2))
    assert one_of_each(empty).count() == 0 and jaccard_classes(empty).count() == 0


def test_repeated_rows_and_shared_ids(docs, rows):
    got = Counter((r["id"], r["n_copies"]) for r in jaccard_classes(docs).collect())
    same = Counter(shingle_set(r[1]) for r in rows if shingle_set(r[1]))
    assert got == Counter((r[0], same[shingle_set(r[1])] - 1 if shingle_set(r[1]) else 0) for r in rows)
