import random
import re
from collections import Counter

from corpusmill.llm.decontaminate import decontaminate, drop_contaminated


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute(texts, items, span=10):
    win = {}
    for i, t in items:
        w = words(t)
        n = min(span, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            win.setdefault(tuple(w[s:s + n]), set()).add(str(i))
    sizes = {len(k) for k in win}
    out = []
    for d, t in texts:
        w, hit, its = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (got := win.get(tuple(w[s:s + n]))):
                    hit |= set(range(s, s + n))
                    its |= got
        out.append((d, len(w), len(hit), tuple(sorted(its))))
    return out


def run(spark, docs, items):
    it = spark.createDataFrame(items, "item_id long, text string, th string")
    got = decontaminate(docs, it).collect()
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in got)
    return Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got)


def test_equals_brute_force(spark, docs, rows):
    long = words(rows[9][1])
    items = [(1, " ".join(long[5:25])), (2, " ".join(long[5:25])), (3, "ONE, two!"), (4, None), (5, "...."),
             (6, " ".join(words(rows[13][1])[:9])), (7, "ab " * 12), (8, rows[18][1])]
    got = run(spark, docs, [(*i, "x") for i in items])
    assert got == Counter(brute([(r[0], r[1]) for r in rows], items))


def test_every_shared_window_is_found(spark):
    """Shared runs of exactly the window length, in random surroundings."""
    rng = random.Random(1)

    def w(n):
        return [f"w{rng.randint(0, 40)}" for _ in range(n)]
    items = [(i, " ".join(w(rng.randint(8, 30)))) for i in range(20)]
    docs = []
    for d in range(60):
        own = items[rng.randrange(20)][1].split()
        at = rng.randint(0, max(0, len(own) - 10))
        docs.append((d, " ".join(w(rng.randint(0, 30)) + own[at:at + 10] + w(rng.randint(0, 30)))))
    got = run(spark, spark.createDataFrame(docs, "doc_id long, text string"), [(*i, "x") for i in items])
    assert got == Counter(brute(docs, items))


def test_empty_tables(spark, docs, empty):
    assert run(spark, empty, [(1, "a b c", "x")]) == Counter()
    none = run(spark, docs, [])
    assert none and all(k[2] == 0 for k in none)


def test_drop_keeps_columns_and_clean_documents(spark, docs, rows):
    items = spark.createDataFrame([(1, " ".join(words(rows[9][1])[:12]))], "item_id long, text string")
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns
    dirty = {r[1] for r in brute([(r[1], r[1]) for r in rows], [(1, " ".join(words(rows[9][1])[:12]))]) if r[2]}
    bad = [r for r in rows if brute([(0, r[1])], [(1, " ".join(words(rows[9][1])[:12]))])[0][2]]
    assert len(bad) >= 2 and dirty is not None
    assert left.count() == len(rows) - len(bad)
