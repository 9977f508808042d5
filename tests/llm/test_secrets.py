import random
from collections import Counter

from corpusmill.llm.secrets import base_spans, find_secrets, infer, learn, log_likelihood, redact, scan, tokens


def random_keys(rng, n, alphabet, size, head=""):
    return [head + "".join(rng.choice(alphabet) for _ in range(size)) for _ in range(n)]


HEXES, UPPER = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
MIXED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_base_patterns():
    def kinds(t):
        return [(k, a, b) for k, a, b, _ in base_spans(t)]
    assert kinds('PassWord = "abcdefghijkl"') == [("assign", 0, 24)]
    assert kinds("api_key:abcdefghijk") == []                       # 11 characters
    assert kinds("token=short secret: 'abcdefghijkl'") == [("assign", 12, 33)]
    assert kinds("token: password: abcdefghijklmn") == []           # the first match takes the second's name
    assert kinds("AKIA" + "A" * 13) == [] and kinds("xAKIA" + "9" * 14) == [("access", 1, 19)]
    assert kinds("g0123456789abcdefz" + "a" * 15) == [("hex", 1, 17)]
    assert kinds("ſecret=abcdefghijkl") == []                  # only ASCII letters fold
    both = kinds("é secret=" + "a" * 16)
    assert both == [("assign", 2, 25), ("hex", 9, 25)]
    assert base_spans("")  == []


def test_tokens_leave_base_spans_alone():
    t = "secret=abcdefghijkl (plainwordtoken12) =abcdefghijklm."
    assert tokens(t, base_spans(t)) == [(21, "plainwordtoken12"), (40, "abcdefghijklm")]


def test_merging_generalises():
    rng = random.Random(1)
    keys = random_keys(rng, 300, HEXES, 40)
    states = infer(keys)
    assert len(states) < 10                                         # the prefix tree has thousands
    assert sum(q["end"] for q in states) == 300
    other = random_keys(rng, 50, HEXES, 40)
    words = random_keys(rng, 50, "etaoinshr", 40)
    assert min(log_likelihood(states, s) for s in other) > max(log_likelihood(states, s) for s in words)
    branches = infer(["ab" * 6] * 100 + ["99" * 6] * 100)
    assert log_likelihood(branches, "ab" * 6) > log_likelihood(branches, "a9" * 6)


def corpus(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 18))) for _ in range(4000)]
    rows, planted = [], set()
    for i in range(400):
        w = rng.sample(words, 40)
        if i % 2:
            w[5] = "token=" + random_keys(rng, 1, MIXED, 32)[0]
        if i % 5 == 0:
            w[20] = random_keys(rng, 1, MIXED, 32)[0]               # a credential that no pattern knows
            planted.add((i, w[20]))
        rows.append((i, " ".join(w)))
    rows += [(None, rows[1][1]), (1, rows[1][1]), (900, None), (901, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows, planted


def test_held_out_credentials_are_found(spark):
    df, rows, planted = corpus(spark)
    text = dict(rows)
    got = find_secrets(df, max_samples=200).collect()
    assert Counter(r["id"] for r in got) == Counter(i for i, _ in rows)
    found = {(r["id"], text[r["id"]][s["start"]:s["end"]]) for r in got for s in r["spans"] if s["kind"] == "grammar"}
    assert len(found & planted) >= 0.95 * len(planted)
    assert len(found - planted) <= 0.05 * len(planted)
    for r in got:
        exp = base_spans(text[r["id"]] or "") if r["id"] in text else None
        assert exp is None or [tuple(s) for s in r["base"]] == exp
        assert [s["start"] for s in r["spans"]] == sorted(s["start"] for s in r["spans"])


def test_background_is_every_other_token(spark):
    df, rows, planted = corpus(spark)
    rng = random.Random(3)
    rare = ["".join(rng.choice(UPPER[:26]) + rng.choice("ghijkl") + rng.choice("0123456789") for _ in range(8))
            for _ in range(12)]                                     # clean, and of one format
    df = df.union(spark.createDataFrame([(2000 + i, x) for i, x in enumerate(rare)], df.schema))
    every = {s for _, t in rows for _, s in tokens(t or "", base_spans(t or ""))} | set(rare)
    grammars = learn(scan(df), max_samples=50)
    assert sum(q["end"] for q in grammars.word) > 0.99 * (len(every) - len(planted))
    found = find_secrets(df.filter("doc_id >= 2000 or doc_id < 900"), max_samples=50).filter("id >= 2000").collect()
    assert len(found) == 12 and not any(r["spans"] for r in found)


def test_counts_stand_for_repeated_samples():
    assert infer(["ab" * 6, "99" * 6], counts=[100, 70]) == infer(["ab" * 6] * 100 + ["99" * 6] * 70)


def test_redact(spark, docs, empty):
    df, _, planted = corpus(spark)
    out = redact(df, max_samples=200).collect()
    assert not any("token=" in (r["text"] or "") and "token=[SECRET]" not in r["text"] for r in out)
    kept = redact(docs)
    assert kept.schema == docs.schema and kept.count() == docs.count()
    assert redact(empty).count() == 0 and find_secrets(empty).count() == 0
