import re
from collections import Counter, defaultdict

from corpusmill.llm.quality import apply_quality, quality

SPACE = r"[\x20\x09-\x0D]+"


def split(t):
    return [w for w in re.split(SPACE, t or "") if w]


def base(t):
    t = t or ""
    w = split(t)
    win = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if win[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if split(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


def normal(x):
    return re.sub("[0-9]+", "0", re.sub(SPACE, " ", x).strip().lower())


def own(i):
    """Sixty words that no other text has, without digits."""
    return " ".join(chr(97 + i) + chr(97 + j % 26) + chr(97 + j // 26) for j in range(60))


def frequent(rows, min_docs, share):
    seen, hosts = defaultdict(set), defaultdict(set)
    for r in rows:
        hosts[r[3]].add(r[1] or "")
        for x in (r[1] or "").split("\n"):
            if split(x):
                seen[r[3], normal(x)].add(r[1])
    return {k for k, v in seen.items() if len(v) > min_docs and len(v) > len(hosts[k[0]]) * share}


def test_base_and_verdict(spark, docs, rows):
    more = rows + [(100 + i, "Shared  line 7\n" + own(i), "en", "s1", 0) for i in range(6)]
    more += [(200 + i, f"shared line {i}\nshared line 1\nfew", "en", "s1", 0) for i in range(3)]
    df = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")
    cut = frequent(more, 4, 0.2)
    assert cut == {("s1", "shared line 0")}
    got = Counter((r["id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                   r["base_failed"], r["n_cut"], r["kept"])
                  for r in quality(df, min_docs=4, max_share=0.2).collect())
    exp = Counter()
    for r in more:
        b = base(r[1])
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        lost = sum(len(split(x)) for x in (r[1] or "").split("\n") if split(x) and (r[3], normal(x)) in cut)
        exp[(r[0], *b, failed, lost, not failed and b[0] - lost >= b[0] * 0.5)] += 1
    assert got == exp


def test_apply_cuts_lines_and_keeps_columns(spark, docs, empty):
    assert apply_quality(docs).columns == docs.columns
    assert apply_quality(empty).count() == 0
    body = [own(i) for i in range(5)]
    rows = [(i, f"Menu {i}\n{b}", "s", 9) for i, b in enumerate(body)] + [(9, body[0], "s", 9), (9, body[0], "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = sorted(tuple(r) for r in apply_quality(df, min_docs=3, max_share=0.5).collect())
    assert got == sorted([(i, b, "s", len(b)) for i, b in enumerate(body)] + [(9, body[0], "s", 9)] * 2)
