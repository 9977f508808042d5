"""Operator 4: secret scans with inferred grammars.

Base patterns find assignments, access keys and hex runs.  Their values are
labelled credentials: for each kind a probabilistic automaton is inferred by
state merging.  A prefix tree over character classes is folded from the root;
two states merge when the frequencies of ending and of every next class agree
within the Hoeffding bound, all the way down.  The other long tokens of the
corpus, all of them, train a background automaton in the same way.  Every remaining token is
scored by its log-likelihood ratio against the background, and
becomes a span of kind ``grammar`` when that exceeds the ratio of nearly all
(``quantile``) background tokens and ``min_ratio``.

Texts are scanned once into a written table of base matches and tokens; the
labelled sample is the ``max_samples`` distinct strings of least hash per kind
(a documented bound; two-round top-k, so no kind meets in one task) and one small
group per kind is inferred in a task.  The background has no such bound: its
distinct tokens are counted by class path (an automaton sees nothing else of a
token), and one task infers from the paths and their counts, which are far fewer
than the tokens.  Only automata and the threshold are collected.

Defined cases: null and empty texts have no spans; repeated rows are each
scanned; a kind with
fewer than ``min_samples`` has no automaton; without that many background tokens
or any base match no span is added; an empty table gives an empty result.
Positions are code points, ends are exclusive.  Only the named columns are read;
``redact`` returns all columns of its input.
"""

from __future__ import annotations

import json
import math
import re
import string
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ranking import top_k
from corpusmill.session import materialize

# The base patterns; letters of the first in either case.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")      # maximal runs: those of 18 and more
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
SPAN = "struct<kind:string,start:int,end:int,value:int>"


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value), by start and then kind."""
    out = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def tokens(text: str, spans) -> list[tuple[int, str]]:
    """(start, token) of the long tokens that touch no base span."""
    out, k = [], 0
    taken = sorted((s[1], s[2]) for s in spans)
    for m in TOKEN.finditer(text):
        core = m[0].strip("._-+/=")
        if len(core) < 12:
            continue
        a = m.start() + m[0].index(core)
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not any(x < a + len(core) and a < y for x, y in taken[k:k + 4]):
            out.append((a, core))
    return out


# ---- automata -------------------------------------------------------------

def _class(c: str) -> str:
    if c.isdigit():
        return "0"
    if "a" <= c <= "f":
        return "a"
    if "g" <= c <= "z":
        return "g"
    if "A" <= c <= "F":
        return "A"
    if "G" <= c <= "Z":
        return "G"
    return c


CLASS_SIZE = {"0": 10, "a": 6, "g": 20, "A": 6, "G": 20}


def class_path(s: Column) -> Column:
    """The classes of a token's characters; the path of a path is itself."""
    chars = string.digits + string.ascii_letters
    return F.translate(s, chars, "".join(map(_class, chars)))


def infer(samples: list[str], alpha: float = 0.05, counts: list[int] | None = None) -> list[dict]:
    """States ``{"n", "end", "next": {class: [state, count]}}`` merged from the
    prefix tree of the samples, each taken ``counts`` times."""
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    n, end, kids = [0], [0], [{}]
    for s, k in zip(samples, counts or [1] * len(samples), strict=True):
        at = 0
        n[0] += k
        for c in map(_class, s):
            if c not in kids[at]:
                kids[at][c] = [len(n), 0]
                n.append(0)
                end.append(0)
                kids.append({})
            kids[at][c][1] += k
            at = kids[at][c][0]
            n[at] += k
        end[at] += k

    def differ(f1, n1, f2, n2):
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a, b):
        todo, seen = [(a, b)], set()
        while todo:
            x, y = todo.pop()
            if x == y or (x, y) in seen or not n[x] or not n[y]:
                continue
            seen.add((x, y))
            if differ(end[x], n[x], end[y], n[y]):
                return False
            for c in {**kids[x], **kids[y]}:
                p, q = kids[x].get(c), kids[y].get(c)
                if differ(p[1] if p else 0, n[x], q[1] if q else 0, n[y]):
                    return False
                if p and q:
                    todo.append((p[0], q[0]))
        return True

    def fold(a, b):
        """Adds the tree below ``b`` to ``a``; below ``b`` it is still a tree."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n[x] += n[y]
            end[x] += end[y]
            for c, (t, k) in kids[y].items():
                if c in kids[x]:
                    kids[x][c][1] += k
                    todo.append((kids[x][c][0], t))
                else:
                    kids[x][c] = [t, k]

    red, done = [0], {0}
    while True:
        blue = next(((r, c) for r in red for c in sorted(kids[r]) if kids[r][c][0] not in done), None)
        if blue is None:
            break
        r, c = blue
        b = kids[r][c][0]
        into = next((x for x in red if compatible(x, b)), None)
        if into is None:
            red.append(b)
            done.add(b)
        else:
            kids[r][c][0] = into
            fold(into, b)
    number = {q: i for i, q in enumerate(red)}
    return [{"n": n[q], "end": end[q], "next": {c: [number[t], k] for c, (t, k) in kids[q].items()}} for q in red]


def log_likelihood(states: list[dict], s: str, unseen: float = 1e-4) -> float:
    """Natural log probability of ``s`` (an unseen step costs ``unseen`` and
    stays in its state)."""
    at, out = 0, 0.0
    for ch in s:
        c = _class(ch)
        q = states[at]
        step = q["next"].get(c)
        if step is None:
            out += math.log(unseen / CLASS_SIZE.get(c, 1))
        else:
            out += math.log(step[1] / (q["n"] + 1) / CLASS_SIZE.get(c, 1))
            at = step[0]
    q = states[at]
    return out + math.log(max(q["end"] / (q["n"] + 1), unseen))


class Grammars:
    """Automata by kind plus the background; scores tokens."""

    def __init__(self, automata: dict[str, list[dict]], word: list[dict] | None, threshold: float = math.inf):
        self.automata, self.word, self.threshold = automata, word, threshold

    def ratio(self, s: str) -> float:
        own = max(log_likelihood(a, s) for a in self.automata.values())
        return own - log_likelihood(self.word, s)

    def accepts(self, s: str) -> bool:
        return self.word is not None and bool(self.automata) and self.ratio(s) > self.threshold


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored: id, base spans with their values, other long tokens."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                bases, words = [], []
                for t in part.column(1).to_pylist():
                    spans = base_spans(t) if t else []
                    bases.append([{"kind": k, "start": a, "end": b, "value": v, "s": t[v:b]} for k, a, b, v in spans])
                    words.append([{"start": a, "s": s} for a, s in (tokens(t, spans) if t else [])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bases, base_type),
                                                  pa.array(words, word_type)], ["id", "base", "tokens"])

    import pyarrow as pa
    base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                    ("value", pa.int32()), ("s", pa.string())]))
    word_type = pa.list_(pa.struct([("start", pa.int32()), ("s", pa.string())]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(
        run, f"id {id_type}, base array<struct<kind:string,start:int,end:int,value:int,s:string>>, "
             "tokens array<struct<start:int,s:string>>"), "secret-scan")


def learn(scanned: DataFrame, max_samples: int = 400, min_samples: int = 20, alpha: float = 0.05,
          quantile: float = 0.999, min_ratio: float = 10.0) -> Grammars:
    """Automata from the ``max_samples`` strings of least hash of each kind that
    has ``min_samples``, and the background from all other tokens.

    The background is unlabelled, so it may hold credentials: tokens that a kind
    explains better than the background are left out and the background is
    inferred once more from the rest, whose ratios give the threshold."""
    strings = scanned.select(F.explode("base").alias("x")).select("x.kind", "x.s").distinct()
    order = [F.xxhash64("s"), F.col("s")]
    sample = top_k(strings, ["kind"], order, max_samples, ["s"])

    def one(pdf):
        import pandas as pd
        s = sorted(pdf["s"])
        return pd.DataFrame({"kind": [pdf["kind"].iloc[0]], "automaton": [json.dumps(infer(s, alpha))],
                             "n": [len(s)]})

    rows = sample.select("kind", "s").groupBy("kind") \
        .applyInPandas(one, "kind string, automaton string, n long").collect()
    automata = {r["kind"]: json.loads(r["automaton"]) for r in rows if r["n"] >= min_samples}
    paths = materialize(scanned.select(F.explode("tokens.s").alias("s")).distinct()
                        .groupBy(class_path(F.col("s")).alias("path")).agg(F.count(F.lit(1)).alias("n")),
                        "secret-paths")
    first = Grammars(automata, _background(paths, min_samples, alpha))
    if not automata or first.word is None:
        return first
    ordinary = materialize(_ratios(paths, first).filter("ratio <= 0").drop("ratio"), "ordinary-paths")
    second = Grammars(automata, _background(ordinary, 1, alpha))
    if second.word is not None:
        top = _ratios(ordinary, second).agg(F.percentile("ratio", quantile, F.col("n"))).first()[0]
        second.threshold = max(min_ratio, top)
    return second


def _background(paths: DataFrame, min_samples: int, alpha: float) -> list[dict] | None:
    """The automaton of all (path, n), or None below ``min_samples`` tokens."""
    def one(pdf):
        import pandas as pd
        pdf = pdf.sort_values("path")
        states = infer(pdf["path"].tolist(), alpha, pdf["n"].tolist())
        return pd.DataFrame({"n": [pdf["n"].sum()], "automaton": [json.dumps(states)]})

    rows = paths.groupBy().applyInPandas(one, "n long, automaton string").collect()
    return json.loads(rows[0]["automaton"]) if rows and rows[0]["n"] >= min_samples else None


def _ratios(paths: DataFrame, grammars: Grammars) -> DataFrame:
    def run(frames):
        for pdf in frames:
            yield pdf.assign(ratio=[grammars.ratio(p) for p in pdf["path"]])

    return paths.mapInPandas(run, "path string, n long, ratio double")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: id, base (spans of the patterns) and spans (all,
    with the kind ``grammar`` added), each sorted by start and kind."""
    scanned = scan(docs, id_col, text)
    grammars = learn(scanned, **options)
    added = _scored(scanned.select("id", "base", "tokens"), grammars)
    plain = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"),
                                                   x["end"].alias("end"), x["value"].alias("value")))
    return added.select("id", plain.alias("base"), F.array_sort(
        F.concat(plain, "more"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
        .otherwise(_place(a) - _place(b))).alias("spans"))


def _place(span):
    out = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        out = F.when(span["kind"] == k, F.lit(i)).otherwise(out)
    return out


def _scored(scanned: DataFrame, grammars: Grammars) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        accepts = lru_cache(100_000)(grammars.accepts)
        for batch in batches:
            more = [[{"kind": "grammar", "start": w["start"], "end": w["start"] + len(w["s"]), "value": w["start"]}
                     for w in ws if accepts(w["s"])] for ws in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(more, span_type)],
                                             ["id", "base", "more"])

    import pyarrow as pa
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                    ("value", pa.int32())]))
    base = scanned.schema["base"].dataType.simpleString()
    return scanned.mapInArrow(run, f"id {scanned.schema['id'].dataType.simpleString()}, base {base}, more array<{SPAN}>")


def redact(docs: DataFrame, id_col: str = "doc_id", text: str = "text", mask: str = "[SECRET]",
           **options) -> DataFrame:
    """The columns of ``docs`` with every secret's value replaced by ``mask``
    (``n_chars``, if present, follows)."""
    grammars = learn(scan(docs, id_col, text), **options)
    where = docs.columns.index(text)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    names = list(docs.columns)

    def masked(t, accepts):
        spans = base_spans(t)
        cut = sorted([(v, b) for _, _, b, v in spans] +
                     [(a, a + len(s)) for a, s in tokens(t, spans) if accepts(s)])
        out, at = [], 0
        for a, b in cut:
            if a >= at:
                out += [t[at:a], mask]
            at = max(at, b)
        return "".join(out) + t[at:] if cut else t

    def run(batches):
        import pyarrow as pa
        accepts = lru_cache(100_000)(grammars.accepts)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                cols = list(batch.slice(at, 500).columns)
                old = cols[where].to_pylist()
                new = [masked(t, accepts) if t else t for t in old]
                cols[where] = pa.array(new, cols[where].type)
                if chars is not None:
                    kept = cols[chars].to_pylist()
                    cols[chars] = pa.array([k if a == b else len(b) for k, a, b in zip(kept, old, new, strict=True)],
                                           cols[chars].type)
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)
