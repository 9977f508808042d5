"""Conversation repair against an exhaustive search."""
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from corpusmill.llm.turns import Repair, damage, every_conversation, repair, summaries

LEGAL = re.compile(r"(s?(ua)+)?")
SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       # names that the operator uses inside
                       T.StructField("conv", T.StringType()), T.StructField("copy", T.LongType()),
                       T.StructField("fault", T.StringType()), T.StructField("edit", T.StringType())])


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        ink = [c for c in text if c not in " \t\n\x0b\x0c\r"]
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else
                   "truncated" if ink[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def exhaustive(rows):
    """(cost, audit, lines): the least over all edits with up to two insertions at a place."""
    best = None
    f = faults(rows)
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    own = [[("D", None)] if f[i] in ("blank", "duplicate") else [("D", None), ("K", role), ("R", "user"), ("R", "assistant")]
           for i, (role, _) in enumerate(rows)]
    for picks in itertools.product(*own):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            roles, audit, lines, cost = "", "", [], 0
            for i in range(len(rows) + 1):
                for x in ins[i]:
                    name = {"u": "user", "a": "assistant"}[x]
                    roles, audit, cost = roles + x, audit + "I", cost + 3
                    lines.append(name + ":")
                if i < len(rows):
                    e, role = picks[i]
                    audit += e
                    cost += {"D": 4, "K": 0, "R": 3}[e] + (3 if f[i] == "truncated" and e != "D" else 0)
                    if role is not None:
                        roles += role[:1] or "-"
                        lines.append(f"{role}:{rows[i][1]}")
            if LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def searched(rows):
    r, edits = Repair(), []
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        edits += r.push((role, text, fault, 0))
    edits += r.finish()
    cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] + (3 if m and m[2] == "truncated" and e != "D" else 0)
               for e, _, _, m in edits)
    return cost, "".join(e for e, *_ in edits), [f"{role}:{text}" for _, role, text, _ in edits if role is not None]


def test_equals_exhaustive_search():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", "User", "useful", " "]
    for _ in range(400):
        rows = [(rng.choice(roles[:rng.choice((3, 8))]), rng.choice(["A.", "b", "", "C!", " \t", "d? ", "e\u0085"]))
                for _ in range(rng.randint(0, 3))]
        assert searched(rows) == exhaustive(rows), rows


def plain(rows):
    """All edits kept as whole strings: the search without tree, ranks or coalescence."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "")}

    def insert(b):
        for _ in range(2):
            for s, (c, e) in list(b.items()):
                t = (c + 3, e + "I")
                if step[s] not in b or t < b[step[s]]:
                    b[step[s]] = t
        return b
    for (role, _), fault in zip(rows, faults(rows), strict=True):
        new = {}
        for s, (c, e) in insert(dict(best)).items():
            ways = [(s, "D", 4)]
            if fault not in ("blank", "duplicate"):
                late = 3 if fault == "truncated" else 0
                ways.append((step[s], "R", 3 + late))
                if role[:1] == step[s] or (role[:1] == "s" and s == ""):
                    ways.append((role[:1], "K", late))
            for to, x, k in ways:
                if to not in new or (c + k, e + x) < new[to]:
                    new[to] = (c + k, e + x)
        best = new
    end = insert(dict(best))
    return min(end[s] for s in ("", "a") if s in end)


def test_long_conversations_equal_plain_search():
    rng = random.Random(8)
    for _ in range(60):
        roles = rng.choice([["user", "assistant"], ["system"], ["tool", "user"], ["user", "assistant", "system", "x"]])
        rows = [(rng.choice(roles), rng.choice(["A.", f"b{i}", f"C{i}!", " ", f"e{i}."])) for i in range(rng.randint(5, 90))]
        assert searched(rows)[:2] == plain(rows)


def test_memory_holds_unresolved_messages_only():
    r, out, most = Repair(), 0, 0
    for i in range(5000):
        out += len(r.push(("user" if i % 2 == 0 else "assistant", f"{i}.", None, i)))
        count, todo = 0, [r.root]
        while todo:
            n = todo.pop()
            count += 1
            todo += n.kids
        most = max(most, count)
    assert most < 12 and out > 4990
    r.finish()


def expected(rows):
    """The contract's result for (conv, turn, role, text) rows, by plain Python."""
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, [])
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else re.sub(r"[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        convs[c] += [(t, role, text)] * (2 if h == 3 else 1)
    out = {}
    for c, ms in convs.items():
        ms.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), m[2].encode()))
        pairs = [(r, x) for _, r, x in ms]
        f = faults(pairs)
        turns = {t for t, _, _ in ms if t is not None}
        cost, audit = plain(pairs) if ms else (0, "")
        lines = searched(pairs)[2] if ms else []
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, f.count("blank"), f.count("duplicate"),
                  f.count("truncated"), sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs)),
                  cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA).repartition(4)
    got = every_conversation(summaries(repair(damage(df))), df)
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.digest) for r in got.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_query_equals_plain_python(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), None]:
        for t in range(rng.randint(1, 14)):
            rows.append((c, rng.choice([t, t, t, t * 3, None]), rng.choice(["user", "assistant", "assistant", "system", None, "tool"]),
                         rng.choice(["Hello.", "hm", None, f"Long {t}!", "x" * 50_000 + ".", "ä\u0085", "same."])))
    rows += [rows[5], rows[5]]
    rows += [(777, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(3000)]
    dropped = next(c for c in range(10_000, 99_999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    got = run(spark, rows)
    assert got == expected(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_messages_are_returned(spark):
    rows = [(1, 5, "assistant", "first."), (1, 6, "assistant", "first."), (1, 7, "system", "s.")]
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)
    got = [(r.edit, r.new_role, r.new_text, r.fault) for r in repair(df).collect()]
    assert "".join(g[0] for g in got) == searched([r[2:] for r in rows])[1]
    assert LEGAL.fullmatch("".join(g[1][0] for g in got if g[1] is not None))
    assert [g for g in got if g[0] == "D"][0][3] in ("duplicate", None)


def test_empty_table(spark):
    assert run(spark, []) == {}
