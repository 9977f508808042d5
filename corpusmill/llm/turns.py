"""Operator 12: conversation structure repair by survivor-coalescence Viterbi.

The messages of a conversation are read in order (turn, nulls first, then role and text).
A message is kept, gets another role or is deleted, and empty messages may be
inserted, so that the roles' initials read ``(s?(ua)+)?`` at the least cost; of
equal costs, the edits whose initials (D, I, K, R) are least in ASCII win.

The search has four states: nothing yet, or the last initial is s, u or a.  For
each message, each state keeps its best path (survivor) as a node of a
backpointer tree with reference counts.  Two survivors have consumed the same messages
and end with one, so neither's edits begin with the other's and their order, kept
as a rank, is that of their complete unresolved suffixes; a tie is settled by the
ranks of the paths it comes from, then by the new edits.  Nodes that no survivor
needs are released, survivors that can no longer win are dropped, and once all survivors share an ancestor the edits up to it
are emitted and forgotten.  Memory holds the unresolved messages only.

Messages are shuffled once, by conversation, and streamed through the search in
order; a conversation is never held as a whole.  It cannot be cut, though: its audit and
its digest are sequential over all of its messages, so one conversation is one stream.

Defined cases: a null role or text counts as one space, a null turn comes
first, a null conversation is one like others.  A role's initial is its first
character; an empty role has none, so it is never kept.  Repeated rows are
duplicates; messages of one turn are ordered by role, then text.  Texts of any length
are read whole.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import null_safe

# Fixed values of the contract.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
INK = r"[^\x20\x09-\x0D]"
UNFINISHED = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"

START, S, U, A = range(4)
NAMES = {U: "user", A: "assistant"}
NEXT = {START: (U,), S: (U,), U: (A,), A: (U,)}     # by rerole or insertion
ENDS = (START, A)


def _edits(initial: str, must_go: bool, truncated: bool) -> list[tuple]:
    """(from, to, edits, cost) of every way through one message: at most
    two insertions, then the edit of the message itself."""
    out = []
    late = TRUNCATED if truncated else 0
    for begin in (START, S, U, A):
        at, inserted = begin, ""
        for _ in range(3):
            cost = INSERT * len(inserted)
            out.append((begin, at, inserted + "D", cost + DELETE))
            if not must_go:
                to = {"s": S if at == START else None, "u": U if at != U else None, "a": A if at == U else None}.get(initial)
                if to is not None:
                    out.append((begin, to, inserted + "K", cost + KEEP + late))
                out.extend((begin, to, inserted + "R", cost + REROLE + late) for to in NEXT[at])
            at, inserted = NEXT[at][0], inserted + "I"
    return out


WAYS = {(i, g, t): _edits(i, g, t) for i in ("s", "u", "a", "") for g in (False, True) for t in (False, True)}
# What a path costs more at most that goes on from the first state and does what one from the second does: a
# survivor that is worse by more than that than another can no longer win.
MIMIC = {START: {S: 0, U: 3, A: 0}, S: {START: 6, U: 3, A: 6}, U: {START: 7, S: 3, A: 3}, A: {START: 4, S: 0, U: 3}}
CLOSE = [(b, "I" * k) for b, k in ((START, 0), (A, 0), (U, 1), (START, 2), (S, 2), (A, 2))]


class Node:
    __slots__ = ("parent", "state", "edits", "row", "kids", "live")

    def __init__(self, parent, state, edits, row):
        self.parent, self.state, self.edits, self.row = parent, state, edits, row
        self.kids: list[Node] = []
        self.live = True            # a survivor


class Repair:
    """One conversation: :meth:`push` takes the next message and returns the
    edits that it settles, :meth:`finish` the rest.  An edit is
    (initial, role, text, message), with the message None for an insertion."""

    def __init__(self):
        self.root = Node(None, START, "", None)
        self.best = {START: (0, 0, self.root)}      # state: cost, rank, node

    def push(self, row: tuple) -> list[tuple]:
        """``row`` is (role, text, fault, ...)."""
        role, fault = row[0], row[2]
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        found: dict[int, tuple] = {}
        for begin, to, edits, cost in WAYS[initial, fault in ("blank", "duplicate"), fault == "truncated"]:
            if begin in self.best:
                before, rank, _ = self.best[begin]
                key = (before + cost, rank, edits, begin)
                if to not in found or key < found[to]:
                    found[to] = key
        order = sorted((s for s in found if all(s == t or found[s][0] <= found[t][0] + MIMIC[t][s] for t in found)),
                       key=lambda s: found[s][1:3])
        old = [n for _, _, n in self.best.values()]
        best = {}
        for rank, state in enumerate(order):
            cost, _, edits, begin = found[state]
            parent = self.best[begin][2]
            node = Node(parent, state, edits, row)
            parent.kids.append(node)
            best[state] = (cost, rank, node)
        self.best = best
        for node in old:
            node.live = False
            self._release(node)
        out = []
        while len(self.root.kids) == 1 and not self.root.live:
            child = self.root.kids[0]
            out += self._named(self.root.state, child.edits, child.row)
            child.parent, self.root = None, child
        return out

    @staticmethod
    def _release(node):
        while not node.kids and not node.live and node.parent is not None:
            parent = node.parent
            parent.kids.remove(node)
            node.parent = None
            node = parent

    @staticmethod
    def _named(state: int, edits: str, row) -> list[tuple]:
        out = []
        for e in edits:
            if e == "D":
                out.append(("D", None, None, row))
                continue
            if e == "K":
                out.append(("K", row[0], row[1], row))
                continue                            # the last edit of its message
            state = NEXT[state][0]
            out.append((e, NAMES[state], "" if e == "I" else row[1], row if e == "R" else None))
        return out

    def finish(self) -> list[tuple]:
        _, _, added, state = min((self.best[b][0] + INSERT * len(i), self.best[b][1], i, b)
                                 for b, i in CLOSE if b in self.best)
        path = []
        node = self.best[state][2]
        while node is not self.root:
            path.append(node)
            node = node.parent
        out = []
        for node in reversed(path):
            out += self._named(node.parent.state, node.edits, node.row)
        return out + self._named(state, added, None)


EDITS = "edit string, new_role string, new_text string, role string, text string, fault string, turn long"


def messages(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """(conv, turn, role, text, fault) partitioned by conversation and in order."""
    space = F.lit(" ")
    got = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                      F.coalesce(F.col(role).cast("string"), space).alias("role"),
                      F.coalesce(F.col(text).cast("string"), space).alias("text")).repartition("conv")
    order = [F.asc_nulls_first("turn")]
    # md5 first, so that the long texts are compared in ties only
    copy = F.row_number().over(Window.partitionBy("conv", "role", F.md5("text"), "text").orderBy(*order))
    fault = F.when(~F.col("text").rlike(INK), "blank").when(copy > 1, "duplicate") \
        .when(F.col("text").rlike(UNFINISHED), "truncated")
    return got.withColumn("copy", copy).withColumn("fault", fault) \
        .sortWithinPartitions(F.asc_nulls_first("conv"), *order, "role", "text", "copy") \
        .select("conv", "turn", "role", "text", "fault")


def repair(rows: DataFrame, **columns) -> DataFrame:
    """One row per edit, in order and partitioned by conversation: conv, edit (K, R, D or I), new_role and
    new_text (null if deleted), and the message's role, text, fault and turn (null if inserted)."""
    src = messages(rows, **columns)
    kind = src.schema["conv"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        some, conv, engine = False, None, None
        out: list = []

        def batch_out():
            cols = list(zip(*out, strict=True)) or [[]] * 8
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kind_of[0]), *[pa.array(c, pa.string()) for c in cols[1:7]], pa.array(cols[7], pa.int64())],
                ["conv", "edit", "new_role", "new_text", "role", "text", "fault", "turn"])

        def add(edits):
            for e, new_role, new_text, m in edits:
                out.append((conv, e, new_role, new_text, *(m or (None, None, None, None))))
        for batch in batches:
            kind_of = [batch.schema.field(0).type]
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for c, turn, role, text, fault in zip(*[x.to_pylist() for x in part.columns], strict=True):
                    if not some or c != conv:
                        if some:
                            add(engine.finish())
                        some, conv, engine = True, c, Repair()
                    add(engine.push((role, text, fault, turn)))
                yield batch_out()
        if some:
            add(engine.finish())
            yield batch_out()
    return src.mapInArrow(run, f"conv {kind}, {EDITS}")


COSTS = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
LEGAL = ("su", "ua", "au")


def summaries(edits: DataFrame) -> DataFrame:
    """Per conversation with messages, from the output of :func:`repair`: gaps, blank, duplicate, truncated,
    illegal, cost, audit (the edits' initials) and digest (SHA-256 of the repaired ``role:text``
    lines).  Reads the edits as they come; only the initials of one conversation are held."""
    kind = edits.schema["conv"].dataType.simpleString()

    class Sum:
        def __init__(self):
            self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
            self.first = self.last = self.before = None
            self.turns = self.illegal = self.cost = self.lines = 0
            self.audit: list[str] = []
            self.sha = hashlib.sha256()

        def add(self, edit, new_role, new_text, role, fault, turn):
            self.audit.append(edit)
            self.cost += COSTS[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
            if new_role is not None:
                self.sha.update(f"{chr(10) if self.lines else ''}{new_role}:{new_text}".encode())
                self.lines += 1
            if role is not None:
                if self.before is not None:
                    self.illegal += (self.before + role[:1]) not in LEGAL
                self.before = role[:1]
                if fault is not None:
                    self.faults[fault] += 1
                if turn is not None:
                    self.turns += turn != self.last
                    self.first = turn if self.first is None else self.first
                    self.last = turn

        def row(self):
            gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
            return (gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())

    def run(batches):
        import pyarrow as pa
        some, conv, total = False, None, None
        out: list = []

        def batch_out():
            cols = list(zip(*out, strict=True)) or [[]] * 9
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kind_of[0]), *[pa.array(c, pa.int64()) for c in cols[1:7]],
                 *[pa.array(c, pa.string()) for c in cols[7:]]],
                ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest"])
        for batch in batches:
            kind_of = [batch.schema.field(0).type]
            for c, *rest in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if not some or c != conv:
                    if some:
                        out.append((conv, *total.row()))
                    some, conv, total = True, c, Sum()
                total.add(*rest)
            yield batch_out()
        if some:
            out.append((conv, *total.row()))
            yield batch_out()
    return edits.select("conv", "edit", "new_role", "new_text", "role", "fault", "turn").mapInArrow(
        run, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
             "audit string, digest string")


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Rows with faults by a hash of conversation and turn (nulls as one space): of 20 remainders, 0 drops
    the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes its role ``user``."""
    space = F.lit(" ")

    def named(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), space)
    got = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), named(role).alias("role"),
                      named(text).alias("text"),
                      (F.crc32(F.concat(named(conv), F.lit(":"), named(turn)).cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    return got.filter(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def every_conversation(found: DataFrame, rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``found`` with a row for each conversation of ``rows``; one without messages has zeros, no edits and the digest
    of an empty string."""
    ids = rows.select(F.col(conv).alias("conv")).distinct()
    empty = {"audit": "", "digest": hashlib.sha256(b"").hexdigest()}
    return null_safe(ids, found, ["conv"], "left").select(
        "conv", *[F.coalesce(F.col(c), F.lit(empty.get(c, 0))).alias(c) for c in found.columns if c != "conv"])
