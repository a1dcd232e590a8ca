"""Repair of conversations by weighted finite-state composition.

The rows of a conversation are a chain (the input acceptor). An edit transducer
keeps, reroles or deletes a row or inserts an empty one, at a cost; the grammar
acceptor takes the roles ``(s?(ua)+)?``. Their composition is never built: its
states (row, grammar state) are made as they are met, from the last row to the
first, which is a topological order. A weight is a cost and a string of edit
labels, compared in this order; strings grow to the left, where the order of
two stays that of what follows. Each layer ranks the strings of its states, so
that two of them are compared by label and rank and never by their length.

Rows are sorted by range, so a long conversation lies in several partitions.
One that lies within a partition is repaired there. Of others each partition
gives, for every pair of grammar states before and after its rows, the cheapest
string between them; these pieces are composed for each conversation, and the
rows then meet the edits that were chosen, in order and without being held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.store import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The grammar: where a role's initial leads from a state.
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state behind an inserted row, which is the one that the grammar asks for. Two in a row at most: with three, a state comes again.
INSERTED = (USER, USER, ASSISTANT, USER)
LEGAL = frozenset(("su", "ua", "au"))
ORDER = {"": 0, "D": 1, "I": 2, "K": 3, "R": 4}
NONE = (1 << 60, (9, 0))
SPACES = "\x20\t\n\x0b\x0c\r"
END = 2**31 - 1
OK, CUT_OFF, BLANK, DUPLICATE = range(4)


def edits(state: int, initial: str, fault: int) -> Iterator[tuple[int, str, int]]:
    """The arcs of the transducer composed with the grammar that read one row: (cost, label, state behind)."""
    yield DELETE, "D", state
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT_OFF else 0
    to = GRAMMAR[state]
    if initial in to:
        yield KEEP + more, "K", to[initial]
    for role in ("u", "a"):
        if role in to:
            yield REROLE + more, "R", to[role]


def _ranks(best: list[tuple[int, tuple[int, int]]]) -> list[int]:
    order = {k: n for n, k in enumerate(sorted({k for c, k in best if c < NONE[0]}))}
    return [order.get(k, 0) for _, k in best]


class Paths:
    """The cheapest way from each state before the rows to what ``after`` allows behind them.

    ``after`` has the costs of ending in each state (None: not allowed). Rows are inserted before each row, and behind the
    last only with ``last``, so that the strings of a piece never end with an insertion and join without ambiguity.
    """

    def __init__(self, rows: list[tuple[str, int]], after: list[int | None], last: bool):
        self.n, self.own, self.ins = len(rows), [], []
        base = [NONE if c is None else (c, (0, 0)) for c in after]
        self.own.append([("", g) for g in range(4)])
        best, ranks, ins = self._inserted(base, last)
        self.ins.append(ins)
        for initial, fault in reversed(rows):
            base, own = [], []
            for g in range(4):
                least, way = NONE, ("", g)
                for cost, label, to in edits(g, initial, fault):
                    if best[to][0] < NONE[0]:
                        w = (cost + best[to][0], (ORDER[label], ranks[to]))
                        if w < least:
                            least, way = w, (label, to)
                base.append(least)
                own.append(way)
            best, ranks, ins = self._inserted(base, True)
            self.own.append(own)
            self.ins.append(ins)
        self.costs = [None if c >= NONE[0] else c for c, _ in best]

    @staticmethod
    def _inserted(base: list, allowed: bool) -> tuple[list, list[int], list[int]]:
        """The best with up to two insertions before the layer, the ranks of their strings, and how many there are."""
        if not allowed:
            return base, _ranks(base), [0] * 4
        best, counts = base, [0] * 4
        for _ in range(2):
            ranks = _ranks(best)
            new, n = [], []
            for g in range(4):
                to = INSERTED[g]
                put = (INSERT + best[to][0], (ORDER["I"], ranks[to])) if best[to][0] < NONE[0] else NONE
                new.append(min(base[g], put))
                n.append(0 if base[g] <= put else 1 + counts[to])
            best, counts = new, n
        return best, _ranks(best), counts

    def audit(self, state: int) -> tuple[str, int]:
        """The labels of the cheapest way from a state, and the state behind it."""
        out = []
        for layer in range(self.n, -1, -1):
            for _ in range(self.ins[layer][state]):
                out.append("I")
                state = INSERTED[state]
            label, state = self.own[layer][state]
            out.append(label)
        return "".join(out), state


def endings() -> list[int | None]:
    return [0 if g in FINAL else None for g in range(4)]


@dataclass
class _Writer:
    """Applies labels to rows in order; the digest and the repaired turns follow."""

    state: int = START
    digest: object = field(default_factory=hashlib.sha256)
    n: int = 0

    def put(self, edit: str, role: str, text: str) -> tuple[int, str, str, str]:
        self.digest.update(("\n" if self.n else "").encode() + f"{role}:{text}".encode())
        self.n += 1
        return self.n - 1, edit, role, text

    def insert(self) -> tuple[int, str, str, str]:
        self.state = INSERTED[self.state]
        return self.put("I", ROLES[self.state], "")

    def row(self, label: str, role: str, text: str) -> tuple[int, str, str, str] | None:
        if label == "D":
            return None
        if label == "K":
            self.state = GRAMMAR[self.state][role[:1]]
            return self.put("K", role, text)
        self.state = INSERTED[self.state]  # the only role beside the system's that may follow
        return self.put("R", ROLES[self.state], text)

    def whole(self, audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[int, str, str, str]]:
        for label in audit:
            if label == "I":
                yield self.insert()
            elif (out := self.row(label, *next(rows))) is not None:
                yield out


@dataclass
class _Segment:
    """Rows of one conversation within a partition."""

    conv: object
    rows: list[tuple[str, int]] = field(default_factory=list)
    texts: list[tuple[str, str]] = field(default_factory=list)
    before: tuple | None = None

    def add(self, role: str, text: str, turn: object, later: bool, last: str) -> None:
        same = self.before == (turn, role, text)
        self.before = (turn, role, text)
        fault = BLANK if last == "" else DUPLICATE if later or same else OK if last in ".!?" else CUT_OFF
        self.rows.append((role[:1], fault))
        self.texts.append((role, text))

    def counts(self) -> list[int]:
        illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(self.rows[:-1], self.rows[1:], strict=True))
        return [sum(f == k for _, f in self.rows) for k in (BLANK, DUPLICATE, CUT_OFF)] + [illegal]


#: Rows of several kinds in one table: a whole repair, a repaired turn, a piece between two states, a row of a piece.
WHOLE, TURN, PIECE, ROW = range(4)
PARTS = (
    "kind int, part int, seq int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, sha string, edit string, role string, text string, "
    "before int, after int, first string, last string"
)
_COLUMNS = [c.split()[0] for c in PARTS.split(", ")]


class _Rows:
    """Collects rows of PARTS and gives them as batches."""

    def __init__(self, conv_type: pa.DataType):
        self.types = [conv_type] + [{"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[c.split()[1]] for c in PARTS.split(", ")]
        self.rows, self.size = [], 0

    def add(self, conv: object, **cells: object) -> None:
        self.rows.append((conv, *[cells.get(c) for c in _COLUMNS]))
        self.size += 100 + len(cells.get("text") or "") + len(cells.get("audit") or "")

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(self.types)
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, self.types, strict=True)], ["conv_id", *_COLUMNS])
        self.rows, self.size = [], 0
        return out


def _finished(out: _Rows, s: _Segment, turns: bool) -> None:
    paths, w = Paths(s.rows, endings(), last=True), _Writer()
    audit, _ = paths.audit(START)
    for seq, edit, role, text in w.whole(audit, iter(s.texts)):
        if turns:
            out.add(s.conv, kind=TURN, seq=seq, edit=edit, role=role, text=text)
    blank, duplicate, truncated, illegal = s.counts()
    out.add(s.conv, kind=WHOLE, blank=blank, duplicate=duplicate, truncated=truncated, illegal=illegal, cost=paths.costs[START], audit=audit, sha=w.digest.hexdigest())


def _opened(out: _Rows, s: _Segment, part: int) -> None:
    blank, duplicate, truncated, illegal = s.counts()
    said = {"blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "first": s.rows[0][0], "last": s.rows[-1][0]}
    for after in range(4):
        paths = Paths(s.rows, [0 if g == after else None for g in range(4)], last=False)
        for before in range(4):
            if paths.costs[before] is not None:
                out.add(s.conv, kind=PIECE, part=part, seq=len(s.rows), before=before, after=after, cost=paths.costs[before], audit=paths.audit(before)[0], **said)
    for seq, (role, text) in enumerate(s.texts):
        out.add(s.conv, kind=ROW, part=part, seq=seq, role=role, text=text)


def _repairing(turns: bool):
    """Over (conv_id, turn, role, text, later, last, part), sorted: the first and the last conversation of a partition may go on elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: _Rows | None = None
        now: _Segment | None = None
        first, part = True, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or _Rows(batch.schema.field(0).type)
            part = batch.column(6)[0].as_py()
            for conv, turn, role, text, later, last in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        if first:
                            _opened(out, now, part)
                        else:
                            _finished(out, now, turns)
                        first = False
                        if out.size > 1 << 20:
                            yield out.batch()
                    now = _Segment(conv)
                now.add(role, text, turn, later, last)
        if now is not None:
            _opened(out, now, part)
            yield out.batch()

    return run


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of conversations, sorted by conversation and part: the whole repair, and the chosen edits of each part (kind PIECE)."""
    out: _Rows | None = None
    now, pieces = None, []

    def done() -> None:
        parts = sorted({p["part"] for p in pieces})
        of = {k: [p for p in pieces if p["part"] == k] for k in parts}
        # behind the last row: what insertions lead to an end
        ways = [[(c, s.audit(g)[0], None)] if c is not None else [] for s in [Paths([], endings(), last=True)] for g, c in enumerate(s.costs)]
        chosen = [[w[0] if w else None for w in ways]]
        for k in reversed(parts):
            behind, layer = chosen[-1], []
            for g in range(4):
                some = [(p["cost"] + behind[p["after"]][0], p["audit"] + behind[p["after"]][1], p) for p in of[k] if p["before"] == g and behind[p["after"]] is not None]
                layer.append(min(some, key=lambda w: w[:2]) if some else None)
            chosen.append(layer)
        cost, audit, _ = chosen[-1][START]
        told = {c: sum(of[k][0][c] for k in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
        told["illegal"] += sum(of[a][0]["last"] + of[b][0]["first"] not in LEGAL for a, b in zip(parts[:-1], parts[1:], strict=True))
        out.add(now, kind=WHOLE, cost=cost, audit=audit, **told)
        state = START
        for k, layer in zip(parts, reversed(chosen[1:]), strict=True):
            p = layer[state][2]
            out.add(now, kind=PIECE, part=k, seq=-1, audit=p["audit"])
            state = p["after"]
        out.add(now, kind=PIECE, part=END, seq=-1, audit=chosen[0][state][1])

    for batch in batches:
        if not batch.num_rows:
            continue
        out = out or _Rows(batch.schema.field(0).type)
        for p in batch.to_pylist():
            if pieces and p["conv_id"] != now:
                done()
                pieces = []
                if out.size > 1 << 20:
                    yield out.batch()
            now = p["conv_id"]
            pieces.append(p)
    if pieces:
        done()
        yield out.batch()


def _applied(turns: bool):
    """Edits and rows of conversations, sorted by conversation, part and place: digests, and the repaired turns. Nothing but a part's labels is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: _Rows | None = None
        now, w, audit, at = None, None, "", 0

        def put(turn: tuple | None) -> None:
            if turn is not None and turns:
                out.add(now, kind=TURN, seq=turn[0], edit=turn[1], role=turn[2], text=turn[3])

        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or _Rows(batch.schema.field(0).type)
            for conv, part, seq, labels, role, text in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if w is None or conv != now:
                    now, w = conv, _Writer()
                if seq < 0:
                    audit, at = labels, 0
                    if part == END:
                        for _ in audit:
                            put(w.insert())
                        out.add(now, kind=WHOLE, sha=w.digest.hexdigest())
                        w = None
                else:
                    while audit[at] == "I":
                        put(w.insert())
                        at += 1
                    put(w.row(audit[at], role, text))
                    at += 1
            if out.size > 1 << 20:
                yield out.batch()
        if out is not None:
            yield out.batch()

    return run


def repair(rows: DataFrame, turns: bool = True) -> tuple[DataFrame, DataFrame]:
    """The repair of each conversation of ``rows`` (conv_id, turn, role, text), and its repaired turns.

    The first has conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256; the second conv_id, seq,
    edit, role and text (no rows without ``turns``). Rows stand by turn, nulls first, and equal turns by a digest of role and
    text, so equal rows are adjacent; a null role or text is one space, a null conversation is one like others. An empty table
    gives no rows; other columns are ignored. Texts and conversations may be of any length: a task holds no more than its
    partition, and of a conversation in several partitions its labels.
    """
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    base = written(clean.withColumn("key", key).withColumn("last", F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))), "repair-rows")
    at = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn"))
    again = base.filter("last <> ''").groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("at")).filter("n > 1")
    joined = base.join(again, base["conv_id"].eqNullSafe(F.col("c")) & (base["key"] == F.col("k")), "left")
    faults = joined.select("conv_id", "turn", "role", "text", F.coalesce(at > F.col("at"), F.lit(False)).alias("later"), "last", "key")
    faults = written(faults, "repair-faults")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("key")]
    ranged = faults.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "later", "last", F.spark_partition_id().alias("part"))
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    parts = written(ranged.mapInArrow(_repairing(turns), f"{conv}, {PARTS}"), "repair-parts")

    by_conv = lambda df, *then: df.repartition("conv_id").sortWithinPartitions("conv_id", *then)
    pieces = by_conv(parts.filter(F.col("kind") == PIECE), "part")
    composed = written(pieces.mapInArrow(_composed, f"{conv}, {PARTS}"), "repair-composed")
    step = ["conv_id", "part", "seq", "audit", "role", "text"]
    stream = composed.filter(F.col("kind") == PIECE).select(*step).union(parts.filter(F.col("kind") == ROW).select(*step))
    applied = written(by_conv(stream, "part", "seq").mapInArrow(_applied(turns), f"{conv}, {PARTS}"), "repair-applied")

    whole = lambda df: df.filter(F.col("kind") == WHOLE)
    digests = whole(applied).select(F.col("conv_id").alias("c"), F.col("sha").alias("digest"))
    across = whole(composed).join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("sha", F.col("digest"))
    said = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256")]
    told = whole(parts).select(*said).union(across.select(*said))
    gaps = base.groupBy(F.col("conv_id").alias("c")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    summary = told.join(gaps, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "gaps", *said[1:-1], "repaired_sha256")
    repaired = parts.filter(F.col("kind") == TURN).union(applied.filter(F.col("kind") == TURN)).select("conv_id", "seq", "edit", "role", "text")
    return summary, repaired


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with a known fault at one place in four: a hash of conversation and turn drops, empties, cuts off, repeats or misattributes a row."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    hurt = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    body = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return hurt.select("conv_id", "turn", role.alias("role"), body.alias("text"), copies.alias("_copy")).drop("_copy")


def repaired_damage(conversations: DataFrame) -> DataFrame:
    """The repair of every conversation after ``damaged``; one without rows then has zeros, no edits and the digest of an empty text."""
    found, _ = repair(damaged(conversations), turns=False)
    every = conversations.select(F.col("conv_id").alias("_c")).distinct()
    joined = every.join(found, F.col("_c").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(
        F.col("_c").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
