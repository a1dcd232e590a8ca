"""Repairs against a search of all states with the strings themselves, and conversations that lie in many partitions."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n int, part int, key string, last string, kind string"


def cheapest(rows):
    """Dijkstra from the first row over (row, last initial, has a system row): cost, then labels, with the whole strings in the queue."""
    faults, seen = [], set()
    for role, text in rows:
        body = text.strip("\x20\t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return faults, cost, audit, [x for x in out]
        if (i, last, audit) in done:
            continue
        done.add((i, last, audit))
        may = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        names = {"u": "user", "a": "assistant"}
        if not audit.endswith("II"):
            for r in may.replace("s", ""):
                heapq.heappush(heap, (cost + 5, audit + "I", i, r, (*out, (names[r], ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
            if faults[i] in ("", "truncated"):
                more = 5 if faults[i] else 0
                if role[:1] and role[:1] in may:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, (role, text))))
                for r in may.replace("s", ""):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, r, (*out, (names[r], text))))


def brute(convs):
    out = {}
    for conv, rows in convs.items():
        faults, cost, audit, turns = cheapest([(r, t) for _, r, t in rows])
        known = [t for t, _, _ in rows if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows[:-1], rows[1:], strict=True))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha)
    return out


def conversations(rng, n, most=9):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "unit"]
    texts = ["Yes.", "No!", "Well", "", " \n", "Yes.", "a b c?", "é. \t", "𝒳"]
    return {c: [(t, rng.choice(roles), rng.choice(texts)) for t in sorted(rng.sample(range(20), rng.randint(1, most)))] for c in range(n)}


def frame(spark, convs):
    rows = [(c, t, r, x, 1, 2, "k", "l", "m") for c, some in convs.items() for t, r, x in some]
    return spark.createDataFrame(rows, SCHEMA)


def told(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_repairs_equal_a_search(spark, partitions):
    convs = conversations(random.Random(partitions), 150)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        summary, turns = repair.repair(frame(spark, convs))
        assert told(summary) == brute(convs)
        said = {}
        for r in turns.orderBy("conv_id", "seq").collect():
            said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        want = brute(convs)
        assert all(hashlib.sha256("\n".join(said.get(c, [])).encode()).hexdigest() == want[c][-1] for c in convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_conversation_in_many_partitions(spark):
    rng = random.Random(8)
    rows = [(t, rng.choice(["user", "assistant", "tool"]), rng.choice(["Yes.", "No", "", f"Text {t}."])) for t in range(400)]
    convs = {7: rows, 8: rows[:3], 6: rows[5:9]}
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    try:
        assert told(repair.repair(frame(spark, convs))[0]) == brute_by_paths(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def brute_by_paths(convs):
    """Cheapest strings by a table from the last row on, with the strings themselves."""
    out = {}
    for conv, rows in convs.items():
        seen, faults = set(), []
        for _, r, t in rows:
            faults.append("blank" if not t.strip() else "duplicate" if (r, t) in seen else "" if t.strip()[-1] in ".!?" else "truncated")
            seen.add((r, t))
        may = {"": "su", "s": "u", "u": "a", "a": "u"}
        best = {"": (0, ""), "a": (0, ""), "u": (5, "I"), "s": (10, "II")}
        for (_, role, _), fault in zip(reversed(rows), reversed(faults), strict=True):
            base = {}
            for g, to in may.items():
                some = [(best[g][0] + 2, "D" + best[g][1])]
                if fault in ("", "truncated"):
                    more = 5 if fault else 0
                    some += [(best[role[:1]][0] + more, "K" + best[role[:1]][1])] if role[:1] and role[:1] in to else []
                    some += [(best[x][0] + 1 + more, "R" + best[x][1]) for x in to if x != "s"]
                base[g] = min(some)
            for _ in range(2):
                again = best if _ else base
                best = {g: min(base[g], *[(again[x][0] + 5, "I" + again[x][1]) for x in to if x != "s"]) for g, to in may.items()}
        cost, audit = best[""]
        w, texts = repair._Writer(), iter([(r, t) for _, r, t in rows])
        for _ in w.whole(audit, texts):
            pass
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows[:-1], rows[1:], strict=True))
        turns = [t for t, _, _ in rows]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns), *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, w.digest.hexdigest())
    return out


def test_damage_is_as_stated(spark):
    rows = [(c, t, r, x) for c in range(60) for t, (r, x) in enumerate([("system", "Be. Good!"), ("user", None), (None, "So? it is."), ("assistant", "End.")])] + [(None, None, "user", "a.b")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k:
            want += [(c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, repair.damaged(df).collect()), key=key) == sorted(want, key=key)
    found = told(repair.repaired_damage(df))
    assert set(found) == {c for c, *_ in rows}


def test_odd_conversations(spark):
    convs = {None: [(None, "user", "Hi."), (None, "user", "Hi."), (2, "assistant", "Yo.")], 1: [(1, "", ""), (5, " ", " ")], 2: [(3, "system", "x.")]}
    got = told(repair.repair(frame(spark, convs))[0])
    assert got == brute(convs)
    assert got[None][:4] == (0, 0, 1, 0) and got[None][6] == "KDK" and got[2][6] == "D"
    assert repair.repair(frame(spark, {}))[0].count() == 0
    assert repair.repaired_damage(frame(spark, {})).count() == 0


def test_a_long_conversation_takes_linear_time():
    rows = [("uas"[k % 3], (k * 7) % 4) for k in range(40_000)]
    paths = repair.Paths(rows, repair.endings(), last=True)
    assert len(paths.audit(repair.START)[0].replace("I", "")) == len(rows)


def test_query_keeps_every_conversation(spark):
    from tests.oracle import DATA
    from tidewatch.llm.registry import QUERIES

    out = QUERIES["op12_conversation_repair"](spark, DATA)
    assert out.count() == spark.read.parquet(f"{DATA}/conversations.parquet").select(F.countDistinct("conv_id")).first()[0]
