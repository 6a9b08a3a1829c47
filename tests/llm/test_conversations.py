"""Repair of conversations against brute force over whole (cost, audit) pairs, in one task and in segments."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from signalfold.llm import conversations as C
from signalfold.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = "\t\n\x0b\x0c\r "


def best(kinds):
    """The least (cost, audit, roles) of legal results, by trying every edit of every state."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    states = {"": (0, "")}

    def inserts(states):
        for _ in range(4):
            for s, (c, audit) in list(states.items()):
                to = step[s][-1]
                states[to] = min(states.get(to, (1 << 30, "")), (c + 3, audit + "I"))
        return states

    for must_go, initial, cut in kinds:
        found = {}
        for s, (c, audit) in inserts(states).items():
            arcs = [(s, 4, "D")]
            if not must_go:
                if initial in tuple(step[s]):
                    arcs.append((initial, 3 * cut, "K"))
                arcs.append((step[s][-1], 3 + 3 * cut, "R"))
            for to, cost, letter in arcs:
                found[to] = min(found.get(to, (1 << 30, "")), (c + cost, audit + letter))
        states = found
    states = inserts(states)
    cost, audit = min(states[s] for s in ("", "a") if s in states)
    return cost, audit


def expected(rows):
    """rows: (turn, role, text) of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, kinds, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        tail = text.rstrip(SPACE)
        fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        kinds.append((fault in ("blank", "duplicate"), role[:1], fault == "truncated"))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = best(kinds)
    out, at = [], 0
    for letter in audit:
        last = out[-1][0][0] if out else ""
        name = "assistant" if last == "u" else "user"
        if letter == "K":
            out.append(rows[at][1:])
        elif letter == "R":
            out.append((name, rows[at][2]))
        elif letter == "I":
            out.append((name, ""))
        at += letter != "I"
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0][0] for r in out)) and at == len(rows)
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def rows_of(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["yes.", "no!", "so?\n", "cut", "", " \t", None, "ünï 日本.", " ", "tail. \x0b", "why"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "unit", "agent"]
    rows = []
    for c in range(conversations):
        conv = None if c == 3 else c
        n = rng.randint(0 if c else 1, most)
        for i in range(n):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[i % 2]
            rows.append((conv, None if rng.random() < 0.1 else i + rng.choice([0, 0, 0, 0, 1, -1, 5]), role, rng.choice(texts) if rng.random() < 0.5 else f"turn {i} of {c}."))
    return rows + rows[5:9] + [(7, 1, "user", "long " * 100_000 + ".")]


def columns(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.collect()}


@pytest.mark.parametrize("limits", [{}, {"long_rows": 6, "segment_rows": 2}, {"long_rows": 0, "segment_rows": 3}])
def test_repair_matches_brute_force(spark, limits):
    rows = rows_of(1, 60, 14)
    frame = spark.createDataFrame(rows, SCHEMA)
    clash = frame.withColumns({"gone": F.lit("x"), "key": F.lit(1), "end": F.lit("."), "cost": F.lit(2)})
    for f in (frame, clash.repartition(3)):
        got = C.Repairer(C.damage(f), gone="gone", **limits).repair()
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert columns(got) == {c: expected(own) for c, own in damaged(rows).items()}


def test_repair_of_one_conversation_over_many_tasks(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}." if i % 7 else "same.") for i in range(700)] + [(1, None, "user", "same.")] * 9 + [(2, 0, "user", "ok.")]
    got = C.Repairer(C.damage(spark.createDataFrame(rows, SCHEMA)), gone="gone", long_rows=100, segment_rows=32).repair()
    assert columns(got) == {c: expected(own) for c, own in damaged(rows).items()}


def test_repair_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.Repairer(empty).repair().count() == 0 and C.Repairer(C.damage(empty), gone="gone").repair().count() == 0
    named = spark.createDataFrame([("a", 1, "user", "x."), ("a", 2, "assistant", "y.")], "conv_id string, turn int, role string, text string")
    assert [(r.conv_id, r.audit, r.cost) for r in C.Repairer(named).repair().collect()] == [("a", "KK", 0)]
    away = [(c, t, "user", "x.") for c in range(400) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = columns(C.Repairer(C.damage(spark.createDataFrame(away, SCHEMA)), gone="gone").repair())
    assert len(got) == len(away) and set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_paths_match_brute_force_on_random_kinds():
    rng = random.Random(2)
    for _ in range(3000):
        kinds = [(rng.random() < 0.2, rng.choice("suaaux"), rng.random() < 0.3) for _ in range(rng.randint(0, 9))]
        text = "".join("-" if go else i.upper() if cut else i for go, i, cut in kinds)
        assert C.solve(text) == best(kinds)


def test_query_covers_each_conversation(spark):
    got = QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert columns(got) == {c: expected(own) for c, own in damaged(rows).items()}
