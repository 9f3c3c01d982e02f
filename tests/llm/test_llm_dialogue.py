"""Conversation repair against a plain dynamic program and against all edits of short conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pandas as pd
import pytest

from conftest import DATA
from corpusloom.llm import dialogue
from corpusloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
PATTERN = re.compile("(s?(ua)+)?")


def cheapest(faults, initials):
    """(cost, audit, roles) by trying (cost, audit) prefixes per (row, initials so far that matter), without bounds."""
    # state: the output so far, shortened to what the pattern needs
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    table = {"": (0, "", ())}

    def put(into, state, value):
        if state not in into or value[:2] < into[state][:2]:
            into[state] = value

    def inserts(table):
        for _ in range(3):
            for state, (cost, audit, done) in list(table.items()):
                for role in "ua":
                    if (state, role) in step:
                        put(table, step[state, role], (cost + 2, audit + "I", (*done, ("I", role))))
        return table

    for fault, initial in zip(faults, initials, strict=True):
        after = {}
        for state, (cost, audit, done) in inserts(table).items():
            put(after, state, (cost + 3, audit + "D", (*done, ("D", ""))))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if (state, initial) in step:
                put(after, step[state, initial], (cost + extra, audit + "K", (*done, ("K", initial))))
            for role in "ua":
                if (state, role) in step:
                    put(after, step[state, role], (cost + 2 + extra, audit + "R", (*done, ("R", role))))
        table = after
    table = inserts(table)
    return min(table[s] for s in ("", "a") if s in table)


def brute(rows):
    """The contract, read plainly."""
    groups = {}
    for key, turn, role, text in rows:
        out = groups.setdefault(key, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    result = []
    for key, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            signs = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in own]
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, done = cheapest(faults, initials)
        lines, at = [], 0
        for letter, initial in done:
            name = {"u": "user", "a": "assistant"}.get(initial)
            if letter == "I":
                lines.append(f"{name}:")
                continue
            if letter != "D":
                lines.append(f"{own[at][1] if letter == 'K' else name}:{own[at][2]}")
            at += 1
        code = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        result.append((key, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, code))
    return sorted(result, key=repr)


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for key in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"))
            text = rng.choice(("Yes.", "Yes", "No!", "", " \t", None, "Why?  ", "x" * 50 + ".", f"text {rng.random()}.", f"text {rng.random()}."))
            at = rng.choice((turn, turn, turn, turn * 2, None)) if seed % 2 else turn
            rows += [(key, at, role, text)] * rng.choice((1, 1, 1, 1, 2))
    rng.shuffle(rows)
    return rows


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_search_equals_all_edits():
    """Short conversations, by every string of edits."""
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(0, 4)
        initials = [rng.choice("suax") for _ in range(n)]
        faults = [rng.choice(["", "", "truncated", "blank", "duplicate"]) for _ in range(n)]
        best = None
        for size in range(n + 4):
            for audit in itertools.product("DIKR", repeat=size):
                if sum(c != "I" for c in audit) != n:
                    continue
                for roles in itertools.product("ua", repeat=sum(c in "IR" for c in audit)):
                    out, cost, at, given = "", 0, 0, iter(roles)
                    for c in audit:
                        out += next(given) if c in "IR" else initials[at] if c == "K" else ""
                        cost += {"D": 3, "I": 2, "K": 0, "R": 2}[c]
                        if c != "I":
                            bad = faults[at] in ("blank", "duplicate") and c != "D"
                            cost += 1000 * bad + (faults[at] == "truncated" and c != "D")
                            at += 1
                    if PATTERN.fullmatch(out):
                        best = min(best or (cost, "".join(audit)), (cost, "".join(audit)))
        codes = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
        classes = bytes("suax".index(i) + 4 * codes[f] for i, f in zip(initials, faults, strict=True))
        assert dialogue.search(classes) == best == cheapest(faults, initials)[:2]


@pytest.mark.parametrize(("seed", "segment"), [(0, 2048), (1, 2048), (2, 3), (3, 2)])
def test_repairs_equal_brute_force(spark, seed, segment):
    rows = random_rows(seed, 60, 14)
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS seg", "'x' AS kind", "'x' AS audit")
    got = found(dialogue.repair_conversations(dialogue.damaged(table), segment, 1 << 20))
    assert got == brute(rows)


def test_one_conversation_with_most_rows(spark):
    rows = [*random_rows(4, 20, 6), *((None, t // 3, *r[2:]) for t, r in enumerate(random_rows(6, 300, 9)))]
    table = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert found(dialogue.repair_conversations(dialogue.damaged(table), 100, 2000)) == brute(rows)


def test_long_conversations_are_searched_in_linear_time():
    rng = random.Random(8)
    classes = bytes(rng.randrange(16) for _ in range(60_000))
    cost, audit = dialogue.search(classes)
    assert sum(c != "I" for c in audit) == len(classes) and cost > 0


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, 5, "user", None), (3, 2**40, "assistant", "a" * 3_000_000 + "."), (None, 1, "user", "Hm."), (None, 1, "user", "Hm."), (4, -3, "", ""), (4, 7, "system", "Be.")]
    assert found(dialogue.repair_conversations(dialogue.damaged(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)
    assert found(dialogue.repair_conversations(dialogue.damaged(spark.createDataFrame([], SCHEMA)))) == []


def test_given_conversations(spark):
    rows = pd.read_parquet(f"{DATA}/conversations.parquet")[["conv_id", "turn", "role", "text"]]
    want = brute([tuple(None if pd.isna(v) else v for v in r) for r in rows.itertuples(index=False)])
    assert found(QUERIES["op12_conversations"](spark, DATA)) == want
