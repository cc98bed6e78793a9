"""Conversation repair against all edits of short conversations and a plain dynamic programme over whole tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from quarryline.llm import queries, role_repair

DATA = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, part int, copies string, row_key long"


def all_edits(rows):
    best = None
    for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
        for choice in itertools.product("KUAD", repeat=len(rows)):
            roles, audit, cost, right = gaps[0], "I" * len(gaps[0]), 5 * sum(map(len, gaps)), True
            for (initial, must_go, broken), c, gap in zip(rows, choice, gaps[1:], strict=True):
                right &= c == "D" or not must_go
                right &= c != "K" or initial in ("s", "u", "a")
                roles += {"K": initial, "D": ""}.get(c, c.lower()) + gap
                audit += {"U": "R", "A": "R"}.get(c, c) + "I" * len(gap)
                cost += {"K": 0, "D": 2}.get(c, 1) + 5 * (broken and c != "D")
            if right and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def cheapest(rows):
    """(cost, audit), with whole audits held for each state."""

    def inserted(states):
        states = dict(states)
        for _ in range(3):
            for a, b in (("E", "O"), ("H", "O"), ("O", "W"), ("W", "O")):
                if a in states:
                    states[b] = min(states.get(b, (10**9, "")), (states[a][0] + 5, states[a][1] + "I"))
        return states

    states = {"E": (0, "")}
    for initial, must_go, broken in rows:
        options = defaultdict(list)
        for s, (cost, audit) in inserted(states).items():
            options[s].append((cost + 2, audit + "D"))
            if not must_go:
                if s == "E" and initial == "s":
                    options["H"].append((cost + 5 * broken, audit + "K"))
                to, fits = ("W", "a") if s == "O" else ("O", "u")
                options[to].append((cost + 5 * broken + (initial != fits), audit + ("K" if initial == fits else "R")))
        states = {s: min(o) for s, o in options.items()}
    states = inserted(states)
    return min(states[s] for s in "EW" if s in states)


def plainly(table):
    groups, out = defaultdict(list), []
    bare = lambda v: " " if v is None else v
    sha = lambda *parts: hashlib.sha256("\0".join(parts).encode()).hexdigest()
    part = lambda v: "-" if v is None else f"={v}"
    for conv, turn, role, text in table:
        kind = zlib.crc32(f"{bare(conv)}:{bare(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else bare(role), {1: "", 2: re.sub("[.!?]", "", bare(text))}.get(kind, bare(text))
        groups[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(sha(part(conv), r[1], r[2]), part(r[0]))))
        seen, faults = set(), []
        for _, role, text in rows:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = cheapest([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults, strict=True)])
        left, lines, turn = iter(zip(rows, strict=True)), [], 0
        for edit in audit:
            role, text = (None, "") if edit == "I" else next(left)[0][1:]
            if edit != "D":
                if edit == "K" and role[0] == "s":
                    lines.append(f"{role}:{text}")
                    continue
                lines.append(f"{role if edit == 'K' else ('user', 'assistant')[turn]}:{text}")
                turn = 1 - turn
        turns = [r[0] for r in rows if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_chart_against_all_edits():
    rng = random.Random(1)
    for _ in range(120):
        rows = [(rng.choice(["s", "u", "a", "x", ""]), go := rng.random() < 0.2, rng.random() < 0.3 and not go) for _ in range(rng.randint(0, 3))]
        cost, edits, tail = role_repair.repaired_roles(rows)
        assert (cost, ("".join(edits) + tail).translate(role_repair.INITIALS)) == all_edits(rows) == cheapest(rows)


def test_chart_against_programme():
    rng = random.Random(2)
    for _ in range(2000):
        rows = [(rng.choice("suaux"), go := rng.random() < 0.15, rng.random() < 0.3 and not go) for _ in range(rng.randint(0, 14))]
        cost, edits, tail = role_repair.repaired_roles(rows)
        assert (cost, ("".join(edits) + tail).translate(role_repair.INITIALS)) == cheapest(rows)


@pytest.fixture(scope="module")
def table():
    """A conversation of a third of all rows, null ids, turns, roles and texts, ties, repeats, a long text, odd roles."""
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        text = None if rng.random() < 0.05 else rng.choice(["", " a. ", " b", "c!", "d?", "e\n", "ж。"]) + rng.choice(["", str(i), f"{i}."])
        rows.append((1 if i % 3 == 0 else i // 4 + 10, rng.choice([None, *range(900)]), rng.choice(["user", "assistant", "system", None, "", "tool"]), text))
    rows += [(None, i, "user", "x.") for i in range(5)] + [(None, None, "user", "x.")] * 7 + [(2, 1, "user", "y. " * 200_000), (2, 2, "assistant", " \t\n")]
    return rows + rows[:40]


def test_whole_table(spark, table):
    clash = [(*r, 1, "clash", 2) for r in table]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, ("13", "false"), strict=True):  # so that conversations are parted between tasks
        spark.conf.set(k, v)
    try:
        got = sorted(map(tuple, role_repair.repair_digest(spark.createDataFrame(clash, SCHEMA).repartition(5)).collect()), key=repr)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plainly(table)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "a."), (1, 1, "assistant", "b."), (1, 2, "user", "c"), (2, 0, "system", "s."), (2, 1, "user", "u."), (3, 0, "user", " ")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies int")
    summary, repaired = role_repair.repair(frame)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in summary.collect()} == {1: (3, "RKD"), 2: (2, "RR"), 3: (2, "D")}
    assert [tuple(r)[2:] for r in repaired.orderBy("conv_id", "place").collect()] == [("user", "a.", "R"), ("assistant", "b.", "K"), ("user", "s.", "R"), ("assistant", "u.", "R")]


def test_given_table(spark):
    rows = list(map(tuple, spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    assert sorted(map(tuple, queries.op12_role_repair(spark, DATA).collect()), key=repr) == plainly(rows)


def test_empty(spark):
    assert role_repair.repair_digest(spark.createDataFrame([], SCHEMA)).collect() == []
