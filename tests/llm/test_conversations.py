"""The cheapest repair against trying all edits, blocks against one fold, and odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from tagloom.llm import conversations as C

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
SPACE = " \t\n\x0b\x0c\r"
WELL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """(initial, fault) of sorted rows (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACE)
        fault = 1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append(fault)
    return out


def tried(rows):
    """Least (cost, audit, repaired lines) over all edits, with up to two insertions in each gap."""
    fault = faults(rows)
    gaps = ["", "u", "a", "ua", "au"]
    names = {"u": "user", "a": "assistant"}
    best = None
    choices = [["D"] if f in (1, 2) else ["K", "u", "a", "D"] for f in fault]
    for edits in itertools.product(*choices):
        for fill in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, initials, lines = 0, "", "", []
            for i in range(len(rows) + 1):
                for c in fill[i]:
                    cost, audit, initials = cost + 5, audit + "I", initials + c
                    lines.append(f"{names[c]}:")
                if i == len(rows):
                    break
                e, (_, role, text) = edits[i], rows[i]
                if e == "D":
                    cost, audit = cost + 2, audit + "D"
                    continue
                cost += 5 * (fault[i] == 3) + (e != "K")
                audit += "K" if e == "K" else "R"
                initials += role[0] if e == "K" else e
                lines.append(f"{role if e == 'K' else names[e]}:{text}")
            if WELL.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def random_rows(rng, most):
    n = rng.randint(0, most)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why?", "Well.  \n"]
    return sorted((rng.choice([None, 0, 1, 2, 3, 3]) or 0, rng.choice(["user", "assistant", "system", "tool", "u", " "]), rng.choice(texts)) for _ in range(n))


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame(rows, TURNS)


def test_cheapest_of_all_edits(table):
    rng = random.Random(5)
    cases = {i: rows for i in range(60) if (rows := random_rows(rng, 3))}
    found = {r["conv_id"]: r for r in C.repaired(table([(i, *row) for i, rows in cases.items() for row in rows])).collect()}
    for i, rows in cases.items():
        cost, audit, lines = tried(rows)
        assert (found[i]["cost"], found[i]["audit"]) == (cost, audit), rows
        assert [f"{x['role']}:{x['text']}" for x in found[i]["repaired"]] == lines
        fault = faults(rows)
        assert [found[i][k] for k in ("blank", "duplicate", "truncated")] == [fault.count(k) for k in (1, 2, 3)]


def test_blocks_change_nothing(table, monkeypatch):
    rng = random.Random(6)
    rows = [(i, *row) for i in range(40) for row in random_rows(rng, 14)]
    rows = [(i, k, r, f"{t} {rng.choice('xyz')}." if rng.random() < 0.5 else t) for k, (i, _, r, t) in enumerate(rows)]
    whole = sorted(C.repaired(table(rows)).collect(), key=lambda r: r["conv_id"])
    for size in (1, 2, 5):
        monkeypatch.setattr(C, "BLOCK", size)
        assert sorted(C.repaired(table(rows)).collect(), key=lambda r: r["conv_id"]) == whole


def test_a_long_conversation(table):
    rows = [(1, k, ("assistant", "user")[k % 2], f"Turn {k}.") for k in range(3000)]
    (r,) = C.repaired(table(rows)).collect()
    assert (r["cost"], r["audit"]) == (4, "D" + "K" * 2998 + "D") and len(r["repaired"]) == 2998 and r["gaps"] == 0


def test_odd_rows(table):
    rows = [(None, 1, "user", "Hi."), (None, None, None, None), (2, -(2**63), "user", "A."), (2, 2**63 - 1, "assistant", "B."), (3, None, "", "C."), (4, 5, "user", "x " * 100_000 + "."), (4, 9, "assistant", "Y.")]
    found = {r["conv_id"]: r for r in C.repaired(table(rows).selectExpr("*", "1 AS place", "2 AS fault", "3 AS block", "true AS gone")).collect()}
    assert (found[None]["blank"], found[None]["cost"], found[None]["audit"]) == (1, 4, "DD")
    assert found[2]["gaps"] is None and found[2]["audit"] == "KK"
    assert (found[3]["gaps"], found[3]["audit"], found[3]["repaired"]) == (0, "D", [])
    assert found[4]["gaps"] == 3 and found[4]["audit"] == "KK" and len(found[4]["repaired"][0]["text"]) == 200_001
    assert C.repaired(table([])).collect() == [] and C.damaged_and_repaired(table([])).collect() == []


def test_damage_then_repair(table):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), f"Text {t}. More!") for c in range(200) for t in range(rng.randint(1, 3))]
    found = {r["conv_id"]: r for r in C.damaged_and_repaired(table(rows)).collect()}
    assert set(found) == {r[0] for r in rows}
    dropped = 0
    for c in found:
        kept = []
        for conv, turn, role, text in rows:
            kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
            if conv == c and kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        cost, audit, lines = tried(sorted(kept))
        turns = sorted({k[0] for k in kept})
        dropped += not kept
        assert (found[c]["cost"], found[c]["audit"], found[c]["repaired_sha256"]) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        assert found[c]["gaps"] == (turns[-1] - turns[0] + 1 - len(turns) if turns else 0)
        assert found[c]["illegal"] == sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in itertools.pairwise(sorted(kept)))
    assert dropped
