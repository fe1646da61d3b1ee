import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwell.llm import queries, turn_repair
from tests.llm.helpers import clashing
from tests.oracle import assert_same

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?\Z")
WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Cost, audit and repaired rows of (role, text, fault) rows by trying all edits, insertions up to two at each place."""
    best = None
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            for roles in itertools.product(("user", "assistant"), repeat=edits.count("R") + sum(inserts)):
                take, cost, audit, out = iter(roles), 0, "", []
                for i, row in enumerate([*rows, None]):
                    for _ in range(inserts[i]):
                        out.append((next(take), ""))
                        cost, audit = cost + 2, audit + "I"
                    if row is None:
                        break
                    role, text, fault = row
                    edit = edits[i]
                    audit += edit
                    if edit == "D":
                        cost += 3
                        continue
                    if fault in ("blank", "duplicate"):
                        break
                    cost += (edit == "R") * 2 + (fault == "truncated")
                    out.append((role if edit == "K" else next(take), text))
                else:
                    continue
                if row is None and PATTERN.match("".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, out)
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "sound")
        seen.add((role, text))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_equals_all_edits(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["system", "user", "assistant", "tool", "user", "assistant"]), rng.choice(["a.", "b", "", "c!", "a."])) for _ in range(rng.randrange(4))]
    found = faults(rows)
    cost, audit, out = cheapest([(r, t, f) for (r, t), f in zip(rows, found, strict=True)])
    kinds = {"s": 0, "u": 1, "a": 2}
    letters = np.array([kinds.get(r[0], 3) * 4 + ["sound", "truncated", "blank", "duplicate"].index(f) for (r, _), f in zip(rows, found, strict=True)], np.int64)
    assert turn_repair.audits([turn_repair.symbols(letters)]) == [(cost, audit)]
    replay = turn_repair.Replay(audit)
    got = [x for r, t in rows for x in replay.row(r, t)] + list(replay.inserted())
    assert got == out


def test_grammar_gives_the_sequences_back_and_changes_no_audit():
    rng = np.random.default_rng(1)
    sequences = [rng.integers(0, 9, n).astype(np.int64) for n in (0, 1, 2, 500, 40, 40, 3)] + [np.full(33, 2), np.tile([2, 4], 300), np.zeros(0, np.int64)]
    rules, short = turn_repair.pair_up(sequences)

    def spelled(s):
        return [s] if s <= turn_repair.DELETED else [x for part in rules[s - turn_repair.DELETED - 1] for x in spelled(part)]

    assert [[x for s in seq.tolist() for x in spelled(s)] for seq in short] == [s.tolist() for s in sequences]
    assert rules and len(short[-2]) < 20
    whole = turn_repair.audits(sequences)
    assert whole == [turn_repair.audits([s])[0] for s in sequences]
    assert all(sum(c != "I" for c in a) == len(s) for (_, a), s in zip(whole, sequences, strict=True))


def test_one_matrix_a_rule(monkeypatch):
    made = []
    times = turn_repair.Matrix.times
    monkeypatch.setattr(turn_repair.Matrix, "times", lambda a, b: made.append(1) or times(a, b))
    sequences = [np.tile([2, 4], 64)] * 50
    rules, _ = turn_repair.pair_up(sequences)
    turn_repair.audits(sequences)
    assert len(made) == len(rules)


def reference(rows):
    """The whole of repair() in plain Python: rows of one conversation (turn, role, text, times)."""
    rows = [(t, " " if r is None else r, " " if x is None else x, n) for t, r, x, n in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    flat = [(t, r, x) for t, r, x, n in rows for _ in range(n)]
    found = faults([(r, x) for _, r, x in flat])
    turns = {t for t, _, _ in flat if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(flat)]
    ways = {0: (0, "", [])}
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user", 3: "assistant"}

    def put(into, state, cost, audit, out):
        if state not in into or (cost, audit) < into[state][:2]:
            into[state] = (cost, audit, out)

    def opened(ways):
        out = dict(ways)
        for state, (cost, audit, rows) in ways.items():
            for _ in range(2):
                state = after[state]
                cost, audit, rows = cost + 2, audit + "I", [*rows, (name[state], "")]
                put(out, state, cost, audit, rows)
        return out

    for (_, role, text), fault in zip(flat, found, strict=True):
        new = {}
        for state, (cost, audit, rows) in opened(ways).items():
            put(new, state, cost + 3, audit + "D", rows)
            if fault in ("blank", "duplicate"):
                continue
            cut = fault == "truncated"
            put(new, after[state], cost + 2 + cut, audit + "R", [*rows, (name[after[state]], text)])
            if role[:1] == "s" and state == 0:
                put(new, 1, cost + cut, audit + "K", [*rows, (role, text)])
            if role[:1] == {2: "u", 3: "a"}[after[state]]:
                put(new, after[state], cost + cut, audit + "K", [*rows, (role, text)])
        ways = new
    cost, audit, out = min(w for s, w in opened(ways).items() if s in (0, 3))
    said = "\n".join(f"{r}:{t}" for r, t in out)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(said.encode()).hexdigest())


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(spark, rows, times=None):
    df = spark.createDataFrame([(*r, n) for r, n in zip(rows, times or [1] * len(rows), strict=True)], SCHEMA + ", times long")
    got = turn_repair.repair(clashing(df, ["letters", "tkey", "audit", "part"]), F.col("times")).collect()
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        mine = [(*x[1:], n) for x, n in zip(rows, times or [1] * len(rows), strict=True) if x[0] == r.conv_id]
        assert tuple(r[c] for c in COLUMNS) == reference(mine), r.conv_id


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 3, "user", "hi"), (None, 3, "user", "hi"),
        (1, 0, "system", "s."), (1, 1, "user", "u?"), (1, 2, "assistant", "a!"), (1, 9, "tool", "t."),
        (2, None, "assistant", "a."), (2, None, "user", None), (2, 1, "", "e."), (2, 1, "", "e."),
        (3, 0, "user", " \n\t"), (4, 5, "assistant", "x.\n "), (4, 5, "user", "x.\n "), (4, 5, "user", "ünï\U0001f600."),
        (5, 0, "agent", "kept by its initial."), (5, -4, "u", "short role."),
    ]
    check(spark, rows)
    check(spark, rows, [i % 3 for i in range(len(rows))])


def test_many_and_long_conversations(spark, monkeypatch):
    rng = random.Random(5)
    roles = ["user", "assistant", "user", "assistant", "system", "tool"]
    rows = [(c, t, rng.choice(roles), rng.choice(["yes.", "no", "", "so!", f"{t}?"])) for c in range(60) for t in range(rng.randrange(12))]
    rows += [(99, t, roles[t % 2], f"text {t % 700}.") for t in range(3000)]  # a hot one, with repeats far apart
    check(spark, rows)
    check(spark, [(7, 1, "user", "same.")], [40_000])


def test_empty_table(spark):
    assert turn_repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two? Three!") for c in (None, 0, 7) for t in (None, *range(30))]
    got = {(r.conv_id, r.turn): (r.role, r.text, r.times) for r in queries.damaged(spark.createDataFrame(rows, SCHEMA)).collect()}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else "One Two Three" if kind == 2 else text
        assert got[c, t] == ("user" if kind == 4 else role, text, {0: 0, 3: 2}.get(kind, 1))


def test_query_equals_its_sql(spark, sf_dir):
    assert_same(queries.op12_turn_repair(spark, sf_dir), queries.OP12_SQL, sf_dir)
