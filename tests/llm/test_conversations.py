import hashlib
import itertools
import random
from functools import lru_cache

import pytest

from oreline.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, part long, audit string"
BLANK = " \t\n\x0b\x0c\r"


@lru_cache(None)
def best(rows, state):
    """Least (cost, audit) by plain recursion from the front; rows are (initial, fault). Three inserts in a row would come back to a role."""
    out = []
    for n in range(3):
        if n:
            state = "a" if state == "u" else "u"
        if not rows and state in "0a":
            out.append((5 * n, "I" * n))
        out += [(5 * n + c, "I" * n + a) for c, a in consumed(rows, state)]
    return min(out)


def consumed(rows, state):
    if not rows:
        return []
    (initial, fault), rest = rows[0], rows[1:]
    c, a = best(rest, state)
    out = [(c + 2, "D" + a)]
    if fault not in ("blank", "duplicate"):
        more = 5 * (fault == "truncated")
        for new in {"0": "su", "s": "u", "a": "u", "u": "a"}[state]:
            c, a = best(rest, new)
            if new == initial:
                out.append((c + more, "K" + a))
            if new != "s":
                out.append((c + more + 1, "R" + a))
    return out


def replay(rows, audit):
    """Repaired lines of (role, text) rows."""
    state, out, rows = "0", [], iter(rows)
    for e in audit:
        role, text = next(rows) if e != "I" else ("", "")
        if e == "D":
            continue
        if e in "RI":
            role = "assistant" if state == "u" else "user"
        state = role[:1]
        out.append(f"{role}:{text}")
    return "\n".join(out)


def brute(table, ids):
    by = {i: [] for i in ids}
    for c, t, r, x in table:
        by[c].append((t, r if r is not None else " ", x if x is not None else " "))
    out = []
    for c, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, facts = set(), []
        for _, role, text in rows:
            body = text.rstrip(BLANK)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            facts.append((role[:1], fault))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = best(tuple(facts), "0")
        count = lambda f: sum(x[1] == f for x in facts)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(facts))
        out.append((c, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(replay([r[1:] for r in rows], audit).encode()).hexdigest()))
    return sorted(out, key=repr)


def random_rows(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "half", " ", "", None, "So?  \n", "A.", "B."]
    return [(rng.choice([k, k, k, 0, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{k}.") for k in range(n)]


def run(spark, table, ids=()):
    df = spark.createDataFrame([(*r, 1, "x") for r in table], SCHEMA)
    known = spark.createDataFrame([(i,) for i in {r[0] for r in table} | set(ids)], "conv_id long")
    return sorted((tuple(r) for r in cv.report(df, known).collect()), key=repr)


@pytest.mark.parametrize("piece", [256, 3])
def test_equals_brute_force(spark, monkeypatch, piece):
    """Pieces of three rows, two joined at once, give the same as whole conversations."""
    monkeypatch.setattr(cv, "PIECE", piece)
    monkeypatch.setattr(cv, "JOINED", 2 if piece == 3 else 32)
    monkeypatch.setattr(cv, "FEW", 20)
    rng = random.Random(piece)
    table = [(c if c else None, *r) for c in range(60) for r in random_rows(rng, rng.choice([1, 2, 5, 9, 14]))]
    assert run(spark, table, {None, 77}) == brute(table, {r[0] for r in table} | {77})


def test_one_conversation_across_partitions(spark, monkeypatch):
    monkeypatch.setattr(cv, "FEW", 50)
    rng = random.Random(9)
    table = [(1, k, rng.choice(["user", "assistant"]), rng.choice([f"t{k}.", f"t{k % 9}!", "x"])) for k in range(300)]
    assert run(spark, table) == brute(table, {1})


def test_edges(spark):
    assert run(spark, []) == []
    empty = hashlib.sha256(b"").hexdigest()
    assert run(spark, [], {5, None}) == sorted([(5, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)], key=repr)
    assert run(spark, [(1, None, None, None)])[0][:8] == (1, 0, 1, 0, 0, 0, 2, "D")
    long = "word " * 100_000 + "."
    assert run(spark, [(1, 0, "user", long), (1, 1, "assistant", "A.")])[0][:8] == (1, 0, 0, 0, 0, 0, 0, "KK")


def test_earley_equals_recursion():
    signs = {"u": ("u", ""), "U": ("u", "truncated"), "a": ("a", ""), "A": ("a", "truncated"), "s": ("s", ""), "S": ("s", "truncated"), "-": ("-", ""), "_": ("-", "truncated"), "x": ("u", "blank")}
    rng = random.Random(1)
    every = ["".join(p) for n in range(4) for p in itertools.product("uAs-x", repeat=n)]
    for rows in every + ["".join(rng.choice(list(signs)) for _ in range(rng.randint(4, 12))) for _ in range(200)]:
        got = cv.earley(rows, "0")
        assert min(got[r] for r in "0a" if r in got) == best(tuple(signs[c] for c in rows), "0"), rows


def test_pieces_join_to_the_whole():
    rng = random.Random(2)
    for _ in range(60):
        rows = "".join(rng.choice("uaUAsx-_") for _ in range(9))
        ways = lambda text: [{"entry": e, "exit": r, "cost": c, "audit": a, "via": r} for e in "0sua" for r, c, a in cv.parsed(text, e)]
        whole = {(w["entry"], w["exit"]): (w["cost"], w["audit"]) for w in ways(rows)}
        parts = cv.joined([ways(rows[:2]), ways(rows[2:5]), ways(rows[5:])])
        assert {(w["entry"], w["exit"]): (w["cost"], w["audit"]) for w in parts} == whole
