"""Conversation repair: against a search over all edit strings, a plain row-by-row program, segments, defined results."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from skucast.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def by_search(rows, most_inserts=4):
    """(cost, audit, repaired) by trying every choice of edits; rows are (role, text, must go, cut off)."""
    best = None

    def go(i, roles, lines, cost, audit, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and LEGAL.match(roles):
            best = min(best or (cost, audit, lines), (cost, audit, lines), key=lambda b: b[:2])
        if inserted < most_inserts:
            for r in ("user", "assistant"):
                go(i, roles + r[0], lines + [f"{r}:"], cost + 5, audit + "I", inserted + 1)
        if i < len(rows):
            role, text, gone, cut = rows[i]
            go(i + 1, roles, lines, cost + 2, audit + "D", inserted)
            if not gone:
                go(i + 1, roles + (role[:1] or "?"), lines + [f"{role}:{text}"], cost + 5 * cut, audit + "K", inserted)
                for r in ("user", "assistant"):
                    go(i + 1, roles + r[0], lines + [f"{r}:{text}"], cost + 1 + 5 * cut, audit + "R", inserted)

    go(0, "", [], 0, "", 0)
    return best


def by_program(rows):
    """(cost, audit, repaired): the cheapest (cost, audit) of every state, row by row."""
    state = {0: (0, "", ())}

    def put(to, q, value):
        if q not in to or value[:2] < to[q][:2]:
            to[q] = value

    def inserts(state):
        for _ in range(2):
            for q, (c, a, o) in list(state.items()):
                n = repair.NEXT[q]
                put(state, n, (c + 5, a + "I", o + (repair.ROLE[n] + ":",)))
        return state

    for role, text, gone, cut in rows:
        new = {}
        for q, (c, a, o) in inserts(state).items():
            put(new, q, (c + 2, a + "D", o))
            if not gone:
                kept = {"s": 1 if q == 0 else None, "u": 2 if q != 2 else None, "a": 3 if q == 2 else None}.get(role[:1])
                if kept:
                    put(new, kept, (c + 5 * cut, a + "K", o + (f"{role}:{text}",)))
                n = repair.NEXT[q]
                put(new, n, (c + 1 + 5 * cut, a + "R", o + (f"{repair.ROLE[n]}:{text}",)))
        state = new
    ends = [v for q, v in inserts(state).items() if q in (0, 3)]
    c, a, o = min(ends, key=lambda v: v[:2])
    return c, a, list(o)


def as_rows(symbols):
    roles = ["system", "user", "assistant", "tool"]
    return [("user", f"t{i}", True, False) if s == 0 else (roles[(s - 1) // 2], f"t{i}", False, bool((s - 1) % 2))
            for i, s in enumerate(symbols)]


def test_every_short_conversation_against_the_search():
    for n in range(4):
        for symbols in itertools.product(range(9), repeat=n):
            want = by_search(as_rows(symbols))
            assert repair.cheapest("".join(map(str, symbols))) == want[:2], symbols
            assert by_program(as_rows(symbols)) == want


@pytest.mark.parametrize("seed", range(40))
def test_long_conversations_against_the_program(seed):
    rng = random.Random(seed)
    symbols = [rng.randrange(9) for _ in range(rng.randrange(120))]
    assert repair.cheapest("".join(map(str, symbols))) == by_program(as_rows(symbols))[:2]


def test_tables_hold_every_block_and_few_vectors():
    found, _, _ = repair.vectors()
    assert len(found) < 200 and all(min(v) == 0 for v in found)
    to, more = repair.block_tables()[repair.BLOCK]
    assert len(to) == len(found) and len(to[0]) == 9 ** repair.BLOCK
    rng = random.Random(1)
    for _ in range(300):
        v, block = rng.randrange(len(found)), [rng.randrange(9) for _ in range(repair.BLOCK)]
        cost = found[v]
        for s in reversed(block):
            cost = repair.costs_before(s, cost)
        code = int("".join(map(str, block)), 9)
        assert tuple(c + more[v][code] for c in found[to[v][code]]) == cost


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            row = (c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)
            out += [row] * (2 if k == 3 else 1)
    return out


def brute(ids, rows):
    out = []
    for c in ids:
        mine = sorted((r[1:] for r in rows if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, checked, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for t, r, x in mine:
            full = x.rstrip(repair.SPACES)
            fault = "blank" if not full else "duplicate" if (r, x) in seen else "truncated" if full[-1] not in ".!?" else None
            seen.add((r, x))
            if fault:
                faults[fault] += 1
            checked.append((r, x, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, lines = by_program(checked)
        out.append((c, gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def key(row):
    return row[0] is None, row[0] or 0


def conversations(seed, n):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "no", "", " \n", "Why? ", "é!", "long text without end", None, "Yes."]
    for c in range(n):
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool"])
            rows.append((c, rng.choice([t, t + 2, None]), role, rng.choice(texts) if rng.random() < 0.5 else f"a {c} {t}."))
    return rows


@pytest.mark.parametrize("rows_a_segment", [1, 3, 4096])
def test_report_and_turns(spark, monkeypatch, rows_a_segment):
    monkeypatch.setattr(repair, "ROWS", rows_a_segment)
    rows = conversations(3, 70) + [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (900, 5, "alien", "x" * 50000 + ".")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS number", "'x' AS symbol").repartition(3)
    ids = sorted({r[0] for r in rows}, key=lambda c: (c is None, c or 0))
    got = repair.repair_report(repair.planted_damage(df), df).collect()
    want = brute(ids, damaged(rows))
    assert [tuple(r) for r in sorted(got, key=key)] == want
    lines = {}
    for r in sorted(repair.edited_turns(repair.planted_damage(df), df).collect(), key=lambda r: r.place):
        if r.edit != "D":
            lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert [hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in ids] == [w[-1] for w in want]


def test_one_long_conversation(spark):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"t {t % 900}" + rng.choice([".", "", "."])) for t in range(9000)]
    got = repair.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in got] == brute([7], rows)


def test_conversations_without_rows_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    ids = spark.createDataFrame([(3,), (None,), (3,)], "conv_id long")
    nothing = hashlib.sha256(b"").hexdigest()
    got = sorted(repair.repair_report(empty, ids).collect(), key=key)
    assert [tuple(r) for r in got] == [(3, 0, 0, 0, 0, 0, 0, "", nothing), (None, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert repair.repair_report(empty).count() == 0 and repair.edited_turns(empty).count() == 0
