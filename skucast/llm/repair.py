"""Operator 13: repair of conversation structure, by Four-Russians block tables.

A conversation should be empty or alternate user and assistant turns, ending with an assistant, after an optional
system turn. A row's symbol says its role's initial and whether it must go (blank, or equal to an earlier row) or
is cut off (no full stop, exclamation or question mark at its end). Edits: Keep 0, Rerole to user or assistant 1,
Delete 2, Insert an empty turn 5; keeping a cut-off text costs 5 more. Of the cheapest edit strings the one that
is least in ASCII is chosen.

The automaton has four states, so the costs of finishing a conversation from a position form a vector of four
numbers. Less its minimum it takes only a few values (states reach each other by inserts, which bounds the
differences), so every vector has a number, and for every block of ``BLOCK`` symbols and every vector behind it a
table holds the vector before the block and what is added to the minimum. Costs run from the end of a conversation
to its start, a block a lookup; only the vectors between blocks are kept. Tracing then expands block after block in
the other direction: with the costs to go known, the least letter that stays on a cheapest path can be taken at
once, which settles ties exactly (a row's letters are the same number on all paths, so the first difference decides).

Rows are symbols in segments of ``ROWS``, held one at a time: a segment is traced for every state that it may be
entered in, and a last pass in order picks the state, applies the edits and yields the turns. That pass, like any
digest of a whole conversation, streams one conversation's rows through one task, a row at a time.

Defined results: a null role or text is one space, a null conv_id a conversation of its own; rows are ordered by
turn (null first), role and text; a conversation that has no rows (its id is in ``ids`` alone) gives zeros and an
empty audit; a table without conversations gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, ROWS = 4, 4096
SPACES = " \t\n\x0b\x0c\r"
GONE, SYMBOLS = 0, 9  # symbol 0 must go; others are 1 + 2 * role (s, u, a, other) + cut off
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
NEXT = (2, 2, 3, 2)  # the state after the role that can be inserted: start, after system, after user, after assistant
ROLE = {2: "user", 3: "assistant"}  # of the turn that leads to a state
AT_END = (0, 10, 5, 0)
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "conv_id long, place long, edit string, role string, text string"


def row_edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits that use up a row, in ASCII order."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        role, cut = divmod(symbol - 1, 2)
        kept = {0: 1 if state == 0 else None, 1: 2 if state != 2 else None, 2: 3 if state == 2 else None}.get(role)
        if kept is not None:
            out.append(("K", CUT_OFF * cut, kept))
        out.append(("R", REROLE + CUT_OFF * cut, NEXT[state]))
    return out


def costs_before(symbol: int, after: tuple) -> tuple:
    """Costs to go from every state before a row of ``symbol``, given those behind it."""
    row = [min(cost + after[to] for _, cost, to in row_edits(symbol, q)) for q in range(4)]
    row[2] = min(row[2], INSERT + row[3])
    return tuple(min(row[q], INSERT + row[2]) if q != 2 else row[2] for q in range(4))


@cache
def vectors() -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """All cost vectors less their minimum, number 0 being that of the end, and for every vector and symbol the
    number of the vector before it and what the minimum grows by."""
    known, found, step, add = {AT_END: 0}, [AT_END], [], []
    for v in found:  # grows while vectors are found
        step.append([])
        add.append([])
        for symbol in range(SYMBOLS):
            before = costs_before(symbol, v)
            low = min(before)
            before = tuple(c - low for c in before)
            if before not in known:
                known[before] = len(found)
                found.append(before)
            step[-1].append(known[before])
            add[-1].append(low)
    return found, np.array(step, np.int64), np.array(add, np.int64)


@cache
def block_tables() -> list[tuple[list, list]]:
    """Entry k: for every vector, and every block of k symbols as a number in base ``SYMBOLS``, the vector before the
    block and the growth of the minimum."""
    found, step, add = vectors()
    to, more = np.arange(len(found))[:, None], np.zeros((len(found), 1), np.int64)
    out = [(to.tolist(), more.tolist())]
    for _ in range(BLOCK):  # one symbol more in front of the block
        more = np.concatenate([more + add[to, s] for s in range(SYMBOLS)], axis=1)
        to = np.concatenate([step[to, s] for s in range(SYMBOLS)], axis=1)
        out.append((to.tolist(), more.tolist()))
    return out


def _blocks(symbols: str) -> list[str]:
    return [symbols[i:i + BLOCK] for i in range(0, len(symbols), BLOCK)]


def vectors_between(symbols: str, behind: int) -> tuple[list[int], int]:
    """The vectors before every block and behind the last one, and the growth of the minimum over all."""
    tables, out, total = block_tables(), [behind], 0
    for block in reversed(_blocks(symbols)):
        to, more = tables[len(block)]
        code = int(block, SYMBOLS)
        total += more[out[-1]][code]
        out.append(to[out[-1]][code])
    return out[::-1], total


@cache
def _row_choice(symbol: int, behind: int, state: int) -> tuple[str, int]:
    """The letters up to a row's own edit that stay on a cheapest path, each the least possible, and the state
    after; ``behind`` is the vector behind the row."""
    after = vectors()[0][behind]
    before, letters = costs_before(symbol, after), ""
    while True:
        choices = [(letter, to) for letter, cost, to in row_edits(symbol, state) if cost + after[to] == before[state]]
        if INSERT + before[NEXT[state]] == before[state]:
            choices.append(("I", NEXT[state]))
        letter, state = min(choices)
        letters += letter
        if letter != "I":
            return letters, state


@lru_cache(1 << 16)
def _expanded(block: str, behind: int, state: int) -> tuple[str, int]:
    """A block's letters and the state after it, from ``state`` and the vector behind it."""
    _, step, _ = vectors()
    at = [behind]
    for symbol in reversed(block[1:]):
        at.append(int(step[at[-1], int(symbol)]))
    letters = ""
    for symbol, after in zip(block, reversed(at)):
        more, state = _row_choice(int(symbol), after, state)
        letters += more
    return letters, state


def trace(symbols: str, between: list[int], state: int, is_end: bool) -> tuple[str, int]:
    """The audit of a segment entered in ``state``, and the state after it; the end of a conversation may insert."""
    audit = []
    for block, behind in zip(_blocks(symbols), between[1:]):
        letters, state = _expanded(block, behind, state)
        audit.append(letters)
    while is_end and AT_END[state]:
        audit.append("I")
        state = NEXT[state]
    return "".join(audit), state


def cheapest(symbols: str) -> tuple[int, str]:
    """(cost, audit) of one conversation's symbols."""
    between, total = vectors_between(symbols, 0)
    return total + vectors()[0][between[0]][0], trace(symbols, between, 0, True)[0]


def marked(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Rows with their place in the conversation (from 1), segment ``number`` and ``symbol``, the flags of ``COUNTS``
    (``turns``: the first row of a turn that is not null). Every id has a row of place 0 besides."""
    src = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(True).alias("real"))
    every = (turns if ids is None else ids).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = src.unionByName(every.withColumn("real", F.lit(False)), allowMissingColumns=True).repartition("conv_id")
    by_conv = Window.partitionBy("conv_id").orderBy("real", F.asc_nulls_first("turn"), "role", "text")
    placed = rows.withColumns({"place": (F.row_number().over(by_conv) - 1).cast("long"),
                               "initial": F.substring("role", 1, 1), "said": F.md5(F.col("text").cast("binary"))})
    order, same = Window.partitionBy("conv_id").orderBy("place"), Window.partitionBy("conv_id", "role", "said").orderBy("place")
    full = F.rtrim("text", F.lit(SPACES))
    pair = F.concat(F.lag("initial").over(order), F.col("initial"))
    seen = placed.select(
        "*", full.alias("full"), (F.row_number().over(same) > 1).alias("again"), pair.alias("pair"),
        F.coalesce(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order)), F.lit(False)).alias("turns"))
    blank = F.col("full") == ""
    cut = ~F.substring("full", -1, 1).isin(".", "!", "?")
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    return seen.select(
        "conv_id", "place", F.floor(F.greatest(F.col("place") - 1, F.lit(0)) / ROWS).alias("number"), "turn", "role", "text",
        F.when(blank | F.col("again"), 0).otherwise(1 + 2 * role + cut.cast("int")).alias("symbol"),
        blank.alias("blank"), (~blank & F.col("again")).alias("duplicate"), (~blank & ~F.col("again") & cut).alias("truncated"),
        F.coalesce(~F.col("pair").isin("su", "ua", "au"), F.lit(False)).alias("illegal"), "turns")


def plans(rows: DataFrame) -> DataFrame:
    """A row a segment of ``marked`` rows: its counts, the cost of all from its start on (from the first state), and
    ``audits`` and ``exits`` by entry state."""
    of_rows = F.col("place") > 0
    counted = [F.count_if(of_rows & F.col(c)).alias(c) for c in COUNTS]
    segments = rows.groupBy("conv_id", "number").agg(
        F.sort_array(F.collect_list(F.when(of_rows, F.struct("place", "symbol")))).alias("s"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), *counted)
    packed = segments.withColumn("s", F.array_join(F.transform("s", lambda x: x["symbol"].cast("string")), ""))
    kept = ["conv_id", "number", "low", "high", *COUNTS]
    kinds = "conv_id long, number long, low long, high long, " + ", ".join(f"{c} long" for c in COUNTS)

    def work(batches):
        conv, behind, total, fresh = None, 0, 0, True
        for b in batches:
            cost, audits, exits = [], [], []
            for c, number, symbols in zip(b["conv_id"].to_pylist(), b["number"].to_pylist(), b["s"].to_pylist()):
                is_end = fresh or c != conv
                if is_end:
                    conv, behind, total, fresh = c, 0, 0, False
                between, more = vectors_between(symbols, behind)
                behind, total = between[0], total + more
                paths = [trace(symbols, between, q, is_end) for q in range(4 if number else 1)]
                cost.append(total + vectors()[0][behind][0])
                audits.append([p[0] for p in paths])
                exits.append([p[1] for p in paths])
            yield pa.RecordBatch.from_arrays(
                [b[c] for c in kept] + [pa.array(cost, pa.int64()), pa.array(audits, pa.list_(pa.string())),
                                        pa.array(exits, pa.list_(pa.int64()))], names=[*kept, "cost", "audits", "exits"])

    ordered = packed.select(*kept, "s").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("number"))
    return ordered.mapInArrow(work, f"{kinds}, cost long, audits array<string>, exits array<long>")


def _edits(batches):
    """(first of a conversation, its id, plan or None, letter, role, text) in order: a segment's plan comes before
    its rows and has no letter."""
    conv, fresh, audit, at, state = None, True, "", 0, 0
    names = ("conv_id", "place", "role", "text", "number", "low", "high", *COUNTS, "cost", "audits", "exits")

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, NEXT[state]
            yield False, conv, None, "I", ROLE[state], ""

    for b in batches:
        for c, place, role, text, *plan in zip(*(b[n].to_pylist() for n in names)):
            if place < 0:
                if at < len(audit):  # inserts that end the conversation before
                    yield from inserts()
                begins = fresh or c != conv
                state = 0 if begins else leaves
                conv, fresh = c, False
                audits, exits = plan[-2:]
                audit, at, leaves = audits[state], 0, exits[state]
                yield begins, conv, (*plan[:-2], audit), None, None, None
            elif place > 0:
                yield from inserts()
                letter, at = audit[at], at + 1
                if letter == "K":
                    state = {"s": 1, "u": 2, "a": 3}[role[0]]
                elif letter == "R":
                    state = NEXT[state]
                    role = ROLE[state]
                yield False, conv, None, letter, role, text
    yield from inserts()


def _with_plans(rows: DataFrame) -> DataFrame:
    """Rows and, before each segment's rows, its plan (place -1), by conversation in order."""
    both = rows.select("conv_id", "number", "place", "role", "text").unionByName(
        plans(rows).withColumn("place", F.lit(-1).cast("long")), allowMissingColumns=True)
    # a segment's plan sorts before its rows; only the first segment also holds the row of place 0
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "number", "place")


def edited_turns(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Every edit in order: (conv_id, place, edit, role, text); the rows without those of edit D, ordered by place,
    are the repaired conversations."""

    def work(batches):
        out, place = [], 0
        for begins, conv, plan, letter, role, text in _edits(batches):
            place = 0 if begins else place + (letter is not None)
            if letter:
                out.append((conv, place, letter, role, text))
            if len(out) == 4096:
                yield _batch(out, EDITS)
                out = []
        yield _batch(out, EDITS)

    return _with_plans(marked(turns, ids)).mapInArrow(work, EDITS)


def repair_report(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row a conversation (``REPORT``): counts of faults, the cost, the audit and the digest of the repaired
    ``role:text`` lines. ``ids`` may name conversations without rows."""

    def work(batches):
        out, now = [], None

        def close():
            low, high, turns = now["low"], now["high"], now["turns"]
            gaps = high - low + 1 - turns if turns else 0
            out.append((now["id"], gaps, *(now[c] for c in COUNTS[:-1]), now["cost"], "".join(now["audit"]), now["sha"].hexdigest()))

        for begins, conv, plan, letter, role, text in _edits(batches):
            if begins:
                if now:
                    close()
                now = {"id": conv, "low": None, "high": None, "cost": plan[-2], "audit": [], "sha": hashlib.sha256(),
                       "lines": 0, **dict.fromkeys(COUNTS, 0)}
            if plan:
                _, low, high, *counts, _, audit = plan
                now["low"] = low if now["low"] is None else min(now["low"], low if low is not None else now["low"])
                now["high"] = high if now["high"] is None else max(now["high"], high if high is not None else now["high"])
                now["audit"].append(audit)
                for name, n in zip(COUNTS, counts):
                    now[name] += n
            elif letter != "D":
                now["sha"].update((("\n" if now["lines"] else "") + f"{role}:{text}").encode())
                now["lines"] += 1
            if len(out) == 1024:
                yield _batch(out, REPORT)
                out = []
        if now:
            close()
        yield _batch(out, REPORT)

    return _with_plans(marked(turns, ids)).mapInArrow(work, REPORT)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    types = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[k]) for i, k in enumerate(kinds)], names=list(names))


def planted_damage(turns: DataFrame) -> DataFrame:
    """The turns damaged by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its
    full stops, exclamation and question marks, 3 repeats it, 4 makes its role user. Nulls are one space."""
    space = F.lit(" ")
    k = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                         F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    src = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
                       text.alias("text"), k.alias("damage")).where("damage <> 0")
    d = F.col("damage")
    copies = F.explode(F.when(d == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return src.select(
        "conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(d == 1, "").when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        copies.alias("copy")).drop("copy")
