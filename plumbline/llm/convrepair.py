"""Conversation structure repair by Wagner-Fischer alignment to the alternating grammar (operator 11).

A conversation should read `(s?(ua)+)?` by the initials of its roles.  Its turns are aligned to the grammar's string of each
feasible length: keep a turn (0), give it the role user or assistant (1), delete it (2), insert an empty turn (5); blank and
duplicate turns must be deleted, a truncated one that stays costs 5 more.  The strings of all lengths end alike, so one
Wagner-Fischer table over the turns and the symbols left serves all of them.  The incumbent is the least cost over every length, from
two linear passes over the states of the grammar; the table's band is Ukkonen's: only cells through which the incumbent's
cost can be reached are opened.  Each length that reaches it is traced back, and the least audit in ASCII is taken.

Spark does the rest: faults are found row by row, duplicates by a window over (conversation, role and text); of a row two
letters go on to its conversation's alignment; the texts are sent once, to be hashed in order as a stream, one row at a time.
So no conversation's texts are held; the codes of its turns and their table are, since its audit is one value.

Defined cases: null roles and texts become one space; turns are ordered by turn (nulls first), ties by role, then by a hash
of the text; rows without a conv_id are one conversation; equal rows are duplicates of the first; a very long text
is a row like others; a conversation of which no row is left has zeros, an empty audit and the hash of the empty string; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELABEL, DELETE, INSERT, CUT = 1, 2, 5, 5
SPACE = " \t\n\v\f\r"
NONE = 1 << 60


# the alignment -------------------------------------------------------------------------------------
def _moves(turn: tuple[str, str], symbol: str) -> tuple[str, int]:
    """Letter and cost of putting a turn (initial, fault) at a symbol; no letter where it cannot stand there."""
    initial, fault = turn
    if fault in "BD" or (symbol == "s" and initial != "s"):
        return "", NONE
    own = CUT if fault == "T" else 0
    return ("K", own) if initial == symbol else ("R", own + RELABEL)


# states of the grammar: 0 nothing written, 1 after s, 2 within a pair, 3 after a pair; what may follow and whether it may end
STEPS = {0: (("u", 2), ("s", 1)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}
ENDS = (0, 3)


def _reach(turns: list[tuple[str, str]]) -> list[list[int]]:
    """Least cost to reach each state before every turn, insertions included."""
    now, out = [0, NONE, NONE, NONE], []
    for k in range(len(turns) + 1):
        for _ in range(2):
            for state, follow in STEPS.items():
                for symbol, to in follow:
                    if symbol != "s":
                        now[to] = min(now[to], now[state] + INSERT)
        out.append(now)
        if k < len(turns):
            new = [c + DELETE for c in now]
            for state, follow in STEPS.items():
                for symbol, to in follow:
                    new[to] = min(new[to], now[state] + _moves(turns[k], symbol)[1])
            now = new
    return out


def align(turns: list[tuple[str, str]]) -> tuple[int, str]:
    """Least cost and the least audit of turns given as (role initial, fault letter B, D, T or -)."""
    reach, n = _reach(turns), len(turns)
    best = min(reach[n][s] for s in ENDS)
    # rows[i][left]: least cost of turns i.. against the last `left` symbols, kept where `best` can be reached through it
    rows: list[dict[int, int]] = [{} for _ in range(n + 1)]
    before = [(min(c[0], c[1], c[3]), c[2]) for c in reach]
    for i in range(n, -1, -1):
        row, below = rows[i], rows[i + 1] if i < n else {0: 0}
        left, last = (0, 0) if i == n else (min(below, default=0), max(below, default=-1) + 1)
        while left <= last:
            cost = 0 if i == n and left == 0 else NONE
            if i < n:
                cost = min(cost, below.get(left, NONE) + DELETE)
                if left:
                    cost = min(cost, below.get(left - 1, NONE) + _moves(turns[i], "ua"[left % 2])[1])
            if left:
                cost = min(cost, row.get(left - 1, NONE) + INSERT)
            if cost + before[i][left % 2] <= best:
                row[left] = cost
                last = max(last, left + 1)
            left += 1
    found = [_trace(turns, rows, left, best) for left, cost in rows[0].items() if left % 2 == 0 and cost == best]
    found += [_trace(turns, rows, left, best, True) for left in _with_system(turns, rows, best)]
    return best, min(found)


def _with_system(turns: list[tuple[str, str]], rows: list[dict[int, int]], best: int) -> list[int]:
    """Symbols after a kept system turn, all turns before it deleted, with which the least cost is reached."""
    out = set()
    for i, turn in enumerate(turns):
        if DELETE * i > best:
            break
        own = _moves(turn, "s")[1]
        out |= {left for left, cost in rows[i + 1].items() if left and left % 2 == 0 and DELETE * i + own + cost == best}
    return sorted(out)


def _trace(turns: list[tuple[str, str]], rows: list[dict[int, int]], left: int, cost: int, system: bool = False) -> str:
    """The least audit of a target: at every step the first letter by which its cost can still be reached."""
    out, i = [], 0
    if system:
        last = max(k for k, t in enumerate(turns) if DELETE * k <= cost and DELETE * k + _moves(t, "s")[1] + rows[k + 1].get(left, NONE) == cost)
        out, cost, i = ["D"] * last + ["K"], rows[last + 1][left], last + 1
    while i < len(turns) or left:
        if i < len(turns) and rows[i + 1].get(left, NONE) + DELETE == cost:
            out.append("D")
            cost, i = cost - DELETE, i + 1
        elif left and rows[i].get(left - 1, NONE) + INSERT == cost:
            out.append("I")
            cost, left = cost - INSERT, left - 1
        else:
            letter, own = _moves(turns[i], "ua"[left % 2])
            out.append(letter)
            cost, left, i = cost - own, left - 1, i + 1
    return "".join(out)


# Spark ---------------------------------------------------------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy of conversations with every row hurt by crc32(conv_id:turn) % 20: 0 dropped (a row with a
    null text and role keeps its conversation known), 1 emptied, 2 without .!?, 3 repeated, 4 given to the user."""
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(k == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.select("conv_id", "turn", F.when(k > 0, role).alias("role"), F.when(k > 0, text).alias("text"), copies.alias("copy")).drop("copy")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def coded(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role initial and fault of each row (X: no row), in order within partitions by conv_id; no texts."""
    end = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    t = turns.select(
        "conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.substring("role", 1, 1).alias("initial"),
        F.when(F.col("text").isNull(), "X").when(F.length(F.ltrim("text", F.lit(SPACE))) == 0, "B").when(~end.isin(".", "!", "?"), "T").otherwise("-").alias("fault"),
    )
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", F.col("fault") == "X").orderBy(*_order()[:1]))
    t = t.withColumn("fault", F.when((seen > 1) & F.col("fault").isin("T", "-"), "D").otherwise(F.col("fault")))
    return t.repartition("conv_id").sortWithinPartitions("conv_id", *_order(), F.col("fault") == "D").select("conv_id", "turn", "initial", "fault")


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _audits(batches) -> Iterator[pa.RecordBatch]:
    """One audit for each run of rows with one conv_id."""
    now: object = batches  # no conversation has this id
    turns: list[tuple[str, str]] = []
    known: dict[tuple[str, str], tuple[str, str]] = {}
    numbers: list[int] = []  # first, last and number of different turns

    def close() -> tuple:
        count = lambda f: sum(t[1] == f for t in turns)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))  # noqa: B905
        gaps = numbers[1] - numbers[0] + 1 - numbers[2] if numbers else 0
        return (now, gaps, count("B"), count("D"), count("T"), illegal, *align(turns))

    for batch in batches:
        done = []
        for conv, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != now:
                if now is not batches:
                    done.append(close())
                now, turns, numbers = conv, [], []
            if fault != "X":
                turns.append(known.setdefault((initial, fault), (initial, fault)))
                if turn is not None:
                    numbers = [numbers[0], turn, numbers[2] + (turn != numbers[1])] if numbers else [turn, turn, 1]
        if done:
            yield _batch(done, AUDIT)
    if now is not batches:
        yield _batch([close()], AUDIT)


REPAIRED = AUDIT + ", repaired_sha256 string"


def _repair(batches) -> Iterator[pa.RecordBatch]:
    """Rows by conversation, its audit first, then its turns in order: the hash of the repaired turns, row by row."""
    head: list = []
    audit, at, written, state = "", 0, 0, hashlib.sha256()
    system = False

    def write(role: str, text: str) -> None:
        nonlocal written
        state.update((("\n" if written else "") + role + ":" + text).encode("utf-8"))
        written += 1

    def expected() -> str:
        return "user" if (written - system) % 2 == 0 else "assistant"

    def inserts() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            write(expected(), "")
            at += 1

    def close() -> list:
        inserts()
        return [*head, state.hexdigest()]

    for batch in batches:
        done, columns = [], [c.to_pylist() for c in batch.columns]
        for kind, role, text, *own in zip(*columns, strict=True):
            if kind == 0:
                if head:
                    done.append(close())
                head, audit, at, written, state, system = own, own[-1], 0, 0, hashlib.sha256(), False
                continue
            inserts()
            letter = audit[at]
            at += 1
            if letter == "K":
                system = system or (not written and role[:1] == "s")
                write(role, text)
            elif letter == "R":
                write(expected(), text)
        if done:
            yield _batch(done, REPAIRED)
    if head:
        yield _batch([close()], REPAIRED)


def audits(turns: DataFrame) -> DataFrame:
    """Faults, least cost and least audit of each conversation of turns (conv_id, turn, role, text)."""
    return coded(turns).mapInArrow(_audits, AUDIT)


def repair(turns: DataFrame) -> DataFrame:
    """audits() with the SHA-256 of the repaired conversation: role:text of its turns, joined by newlines."""
    names = [f.split()[0] for f in AUDIT.split(", ")]
    first = audits(turns).select(F.lit(0).alias("kind"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("digest"), *names)
    texts = turns.where("text is not null").select(F.lit(1).alias("kind"), "role", "text", "turn", F.md5("text").alias("digest"), "conv_id")
    rows = first.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order())
    return rows.select("kind", "role", "text", *names).mapInArrow(_repair, REPAIRED)
