"""Repair of conversation structure by depth-first branch-and-bound.

The roles of a repaired conversation read `(s?(ua)+)?` by their initials. Edits keep a row, give it the role
that the grammar wants, delete it, or insert an empty row; the cheapest sequence of edits is looked for, of
several the one whose audit (the edits' initials) is least in ASCII.

The search runs over nodes (rows taken, state of the grammar) with an explicit stack. A prefix is left when its
cost and the least cost that the suffix can have from its state pass the incumbent, when that makes no better
cost and its audit no better audit, or when the node's dominance table holds a prefix with no greater (cost,
audit): two prefixes of one node and cost are never beginnings of each other, so what follows can't change their
order. Of a node's branches the one with the least bound, then audit, is taken first. The stack is empty when
the incumbent is proved best.

A conversation is a stream of rows in one task, as its digest and audit are one value each. Every SEGMENT rows
the search goes from the states that are left to the best prefix for each state; what those prefixes have in
common is settled, hashed and let go. Held are a digest of 16 bytes for each row and the rows not yet settled.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import slices

#: Rows that one search takes.
SEGMENT = 128
#: Costs of the edits; a truncated row that stays costs one more.
RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States by what came last: nothing, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a kept row, by state and initial; the state and role behind a row that is inserted or given a role.
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
WANTED = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
ENDS = (START, ASSISTANT)
LEGAL_PAIRS = ("su", "ua", "au")
SPACES = " \t\n\x0b\x0c\r"

Prefix = tuple[int, str]


def damage(rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, lost): `rows` damaged by crc32 of `conv_id:turn`, modulo 20. On 0 a row is
    lost, on 1 its text is empty, on 2 it has no `.`, `!` or `?`, on 3 it comes twice, on 4 its role is user.
    Null roles and texts become one space, as null ids and turns do in the hash. Empty input gives no rows;
    other columns are not read."""
    space = F.lit(" ")
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(as_text(id_column), F.lit(":"), as_text(turn_column)).cast("binary")) % 20
    own = rows.select(F.col(id_column).alias("conv_id"), F.col(turn_column).alias("turn"), as_text(role_column).alias("role"), as_text(text_column).alias("text"), kind.alias("kind"))
    is_kind = lambda k: F.col("kind") == k
    text = F.when(is_kind(0) | is_kind(1), F.lit("")).when(is_kind(2), F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(is_kind(4), F.lit("user")).otherwise(F.col("role"))
    changed = own.select("conv_id", "turn", role.alias("role"), text.alias("text"), is_kind(0).alias("lost"), F.when(is_kind(3), 2).otherwise(1).alias("times"))
    return changed.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "time")


def bounds(rows: list[tuple[str, str]], goals: Iterable[int]) -> list[list[float]]:
    """For each row, and the end: from each state the least cost of that row and all that follow, whatever their
    audit, to one of the states `goals`."""

    def with_inserts(here: list[float]) -> list[float]:
        for _ in range(2):  # a third insert leads back
            here = [min(here[s], INSERT + here[WANTED[s][0]]) for s in range(4)]
        return here

    out = [with_inserts([0 if s in goals else math.inf for s in range(4)])]
    for initial, fault in reversed(rows):
        then, here = out[-1], []
        for s in range(4):
            ways = [DELETE + then[s]]
            if fault not in ("b", "d"):
                more = TRUNCATED * (fault == "t")
                ways.append(more + RETYPE + then[WANTED[s][0]])
                if initial in KEEP[s]:
                    ways.append(more + then[KEEP[s][initial]])
            here.append(min(ways))
        out.append(with_inserts(here))
    return out[::-1]


def search(rows: list[tuple[str, str]], starts: dict[int, Prefix], goals: Iterable[int] = ENDS) -> Prefix | None:
    """The best (cost, audit) behind all `rows`, (initial, fault) each, that ends in one of the states `goals`,
    from the prefixes `starts` by state; none if no edits lead there."""
    goals, n = set(goals), len(rows)
    after = bounds(rows, goals)
    tables: list[dict[int, Prefix]] = [{} for _ in range(n + 1)]
    best: Prefix | None = None
    stack: list[tuple[int, int, Prefix]] = []

    def branch(nodes: list[tuple[int, int, int, str]]) -> None:
        """Push what may still win, that with the least bound and audit on top."""
        ranked = sorted(((cost + after[at][state], audit, at, state, cost) for at, state, cost, audit in nodes), reverse=True)
        for total, audit, at, state, cost in ranked:
            prefix = (cost, audit)
            if total == math.inf or state in tables[at] and tables[at][state] <= prefix:
                continue
            tables[at][state] = prefix
            stack.append((at, state, prefix))

    branch([(0, state, cost, audit) for state, (cost, audit) in starts.items()])
    while stack:
        at, state, prefix = stack.pop()
        cost, audit = prefix
        if tables[at][state] != prefix:
            continue  # a better prefix has come to this node
        total = cost + after[at][state]
        if best is not None and (total > best[0] or total == best[0] and audit > best[1][: len(audit)]):
            continue
        if at == n and state in goals and (best is None or prefix < best):
            best = prefix
        to = WANTED[state][0]
        nodes = [(at, to, cost + INSERT, audit + "I")]
        if at < n:
            initial, fault = rows[at]
            nodes.append((at + 1, state, cost + DELETE, audit + "D"))
            if fault not in ("b", "d"):
                stays = cost + TRUNCATED * (fault == "t")
                nodes.append((at + 1, to, stays + RETYPE, audit + "R"))
                if initial in KEEP[state]:
                    nodes.append((at + 1, KEEP[state][initial], stays, audit + "K"))
        branch(nodes)
    return best


class _Repair:
    """One conversation as its rows come."""

    def __init__(self, segment: int):
        self.segment = segment
        self.seen: set[bytes] = set()
        self.counts = {"b": 0, "d": 0, "t": 0, "": 0}
        self.illegal, self.before = 0, None
        self.turns = [None, None, 0]
        self.facts: list[tuple[str, str]] = []  # rows that no search has taken
        self.rows: list[tuple[str, str]] = []  # rows whose edit isn't settled
        self.prefixes: dict[int, Prefix] = {START: (0, "")}
        self.state, self.audit, self.digest, self.empty = START, [], hashlib.sha256(), True

    def add(self, turn, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        body, initial = text.rstrip(SPACES), role[:1]
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        fault = "b" if not body else "d" if key in self.seen else "t" if body[-1] not in ".!?" else ""
        self.seen.add(key)
        self.counts[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in LEGAL_PAIRS
        self.before = initial
        if turn is not None:
            if self.turns[0] is None:
                self.turns[0] = turn
            self.turns[2] += turn != self.turns[1]
            self.turns[1] = turn
        self.facts.append((initial, fault))
        self.rows.append((role, text))
        if len(self.facts) == self.segment:
            found = {goal: search(self.facts, self.prefixes, [goal]) for goal in range(4)}
            self.prefixes = {goal: best for goal, best in found.items() if best is not None}
            self.facts = []
            common = os.path.commonprefix([audit for _, audit in self.prefixes.values()])
            self.prefixes = {s: (cost, audit[len(common) :]) for s, (cost, audit) in self.prefixes.items()}
            yield from self.settle(common)

    def settle(self, audit: str) -> Iterator[tuple[str, str, str]]:
        """Apply edits to the oldest rows: (edit, role, text) of each row that is left."""
        self.audit.append(audit)
        used = 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else self.rows[used]
            used += edit != "I"
            if edit == "D":
                continue
            if edit == "K":
                self.state = KEEP[self.state][role[:1]]
            else:
                self.state, role = WANTED[self.state]
            self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
            self.empty = False
            yield edit, role, text
        del self.rows[:used]

    def end(self) -> Iterator[tuple[str, str, str]]:
        self.cost, audit = search(self.facts, self.prefixes)
        yield from self.settle(audit)

    def summary(self) -> dict:
        first, last, distinct = self.turns
        gaps = 0 if first is None else last - first + 1 - distinct
        counts = {name: self.counts[k] for name, k in (("blank", "b"), ("duplicate", "d"), ("truncated", "t"))}
        return {"gaps": gaps, **counts, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def _stream(messages: bool, segment: int, kind: pa.DataType):
    summary = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    message = [("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
    schema = pa.schema([("conv_id", kind), *(message if messages else summary)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, count, out = None, None, 0, []

        def take(edits: Iterator[tuple[str, str, str]]) -> None:
            nonlocal count
            for edit, role, text in edits:
                if messages:
                    out.append({"conv_id": now, "position": count, "edit": edit, "role": role, "text": text})
                count += 1

        def close() -> None:
            take(own.end())
            if not messages:
                out.append({"conv_id": now, **own.summary()})

        for batch in slices(batches, "text"):
            for row in batch.to_pylist():
                if own is None or row["conv_id"] != now:
                    if own is not None:
                        close()
                    own, now, count = _Repair(segment), row["conv_id"], 0
                if not row["lost"]:
                    take(own.add(row["turn"], row["role"], row["text"]))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if own is not None:
            close()
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def repair(rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", lost_column: str | None = None, messages: bool = False, segment: int = SEGMENT) -> DataFrame:
    """A row for each conversation of `rows`: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256); with `messages` a row for each row of the repaired ones: (conv_id, position from 0, edit,
    role, text).

    Rows of a conversation are taken by turn, null turns first; rows with one turn by role, then by text, in
    bytes. A null role or text counts as one space; rows with a null id are one conversation. Each row's first
    fault counts: blank, duplicate (role and text stood before), truncated (the last character that isn't a
    space isn't one of `.!?`). `gaps`: turns that are missing between the least and the greatest, null turns
    left out. A row without a role has no initial, so it is never kept as it is. `illegal`: neighbours whose initials aren't su, ua or au. Rows with `lost_column` true only name
    their conversation; one with no other rows has zeros, an empty audit and the digest of no bytes. Empty input
    gives no rows; other columns are not read.
    """
    lost = F.lit(False) if lost_column is None else F.coalesce(F.col(lost_column), F.lit(False))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col(id_column).alias("conv_id"), F.col(turn_column).cast("long").alias("turn"), text(role_column).alias("role"), text(text_column).alias("text"), lost.alias("lost"))
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema[id_column].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}[kind]
    if messages:
        return dealt.mapInArrow(_stream(True, segment, arrow), f"conv_id {kind}, position long, edit string, role string, text string")
    return dealt.mapInArrow(_stream(False, segment, arrow), f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
