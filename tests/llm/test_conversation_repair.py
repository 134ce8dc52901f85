import hashlib
import itertools
import random
import re

import pytest

from weekcast.llm.conversation_repair import ASSISTANT, START, SYSTEM, damage, repair, search

GRAMMAR = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, kind string, lost int, cost long, time string"


def brute(rows):
    """Least (cost, audit) over all edits, with the repaired rows, found by lengthening edit strings by cost."""
    from heapq import heappop, heappush

    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, at, initials, body = heappop(heap)
        if at == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, list(body)
        if (at, initials[-1:], initials == "", audit) in seen or not re.fullmatch(r"s?(ua)*u?", initials):
            continue
        seen.add((at, initials[-1:], initials == "", audit))
        for role in ("user", "assistant"):
            if audit[-2:] != "II":
                heappush(heap, (cost + 2, audit + "I", at, initials + role[0], (*body, f"{role}:")))
        if at < len(rows):
            role, text, fault = rows[at]
            heappush(heap, (cost + 3, audit + "D", at + 1, initials, body))
            if fault not in ("b", "d"):
                more = fault == "t"
                heappush(heap, (cost + more, audit + "K", at + 1, initials + (role[:1] or "?"), (*body, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    heappush(heap, (cost + 2 + more, audit + "R", at + 1, initials + other[0], (*body, f"{other}:{text}")))


def expected(rows):
    """The contract's values for one conversation's (turn, role, text) rows."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, judged = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        judged.append((role, text, "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""))
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, body = brute(judged)
    faults = [f for _, _, f in judged]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest()


def result(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).repartition(3)
    return {r.conv_id: tuple(r)[1:] for r in repair(df, **options).collect()}


def random_rows(n, seed):
    rng = random.Random(seed)
    for conv in range(n):
        for _ in range(rng.randint(1, 4)):
            yield conv, rng.choice([None, 0, 1, 2, 5, 9]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(["A.", "b", "c!", " ", "", None, "d?\n", "e.x\t"])


@pytest.mark.parametrize("segment", [128, 2])
def test_random_conversations(spark, segment):
    rows = list(random_rows(60, segment))
    want = {c: expected([r[1:] for r in own]) for c, own in itertools.groupby(rows, key=lambda r: r[0])}
    assert result(spark, rows, segment=segment) == want


def test_edge_rows(spark):
    rows = [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (1, None, "assistant", "x."), (1, None, None, None), (2, 3, "user", "y " * 300000 + "z."), (2, 9, "user", "y " * 300000 + "z.")]
    found = result(spark, rows)
    assert found[None][5:7] == (0, "KK") and found[1] == expected([r[1:] for r in rows[2:4]])
    assert found[2] == expected([r[1:] for r in rows[4:]]) and found[2][0] == 5


def test_long_conversation_in_segments(spark):
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant", "assistant", "tool"]), f"t{i}" + rng.choice([".", ""])) for i in range(700)]
    assert result(spark, rows) == result(spark, rows, segment=1000) == result(spark, rows, segment=3)


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "A. b! c?") for c in range(20) for t in range(10)] + [(None, None, None, None), (1, 1, "user", None)]
    found = sorted(tuple(r) for r in damage(spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)).collect() if r.conv_id is not None)
    want = []
    for c, t, role, text in rows:
        if c is None:
            continue
        role, text = role, " " if text is None else text
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = "" if k in (0, 1) else re.sub("[.!?]", "", text) if k == 2 else text
        want += [(c, t, "user" if k == 4 else role, text, k == 0)] * (2 if k == 3 else 1)
    assert found == sorted(want) and {k for k in range(5)} <= {zlib.crc32(f"{c}:{t}".encode()) % 20 for c in range(20) for t in range(10)}


def test_lost_conversations_and_empty_tables(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 0, "user", "a."), (2, 0, "user", "a."), (2, 1, "assistant", "b.")], "conv_id long, turn long, role string, text string")
    found = {r.conv_id: tuple(r)[1:] for r in repair(df.withColumn("gone", F.col("conv_id") == 1), lost_column="gone").collect()}
    assert found[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) and found[2][6] == "KK"
    assert repair(df.limit(0)).collect() == [] and damage(df.limit(0)).collect() == []


def test_messages(spark):
    df = spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "assistant", "b."), (1, 2, "tool", "c")], "conv_id long, turn long, role string, text string")
    rows = [tuple(r)[1:] for r in repair(df, messages=True).collect()]
    summary = repair(df).first()
    assert summary.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in sorted(rows)).encode()).hexdigest()
    assert "".join(e for _, e, _, _ in sorted(rows)) == summary.audit.replace("D", "")


def test_search_of_a_part_goes_to_its_goal():
    rows = [("u", ""), ("u", "t")]
    assert search(rows, {START: (0, "")}, [ASSISTANT]) == min((2 + 1, "KR"), (0 + 3 + 2, "KDI"), (0 + 2 + 3, "KID"))
    assert search(rows, {START: (0, "")}, [SYSTEM]) is None and search([], {START: (4, "x")}, [START]) == (4, "x")


def test_audits_of_equal_cost():
    assert search([("a", ""), ("u", "")], {START: (0, "")}) == (4, "IKKI")
    assert search([("s", "t")], {START: (0, "")}) == (3, "D")
    assert search([("a", "")], {START: (0, "")}) == (2, "IK")
