"""Conversation repair: the streaming search against all strings of edits, the tables against SQL."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from trendspark.llm import conversations as c

DATA = "/root/testdata/sf0.001"
ROW = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """(cost, edits, repaired lines): the shortest path over (rows used, role initials so far by the pattern), strings compared as a whole."""
    nexts = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, at, last, out = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, edits, list(out)
        if (at, last, edits) in seen or edits.endswith("III"):
            continue
        seen.add((at, last, edits))
        for to in ("user", "assistant"):
            if to[0] in nexts[last]:
                heapq.heappush(heap, (cost + 3, edits + "I", at, to[0], (*out, f"{to}:")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, edits + "D", at + 1, last, out))
            if fault in ("", "truncated"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[:1] in nexts[last]:
                    heapq.heappush(heap, (cost + more, edits + "K", at + 1, role[:1], (*out, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    if to[0] in nexts[last]:
                        heapq.heappush(heap, (cost + 3 + more, edits + "R", at + 1, to[0], (*out, f"{to}:{text}")))


def test_search_is_cheapest_and_least():
    rng = random.Random(3)
    for _ in range(300):
        rows = [(rng.choice(["system", "user", "assistant", "tool", " ", ""]), f"t{i}", rng.choice(["", "", "truncated", "blank", "duplicate"])) for i in range(rng.randint(0, 5))]
        out, edits = [], []

        def emit(state, labels, row):
            edits.append(labels)
            out.extend(f"{role}:{text}" for e, role, text, _ in c.applied(state, labels, row) if e != "D")

        search = c.Search(emit)
        for role, text, fault in rows:
            search.step(role[:1], fault, (None, role, text))
        cost = search.end()
        assert (cost, "".join(edits), out) == brute(rows)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in out))


def test_memory_is_bounded():
    """Edits leave as survivors coalesce: what is held doesn't grow with the conversation, and ties that stay open are right."""
    rng, seen = random.Random(5), []
    search, most = c.Search(lambda state, labels, row: seen.append(labels)), 0
    for i in range(20_000):
        search.step(rng.choice("uaaust"), rng.choice(["", "", "", "truncated", "blank"]), (i, "user", "x"))
        most = max(most, search.size())
    assert most < 200 and len(seen) > 19_000
    search.end()
    assert sum(len(x.replace("I", "")) for x in seen) == 20_000


def by_hand(rows):
    """Summaries of (conv, turn, role, text) rows, straight from the definitions."""
    out = []
    key = lambda r: (r[0] is not None, r[0] or 0)
    for conv, group in groupby(sorted(rows, key=key), key=key):
        group = sorted(((t, r, x) for _, t, r, x, gone in group if not gone), key=lambda g: (g[0] is not None, g[0] or 0, g[1], g[2]))
        faulty, seen = [], set()
        for t, r, x in group:
            bare = x.rstrip(" \t\n\x0b\x0c\r")
            faulty.append((r, x, "blank" if not bare else "duplicate" if (r, x) in seen else "" if bare[-1] in ".!?" else "truncated"))
            seen.add((r, x))
        turns = [t for t, *_ in group if t is not None]
        cost, edits, lines = brute(faulty)
        out.append((conv[1] if conv[0] else None, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[sum(f == k for *_, f in faulty) for k in ("blank", "duplicate", "truncated")],
                    sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(group, group[1:])), cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, None, "system", "Rules."), (1, 5, "user", "Hi."), (1, 5, "user", "Hi."),
    (2, None, None, None), (2, None, "user", None), (3, 3, "user", " \n\t"), (None, 1, "user", "No key."), (None, None, "assistant", "At all!"),
    (4, 7, "assistant", "é漢😀?"), (4, 7, "assistant", "z"), (4, 7, "", ""), (5, 1, "user", "long. " * 50_000), (5, 2, "assistant", "x" * 300_000),
    (-6, -9, "tool", "A tool."), (-6, -3, "System", "S."), (7, 2**62, "user", "Far."), (7, -5, "assistant", "Near\xa0"),
]


def test_odd_rows(spark):
    """Nulls in every column, ties of turns, blank, long and foreign texts, unknown roles, columns with clashing names."""
    df = spark.createDataFrame(ODD, ROW).withColumns({"conv": F.lit(1), "fault": F.lit("x"), "absent": F.lit(True), "nth": F.lit(0), "step": F.lit(2)})
    got = sorted((tuple(r) for r in c.audit(df).collect()), key=str)
    want = by_hand([(a, b, " " if r is None else r, " " if t is None else t, False) for a, b, r, t in ODD])
    assert got == sorted(want, key=str)
    edits = c.repair(df).collect()
    for conv, *_, audit, digest in got:
        own = sorted((r for r in edits if r.conv_id == conv), key=lambda r: r.step)
        assert "".join(r.edit for r in own) == audit and [r.step for r in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own if r.edit != "D").encode()).hexdigest() == digest
        assert all((r.role is None) == (r.edit == "D") and (r.old_role is None) == (r.edit == "I") for r in own)


def test_absent_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", True), (2, 0, "user", "Hi.", False), (2, 1, "user", "Hi.", True), (2, 2, "user", "Hi.", None)], ROW + ", gone boolean")
    got = sorted(tuple(r) for r in c.audit(df, absent_col="gone").collect())
    assert got == by_hand([(1, 0, "user", "Hi.", True), (2, 0, "user", "Hi.", False), (2, 1, "user", "Hi.", True), (2, 2, "user", "Hi.", False)])
    assert got[0][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert c.audit(df.limit(0)).collect() == [] and c.repair(df.limit(0)).collect() == []


def test_a_conversation_of_many_rows(spark):
    """Streams through one task in batches; string keys."""
    rng = random.Random(1)
    rows = [("hot", i, rng.choice(["user", "assistant"]), rng.choice(["Fine.", f"Row {i}.", "cut"])) for i in range(30_000)]
    df = spark.createDataFrame(rows, ROW.replace("conv_id bigint", "conv_id string"))
    (r,) = c.audit(df).collect()
    assert len(r.audit.replace("I", "")) == 30_000 and r.duplicate == sum(n - 1 for n in Counter((x[2], x[3]) for x in rows).values())
    assert c.repair(df).count() == len(r.audit)


def damage_by_hand(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)


@pytest.mark.parametrize("odd", [True, False])
def test_query(spark, tmp_path, odd):
    """On the smallest table, and on odd rows with every kind of damage."""
    if odd:
        rng = random.Random(2)
        rows = [*ODD, *[(rng.choice([None, *range(20)]), rng.choice([None, *range(6)]), rng.choice([None, "user", "assistant", "system"]), rng.choice([None, "", "A.", "b", "C! d", "e?\n"])) for _ in range(150)]]
        rows = [r for r in rows if len(r[3] or "") < 1000 and (r[0] or 0) >= 0]
        at = str(tmp_path)
        spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(f"{at}/conversations.parquet")
    else:
        at = DATA
        rows = [tuple(r) for r in spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in c.query(spark, at).collect()), key=str)
    if not odd:
        assert got == sorted(by_hand(list(damage_by_hand(rows))), key=str)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{at}/conversations.parquet{'/*.parquet' if odd else ''}'")
    want = con.sql(c.ORACLE)
    assert want.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got == sorted(want.fetchall(), key=str)
