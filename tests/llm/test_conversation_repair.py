import hashlib
import itertools
import random
import re
import zlib

import pytest

from weftarc.llm import conversation_repair as cr
from weftarc.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, there boolean, part long"
SPACE = " \t\n\v\f\r"


def faults(rows):
    met, out = set(), []
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in met else "truncated" if bare[-1] not in ".!?" else "")
        met.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, turns) by going edit by edit with whole audit strings; a state is the last initial ('' at first)."""
    ok = lambda a, b: b == "s" and a == "" or b == "u" and a in ("", "s", "a") or b == "a" and a == "u"
    names = {"u": "user", "a": "assistant"}

    def with_inserts(layer):
        for _ in range(4):
            for a, (cost, audit, turns) in list(layer.items()):
                for b in "ua":
                    if ok(a, b):
                        layer[b] = min(layer.get(b, (1e9,)), (cost + 2, audit + "I", turns + ((names[b], ""),)))
        return layer

    layer = with_inserts({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        new = {}
        for a, (cost, audit, turns) in layer.items():
            options = [(a, cost + 3, "D", ())]
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                options += [(b, cost + 2 + late, "R", ((names[b], text),)) for b in "ua" if ok(a, b)]
                if ok(a, role[:1]):
                    options.append((role[:1], cost + late, "K", ((role, text),)))
            for b, c, edit, more in options:
                new[b] = min(new.get(b, (1e9,)), (c, audit + edit, turns + more))
        layer = with_inserts(new)
    return min(layer[a] for a in ("", "a") if a in layer)


def brute(rows):
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, kept = cheapest(rows)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def some(rng, n):
    role = lambda: rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""])
    return [(rng.choice([None, *range(2 * n)]), role(), rng.choice(["Yes.", "no", " \n", "", "What?", "é\x85", "Long! " * 9, "cut, "])) for _ in range(n)]


def test_cheapest_edits():
    rng = random.Random(1)
    conversations = [in_order(some(rng, rng.randrange(12))) for _ in range(800)]
    for rows, got in zip(conversations, cr.repaired(conversations), strict=True):
        text = "\n".join(f"{t['role']}:{t['text']}" for t in got["turns"])
        assert (*(got[c] for c in cr.COUNTS), got["audit"], hashlib.sha256(text.encode()).hexdigest()) == brute(rows)
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in got["turns"]))


def test_no_string_of_edits_is_better():
    """Against all strings of up to five edits on conversations of two turns."""
    names = {"u": "user", "a": "assistant"}
    for roles in itertools.product(["system", "user", "assistant"], repeat=2):
        rows = [(0, roles[0], "Yes."), (1, roles[1], "no")]
        best = (1e9,)
        for n in range(6):
            for audit in itertools.product("DIKR", repeat=n):
                if sum(e != "I" for e in audit) != 2:
                    continue
                for filled in itertools.product("ua", repeat=audit.count("I") + audit.count("R")):
                    given, at, initials, cost = iter(filled), 0, "", 0
                    for e in audit:
                        initials += next(given) if e in "IR" else rows[at][1][0] if e == "K" else ""
                        cost += {"D": 3, "I": 2, "K": 0, "R": 2}[e] + (e in "KR" and at == 1)
                        at += e != "I"
                    if re.fullmatch("(s?(ua)+)?", initials):
                        best = min(best, (cost, "".join(audit)))
        got = cr.repaired([rows])[0]
        assert (got["cost"], got["audit"]) == best and names


@pytest.mark.parametrize("limits", [(4096, 4 << 20, 8192), (3, 4 << 20, 5), (4096, 8, 1)])
def test_conversations_in_segments(spark, monkeypatch, limits):
    monkeypatch.setattr(cr, "SEGMENT_ROWS", limits[0])
    monkeypatch.setattr(cr, "SEGMENT_BYTES", limits[1])
    monkeypatch.setattr(cr, "BATCH_ROWS", limits[2])
    rng = random.Random(2)
    of = {i: some(rng, rng.randrange(9)) for i in [*range(40), None]} | {7: some(rng, 300), 8: [(None, "user", "Same.")] * 90, 9: [(1, "user", "x" * 100_000 + "."), (1, "user", "x" * 100_000 + ".")]}
    rows = [(i, *r, True, 5) for i, rs in of.items() for r in rs] + [(i, None, "x", "x", False, 5) for i in of]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in cr.by_conversation(cr.repair(turns)).collect()}
    assert got == {i: brute(in_order(rs)) for i, rs in of.items()}


def test_nulls_and_an_empty_table(spark):
    rows = [(1, 0, None, None, True, 0), (1, None, "user", "Hm.", True, 0), (2, None, None, "x", False, 0)]
    got = {r.conv_id: tuple(r)[1:] for r in cr.by_conversation(cr.repair(spark.createDataFrame(rows, SCHEMA))).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {1: brute([(None, "user", "Hm."), (0, " ", " ")]), 2: (0, 0, 0, 0, 0, 0, "", empty)}
    assert cr.by_conversation(cr.repair(spark.createDataFrame([], SCHEMA))).count() == 0
    nothing = spark.createDataFrame([(None, None, None, None, "x")], "conv_id long, turn long, role string, text string, there string")
    assert [r.there for r in cr.damaged(nothing).collect()] == [zlib.crc32(b" : ") % 20 != 0] * (1 + (zlib.crc32(b" : ") % 20 == 3))


def test_the_query_against_brute_force(spark):
    of = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect():
        rows, fault, role, text = of.setdefault(r.conv_id, []), zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20, r.role, r.text
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            rows += [(r.turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    want = {i: brute(in_order(rows)) for i, rows in of.items()}
    assert {r.conv_id: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, "/root/testdata/sf0.01").collect()} == want
