"""Repair of conversations: the cheapest edits after which roles follow one another as they should.

Per turn an edit keeps it, deletes it (blank and repeated turns must go) or gives it another role, after any inserted
turns. A run of inserts with the turn's own edit is one macro edit, written as the run's I's and then K, D or R. No such
code begins another, and codes are ordered as their letters are, so audits of as many turns compare code by code. The
dynamic program has a layer for each turn and a state for each way in which roles can go on (nothing yet, after s, u or
a). Instead of audit strings a layer holds each state's cost and the rank of its audit among those of the layer: a new
audit's rank follows from its parent's rank and its code. A byte for each state and turn points to parent and code,
and the one audit that is wanted is put together backwards. Conversations go through the layers together, as arrays.

Scale: turns are dealt by ranges of (conversation, turn, role, text) and sorted; a task goes through its range and holds one
Arrow batch and ``BATCH_ROWS`` turns of whole conversations. A conversation that lies in several ranges, or has more than
``SEGMENT_ROWS`` turns or ``SEGMENT_BYTES``, is gone through in segments, whose programs are run from all four states
at once: four costs and ranks for each are all that the steps between segments need, so a conversation with a third
of all turns is worked on by as many tasks as it has segments. Only its audit, which is one value of the result, and its
hash, which takes the text from the front, come together in one task, segment after segment.

Edge cases: nulls of role and text count as one space; null turns come first and a null conv_id is a conversation. Turns with equal
numbers are in the order of role and text; equal rows are repeats. A role with another (or no) first letter cannot be
kept. Very long texts go through whole. An empty table gives none. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftarc.llm.scratch import stored

SEGMENT_ROWS, SEGMENT_BYTES = 4096, 4 << 20
BATCH_ROWS = 8192
SPACE = " \t\n\v\f\r"

INSERT_COST, REROLE_COST, DELETE_COST, TRUNCATED_COST = 2, 2, 3, 1
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state after another turn, by its initial (s, u, a, any other); None where it cannot follow.
FOLLOWS = ((AFTER_S, AFTER_U, None, None), (None, AFTER_U, None, None), (None, None, AFTER_A, None), (None, AFTER_U, None, None))
#: The state after the turn that is inserted or given a role: the one role that can follow of user and assistant.
FILLED = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: Inserts after the last turn, by state, until a conversation may end.
ENDING = (0, 2, 1, 0)
LEGAL = {"su", "ua", "au"}
CODES = sorted("I" * k + t for k in range(3) for t in "DKR")
_FAR = 1 << 40


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(state, cost) after each code, by class of the turn (initial * 4 + must go * 2 + truncated) and state; state -1: not possible."""
    after, cost = np.full((16, 4, len(CODES)), -1, np.int8), np.full((16, 4, len(CODES)), _FAR, np.int64)
    for of in range(16):
        initial, must_go, truncated = of >> 2, of >> 1 & 1, of & 1
        for state in range(4):
            for c, code in enumerate(CODES):
                at, n = state, len(code) - 1
                for _ in range(n):
                    at = FILLED[at]
                to = {"D": at, "K": FOLLOWS[at][initial], "R": FILLED[at]}[code[-1]]
                if to is None or (must_go and code[-1] != "D"):
                    continue
                after[of, state, c] = to
                cost[of, state, c] = n * INSERT_COST + {"D": DELETE_COST, "K": 0, "R": REROLE_COST}[code[-1]] + (code[-1] != "D" and truncated) * TRUNCATED_COST
    return after, cost


_AFTER, _COST = _tables()


class Layers:
    """The program over many sequences of turns at once: sequence k has the classes from ``first[k]`` on, ``size[k]`` of them, and begins in ``start[k]``."""

    def __init__(self, classes: np.ndarray, first: np.ndarray, size: np.ndarray, start: np.ndarray):
        self.order = np.argsort(-size, kind="stable")
        self.first, sizes, n = first[self.order], size[self.order], len(size)
        self.pointers: list[np.ndarray] = []
        cost, rank = np.full((n, 4), _FAR, np.int64), np.zeros((n, 4), np.int64)
        cost[np.arange(n), start[self.order]] = 0
        for layer in range(int(sizes[0]) if n else 0):
            m = int(np.searchsorted(-sizes, -layer, "left"))  # sequences with a turn here
            of = classes[self.first[:m] + layer]
            # cost, then the parent's rank, then the code: one number that is compared as these three are
            key = ((cost[:m, :, None] + _COST[of]) << 6) + (rank[:m, :, None] << 4) + np.arange(len(CODES))
            after = _AFTER[of]
            best, pointer = np.empty((m, 4), np.int64), np.empty((m, 4), np.uint8)
            for state in range(4):
                keys = np.where(after == state, key, _FAR << 6).reshape(m, -1)
                pointer[:, state] = keys.argmin(axis=1)
                best[:, state] = keys[np.arange(m), pointer[:, state]]
            there = best < _FAR << 6
            cost[:m] = np.where(there, best >> 6, _FAR)
            audit = np.where(there, best & 63, 64)
            rank[:m] = (audit[:, None, :] < audit[:, :, None]).sum(axis=2)
            self.pointers.append(pointer)
        self.cost, self.rank = np.empty_like(cost), np.empty_like(rank)
        self.cost[self.order], self.rank[self.order] = cost, rank

    def codes(self, end: np.ndarray, n: int) -> np.ndarray:
        """The code of each of ``n`` turns, where each sequence ends in its state of ``end``."""
        out, state = np.zeros(n, np.int8), end[self.order].copy()
        for layer in range(len(self.pointers) - 1, -1, -1):
            m = len(self.pointers[layer])
            p = self.pointers[layer][np.arange(m), state[:m]]
            out[self.first[:m] + layer] = p % len(CODES)
            state[:m] = p // len(CODES)
        return out


def _best_end(cost: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state, cost) of the cheapest complete audits, of equal ones the least."""
    total = cost + np.array(ENDING) * INSERT_COST
    state = ((total << 3) + rank).argmin(axis=1)
    return state, total[np.arange(len(total)), state]


class Faults:
    """What is wrong with a run of turns (turn, role, text), with their classes; ``repeats``: places of repeats, else they are sought."""

    def __init__(self, rows: list[tuple], repeats: set[int] | None = None):
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.classes = []
        met, before = set(), None
        for k, (_, role, text) in enumerate(rows):
            initial = role[:1]
            if before is not None and before + initial not in LEGAL:
                self.illegal += 1
            before = initial
            bare = text.rstrip(SPACE)
            repeat = (role, text) in met if repeats is None else k in repeats
            if repeats is None:
                met.add((role, text))
            must_go, truncated = not bare or repeat, False
            if not bare:
                self.blank += 1
            elif repeat:
                self.duplicate += 1
            elif bare[-1] not in ".!?":
                self.truncated += 1
                truncated = True
            self.classes.append((("sua".find(initial) if initial else -1) % 4) * 4 + must_go * 2 + truncated)
        turns = [t for t, _, _ in rows if t is not None]
        self.first, self.last, self.turns = (turns[0], turns[-1], len(set(turns))) if turns else (None, None, 0)

    @property
    def gaps(self) -> int:
        return self.last - self.first + 1 - self.turns if self.turns else 0


def edited(rows: list[tuple], codes: list[int], state: int, ending: int) -> tuple[str, list[dict]]:
    """(audit, turns) of a run of turns that begins in ``state``, with ``ending`` inserts at its end."""
    out, audit = [], [CODES[c] for c in codes] + ["I" * ending]

    def fill(text: str) -> None:
        nonlocal state
        out.append({"role": "assistant" if FILLED[state] == AFTER_A else "user", "text": text})
        state = FILLED[state]

    for (_, role, text), code in zip(rows, audit, strict=False):
        for _ in code[:-1]:
            fill("")
        if code[-1] == "R":
            fill(text)
        elif code[-1] == "K":
            out.append({"role": role, "text": text})
            state = FOLLOWS[state]["sua".find(role[:1])]
    for _ in range(ending):
        fill("")
    return "".join(audit), out


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TURNS = "array<struct<role: string, text: string>>"
_ROWS = "array<struct<turn: long, role: string, text: string>>"
_ARROW = [
    ("part", pa.int32()), ("seq", pa.int32()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
    ("open_rows", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))),
]
_SPARK = f"part int, seq int, {', '.join(c + ' long' for c in COUNTS)}, audit string, turns {_TURNS}"


def repaired(conversations: list[list[tuple]]) -> list[dict]:
    """Counts, audit and turns of whole conversations of sorted (turn, role, text)."""
    faults = [Faults(rows) for rows in conversations]
    size = np.array([len(rows) for rows in conversations], np.int64)
    first = np.cumsum(size) - size
    classes = np.array([c for f in faults for c in f.classes], np.int64)
    layers = Layers(classes, first, size, np.full(len(size), NOTHING))
    ends, costs = _best_end(layers.cost, layers.rank)
    codes = layers.codes(ends, len(classes)).tolist()
    out = []
    for rows, f, at, end, cost in zip(conversations, faults, first.tolist(), ends.tolist(), costs.tolist(), strict=True):
        audit, turns = edited(rows, codes[at : at + len(rows)], NOTHING, ENDING[end])
        out.append({"gaps": f.gaps, "blank": f.blank, "duplicate": f.duplicate, "truncated": f.truncated, "illegal": f.illegal, "cost": cost, "audit": audit, "turns": turns})
    return out


def _through_ranges(kind: pa.DataType):
    """A function of the sorted turns of a range: whole conversations repaired, and the segments of those that may go on beyond it."""
    schema = pa.schema([("conv_id", kind), *_ARROW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids, whole, open_ = [], [], []  # conversations that are complete; segments of others
        rows, bytes_, held, current, begun, at_edge = [], 0, 0, None, False, True

        def out() -> pa.RecordBatch:
            done = [{"conv_id": i, "part": part, "seq": -1, **r} for i, r in zip(ids, repaired(whole), strict=True)]
            batch = pa.RecordBatch.from_pylist(done + open_, schema)
            ids.clear(), whole.clear(), open_.clear()
            return batch

        def segment() -> None:
            nonlocal seq, rows, bytes_
            open_.append({"conv_id": current, "part": part, "seq": seq, "open_rows": [{"turn": t, "role": r, "text": x} for t, r, x in rows]})
            seq, rows, bytes_ = seq + 1, [], 0

        for batch in batches:
            for conv, turn, role, text, there in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "there")), strict=True):
                if not begun or conv != current:
                    if begun and at_edge:
                        segment()
                    elif begun:
                        ids.append(current), whole.append(rows)
                        rows, bytes_ = [], 0
                    at_edge, begun, current = not begun, True, conv
                if there:
                    rows.append((turn, role, text))
                    bytes_ += len(text)
                    held += len(text) // 512 + 1
                    if len(rows) >= SEGMENT_ROWS or bytes_ >= SEGMENT_BYTES:
                        segment()
                        at_edge = True
                if held >= BATCH_ROWS:
                    yield out()
                    held = 0
        if begun:
            segment()
        yield out()

    return run


def _judged(rows: list[dict], repeats: list[int] | None) -> tuple[list[tuple], Faults]:
    """The turns of a segment, and their faults where the places of repeats are known."""
    rows = [(r["turn"], r["role"], r["text"]) for r in rows]
    return rows, Faults(rows, set(repeats or ()))


_SUMMARY = "part int, seq int, costs array<long>, ranks array<long>, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, n_turns long, initials array<string>"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the steps between segments need of each: costs and ranks from all four states to all four."""
    for batch in batches:
        out = []
        for conv, part, seq, rows, repeats in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "seq", "open_rows", "repeats")), strict=True):
            rows, f = _judged(rows, repeats)
            n = len(rows)
            layers = Layers(np.array(f.classes, np.int64), np.zeros(4, np.int64), np.full(4, n), np.arange(4))
            out.append({
                "conv_id": conv, "part": part, "seq": seq, "costs": layers.cost.ravel().tolist(), "ranks": layers.rank.ravel().tolist(), "blank": f.blank, "duplicate": f.duplicate, "truncated": f.truncated,
                "illegal": f.illegal, "first_turn": f.first, "last_turn": f.last, "n_turns": f.turns, "initials": [rows[0][1][:1], rows[-1][1][:1]] if rows else [],
            })
        kind = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("part", pa.int32()), ("seq", pa.int32()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "n_turns")], ("initials", pa.list_(pa.string()))])
        yield pa.RecordBatch.from_pylist(out, kind)


_PATH = f"part int, seq int, entry int, exit int, ending int, {', '.join(c + ' long' for c in COUNTS)}"


def _joined(table: pa.Table) -> pa.Table:
    """The states in which each segment of one conversation begins and ends; the conversation's counts are on its first segment."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    cost, rank = np.array([0, _FAR, _FAR, _FAR]), np.zeros(4, np.int64)
    parents = []
    for r in rows:
        costs, ranks = np.array(r["costs"]).reshape(4, 4), np.array(r["ranks"]).reshape(4, 4)
        key = (cost[:, None] + costs << 6) + (rank[:, None] << 3) + ranks
        parents.append(key.argmin(axis=0))
        best = key.min(axis=0)
        cost = np.minimum(best >> 6, _FAR)
        audit = np.where(cost < _FAR, best & 63, 64)
        rank = (audit[None, :] < audit[:, None]).sum(axis=1)
    (state,), (total,) = _best_end(cost[None, :], rank[None, :])
    ending, exits = ENDING[state], []
    for p in reversed(parents):
        exits.append(int(state))
        state = p[state]
    exits.reverse()
    counts = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
    edges = [r["initials"] for r in rows if r["initials"]]
    counts["illegal"] += sum(a[1] + b[0] not in LEGAL for a, b in zip(edges, edges[1:], strict=False))
    turned = [r for r in rows if r["n_turns"]]
    same = sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:], strict=False))
    counts["gaps"] = turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - sum(r["n_turns"] for r in turned) + same if turned else 0
    counts["cost"] = int(total)
    out = []
    for k, r in enumerate(rows):
        out.append({"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "entry": exits[k - 1] if k else NOTHING, "exit": exits[k], "ending": ending if k == len(rows) - 1 else 0, **{c: counts[c] if k == 0 else 0 for c in COUNTS}})
    kind = pa.schema([("conv_id", table.schema.field("conv_id").type), *[(c, pa.int32()) for c in ("part", "seq", "entry", "exit", "ending")], *[(c, pa.int64()) for c in COUNTS]])
    return pa.Table.from_pylist(out, kind)


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their audits and turns, between the states that are known by now."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            rows, f = _judged(r["open_rows"], r["repeats"])
            layers = Layers(np.array(f.classes, np.int64), np.zeros(1, np.int64), np.array([len(rows)]), np.array([r["entry"]]))
            audit, turns = edited(rows, layers.codes(np.array([r["exit"]]), len(rows)).tolist(), r["entry"], r["ending"])
            out.append({c: r[c] for c in ("conv_id", "part", "seq", *COUNTS)} | {"audit": audit, "turns": turns})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", batch.schema.field("conv_id").type), *_ARROW[:-1]]))


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, part, seq, the counts COUNTS, audit and turns (array of role and text) of segments of repaired conversations.

    ``turns``: conv_id, turn, role, text and there (false: only says that the conversation exists). Most conversations
    are one segment (seq -1); of others the segments, sorted by part and seq, follow one another, and their counts add up.
    """
    kind = turns.schema["conv_id"].dataType
    own = f"conv_id {kind.simpleString()}, "
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], "there")
    # the beginning of a text is in the order of texts; equal rows may part at any place
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64)), F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    arrow = rows.select("conv_id").limit(0).toArrow().schema.field(0).type
    passed = stored(ranged.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_through_ranges(arrow), own + _SPARK + f", open_rows {_ROWS}"), "repair-ranges")
    done = passed.filter("seq < 0").drop("open_rows")
    parts = passed.filter("seq >= 0").select("conv_id", "part", "seq", "open_rows")
    said = parts.select("conv_id", "part", "seq", F.posexplode("open_rows").alias("at", "row"))
    place = F.struct("part", "seq", "at")
    said = said.select("conv_id", "part", "seq", "at", F.sha2(F.concat(F.length("row.role").cast("string"), F.lit(":"), F.col("row.role"), F.col("row.text")), 256).alias("digest"))
    firsts = said.groupBy("conv_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").withColumnsRenamed({"conv_id": "of", "digest": "same"})
    later = said.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same"))).filter(place != F.col("first"))
    repeats = later.groupBy("part", "seq").agg(F.collect_list("at").alias("repeats"))
    known = stored(parts.join(repeats, ["part", "seq"], "left").select("conv_id", "part", "seq", "open_rows", "repeats"), "repair-segments")
    path = known.mapInArrow(_summaries, own + _SUMMARY).groupBy("conv_id").applyInArrow(_joined, own + _PATH).drop("conv_id")
    rebuilt = known.join(path, ["part", "seq"]).select("conv_id", "part", "seq", "open_rows", "repeats", "entry", "exit", "ending", *COUNTS)
    return done.unionByName(stored(rebuilt.mapInArrow(_rebuilt, own + _SPARK), "repair-rebuilt"))


def _lines() -> Column:
    return F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of sorted segments: sums, audits joined, and the hash of all lines, taken as they come."""
    now, totals, audits, digest, any_lines = None, None, [], None, False

    def row(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
        return pa.RecordBatch.from_pylist([{"conv_id": now[0], **totals, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}], kind)

    batch = None
    for batch in batches:
        for r in batch.to_pylist():
            if now != (r["conv_id"],):
                if now is not None:
                    yield row(batch)
                now, totals, audits, digest, any_lines = (r["conv_id"],), dict.fromkeys(COUNTS, 0), [], hashlib.sha256(), False
            for c in COUNTS:
                totals[c] += r[c]
            audits.append(r["audit"])
            if r["n"]:
                digest.update(("\n" if any_lines else "").encode() + r["lines"].encode())
                any_lines = True
    if now is not None:
        yield row(batch)


def by_conversation(segments: DataFrame) -> DataFrame:
    """conv_id, the counts COUNTS, audit and repaired_sha256 (of the lines role:text) of each conversation of ``repair``."""
    columns = ["conv_id", *COUNTS, "audit"]
    whole = segments.filter("seq < 0").select(*columns, F.sha2(_lines(), 256).alias("repaired_sha256"))
    parts = segments.filter("seq >= 0").select(*columns, "part", "seq", F.size("turns").alias("n"), _lines().alias("lines"))
    kind = f"conv_id {segments.schema['conv_id'].dataType.simpleString()}, {', '.join(c + ' long' for c in COUNTS)}, audit string, repaired_sha256 string"
    return whole.unionByName(parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_hashed, kind))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults by the CRC-32 of ``conv_id:turn``: dropped ones stay as rows that are not ``there``."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(shown("role"))
    rows = turns.select("conv_id", "turn", "role", "text", fault.alias("fault")).select("conv_id", "turn", role.alias("role"), text.alias("text"), "fault")
    copies = F.when(F.col("fault") == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.col("fault") != 0))
    return rows.select("conv_id", "turn", "role", "text", F.explode(copies).alias("there"))
