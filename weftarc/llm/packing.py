"""Mixture-controlled packing of tokenised documents into windows by deficit round-robin over source queues.

Every source is a queue of tokens. For each window a queue is granted its share of the window; what it was granted and
has not been served is its deficit, which is carried on. In turn, each queue is served in packets of ``PACKET`` tokens
while its deficit has room for one, and what is then still free in a window goes to the largest deficits, so every
window is full and no queue is ever ahead of or behind its share by more than a few packets. By default the
shares are the corpus' own, so the mixture is the same from the first window to the last; with ``targets`` a queue that
runs dry leaves and the others share its room.

Grants of whole periods of windows are whole packets, so deficits are zero between periods and the schedule of one
period holds for all of a phase, until a queue has less left than a period takes. A schedule is therefore a short list
of phases, whatever the size of the corpus, and a task can tell from a token's place in its queue which window it goes
to: a partition begins with just the deficits that the schedule has at its first token. Places in queues are
prefix sums of the tokens that each task has of each queue.

Scale: documents are tokenised once and stored with the tokens of their queue that come before them in their task; sums
by task and queue (a row for each pair) make the places; then all pieces are cut in one pass, without a shuffle of
texts or ids. A source with a third of all rows is only a queue that is served more. A task holds ``SLICE_BYTES`` of
texts and their ids, and a text that is longer than that alone. The ``MAX_QUEUES - 1`` sources with most rows have queues of
their own, all others share one; no row is left out.

Edge cases: a null or empty text is only its end token. A null source is a source. Rows with equal doc_id are packed
each on its own. An empty table gives none. Of the end, the tokens that fill no window go to sequences whose lengths are
powers of two, which need no padding. Only doc_id, text and source are read, so other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftarc.llm import bpe, flat
from weftarc.llm.bpe_codec import encode_batch
from weftarc.llm.scratch import stored

WINDOW = 1024
PACKET = 128
#: Windows of a period; shares are met to a packet in a period.
PERIOD = 256
MAX_QUEUES = 256
END_ID = 0
SLICE_BYTES = 4 << 20
#: Rows of places (task and queue) up to which they are sent to every executor, about 30 bytes each.
MAX_BROADCAST_ROWS = 1 << 20


def round_robin(amounts: np.ndarray, window: int = WINDOW, packet: int = PACKET) -> np.ndarray:
    """The tokens of each queue in each window, until ``amounts`` of every queue are served; only the last window can be short."""
    total, n = int(amounts.sum()), len(amounts)
    left, share = amounts.astype(object), amounts.astype(object)
    deficit = np.zeros(n, object)  # in parts of a token: a token is ``total`` of them
    rows, at = [], 0
    while at < total:
        space = min(window, total - at)
        at += space
        deficit += share * space
        row = np.zeros(n, np.int64)
        for q in np.roll(np.arange(n), -len(rows)):
            if space and left[q]:
                whole = deficit[q] // (total * packet) * packet
                take = left[q] if deficit[q] >= left[q] * total else max(0, whole)
                take = min(take, left[q], space)
                row[q], space = take, space - take
                left[q] -= take
                deficit[q] -= take * total
        while space:
            q = max((q for q in range(n) if left[q]), key=lambda q: (deficit[q], -q))
            take = min(packet, space, left[q])
            row[q], space = row[q] + take, space - take
            left[q] -= take
            deficit[q] -= take * total
        rows.append(row)
    return np.array(rows, np.int64).reshape(len(rows), n)


@dataclass
class Phase:
    """``periods`` repetitions of the windows in ``served`` (window, queue), the first of them window ``window``; ``start``: of each queue."""

    window: int
    periods: int
    start: np.ndarray
    served: np.ndarray


def _period(left: np.ndarray, weights: np.ndarray, window: int, packet: int, period: int) -> np.ndarray:
    """What each queue gives to a period, in whole packets: its share by largest remainder, one packet at least if it has one."""
    packets = period * window // packet
    there = left >= packet
    w = np.where(there, weights, 0).astype(np.float64)
    if not w.sum():
        w = there.astype(np.float64)
    ideal = np.maximum(w / w.sum() * packets, np.where(w > 0, 1, 0))
    of = np.floor(ideal).astype(np.int64)
    order = np.argsort(of - ideal, kind="stable")
    for q in order[: max(0, packets - int(of.sum()))]:
        of[q] += w[q] > 0
    largest = int(np.argmax(of))
    of[largest] += packets - int(of.sum())
    return of * packet


def schedule(totals: np.ndarray, weights: np.ndarray | None = None, window: int = WINDOW, packet: int = PACKET, period: int = PERIOD) -> list[Phase]:
    """The phases in which queues of ``totals`` tokens go to windows; by ``weights``, else by what they have left."""
    left, start = totals.astype(np.int64), np.zeros(len(totals), np.int64)
    phases, at, size = [], 0, period * window
    while left.sum() > size and (left >= packet).any():
        amounts = _period(left, left if weights is None else weights, window, packet, period)
        some = amounts > 0
        n = int((left[some] // amounts[some]).min())
        if n == 0:  # a queue ends in this period: others give what it lacks
            amounts, n = np.minimum(amounts, left), 1
            for q in np.argsort(amounts - left, kind="stable"):
                amounts[q] += min(size - int(amounts.sum()), int(left[q] - amounts[q]))
        phases.append(Phase(at, n, start.copy(), round_robin(amounts, window, packet)))
        at += n * period
        start += n * amounts
        left -= n * amounts
    if left.sum():
        phases.append(Phase(at, 1, start, round_robin(left, window, packet)))
    return phases


class Places:
    """Where the tokens of a queue go."""

    def __init__(self, phases: list[Phase], window: int = WINDOW):
        self.window = window
        self.of: dict[int, list[tuple]] = {}
        self.full, tail = 0, 0  # full windows; tokens of the last, short one
        for p in phases:
            offset = np.cumsum(p.served, axis=1) - p.served
            sizes = p.served.sum(axis=1)
            self.full += int((sizes == window).sum()) * p.periods
            tail += int(sizes[sizes < window].sum())
            for q in np.flatnonzero(p.served.any(axis=0)).tolist():
                in_windows = np.flatnonzero(p.served[:, q])
                edges = np.concatenate(([0], np.cumsum(p.served[in_windows, q])))
                self.of.setdefault(q, []).append((int(p.start[q]), int(p.start[q] + edges[-1] * p.periods), edges, p.window + in_windows, offset[in_windows, q], len(p.served)))
        self.tail_cuts = np.concatenate(([0], np.cumsum([1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]))).astype(np.int64)

    def pieces(self, queue: int, first: np.ndarray, last: np.ndarray):
        """(row, start in the row, length, sequence, offset) of the tokens from ``first`` to before ``last`` of the queue, for each row."""
        parts = []
        for begin, end, edges, windows, offsets, n_windows in self.of.get(queue, ()):
            rows = np.flatnonzero((first < end) & (last > begin))
            if not len(rows):
                continue
            size, n = int(edges[-1]), len(windows)
            lo, hi = np.maximum(first[rows], begin) - begin, np.minimum(last[rows], end) - begin
            run = lambda x: x // size * n + np.searchsorted(edges, x % size, "right") - 1
            g0, g1 = run(lo), run(hi - 1)
            counts = g1 - g0 + 1
            own = np.repeat(np.arange(len(rows)), counts)
            g = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + g0[own]
            at = g // n * size + edges[g % n]
            start, stop = np.maximum(at, lo[own]), np.minimum(g // n * size + edges[g % n + 1], hi[own])
            parts.append((rows[own], start + begin - first[rows[own]], stop - start, windows[g % n] + g // n * n_windows, offsets[g % n] + start - at))
        if not parts:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        return self._short_end(*(np.concatenate(c) for c in zip(*parts, strict=True)))

    def _short_end(self, row, start, length, sequence, offset):
        """The pieces with those of the last, short window dealt over sequences of powers of two."""
        short = sequence == self.full
        if not short.any():
            return row, start, length, sequence, offset
        cut = []
        for r, s, n, o in zip(row[short].tolist(), start[short].tolist(), length[short].tolist(), offset[short].tolist(), strict=True):
            for k in range(len(self.tail_cuts) - 1):
                a, b = max(o, int(self.tail_cuts[k])), min(o + n, int(self.tail_cuts[k + 1]))
                if a < b:
                    cut.append((r, s + a - o, b - a, self.full + k, a - int(self.tail_cuts[k])))
        return tuple(np.concatenate((x[~short], np.array(y, np.int64))) for x, y in zip((row, start, length, sequence, offset), zip(*cut, strict=True), strict=True))


def _tokenised(path: str):
    """A function of Arrow batches (doc_id, text, queue): with the task, the queue's tokens before each row there, its tokens, and its ids as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, part, met = bpe.WordStore(bpe.load(path)), TaskContext.get().partitionId(), np.zeros(MAX_QUEUES, np.int64)
        for batch in batches:
            text = batch.column("text")
            for lo, hi, _, _ in flat.slices(text, SLICE_BYTES):
                ids = encode_batch(text.slice(lo, hi - lo), store)
                offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy()
                n = np.diff(offsets) + 1
                flat_ids = np.insert(values, offsets[1:], END_ID).astype("<u4")
                ends = np.concatenate(([0], np.cumsum(n)))
                queue = batch.column("queue").slice(lo, hi - lo)
                at = queue.to_numpy(zero_copy_only=False)
                before = np.zeros(len(n), np.int64)
                for q in np.unique(at):
                    mine = at == q
                    before[mine] = met[q] + np.cumsum(n[mine]) - n[mine]
                    met[q] += n[mine].sum()
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends * 4), pa.py_buffer(flat_ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), queue, pa.array(np.full(len(n), part, np.int32)), pa.array(before), pa.array(n.astype(np.int64)), data],
                    names=["doc_id", "queue", "part", "before", "doc_tokens", "ids"],
                )

    return run


def _queues(docs: DataFrame) -> list:
    """The sources with queues of their own, those with most rows first; at most ``MAX_QUEUES - 1``."""
    counted = docs.groupBy("source").count().orderBy(F.desc("count"), F.col("source").asc_nulls_first()).limit(MAX_QUEUES - 1)
    return [r["source"] for r in counted.collect()]


def pack(docs: DataFrame, path: str, targets: dict | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of ``docs`` (doc_id, text, source).

    ``path``: a tokenizer file that ``bpe.load`` reads, on every machine. ``targets``: weights by source; without it the
    corpus' own shares hold. Sources that it does not name, and those that share a queue, have weight 0: they come last.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "source")
    sources = _queues(docs)
    named = spark.createDataFrame(list(zip(sources, range(len(sources)), strict=True)), docs.select(F.col("source").alias("named"), F.lit(0).alias("queue")).schema)
    dealt = docs.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("named")), "left").select("doc_id", "text", F.coalesce("queue", F.lit(MAX_QUEUES - 1)).alias("queue"))
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, queue int, part int, before long, doc_tokens long, ids binary"
    coded = stored(dealt.mapInArrow(_tokenised(path), kinds), "packing-ids")
    sums = stored(coded.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("n")), "packing-sums")
    earlier = F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")  # a row for each task
    places = sums.select(F.col("queue").alias("of_queue"), F.col("part").alias("of_part"), earlier.alias("base"))
    totals = np.zeros(MAX_QUEUES, np.int64)
    for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect():
        totals[r["queue"]] = r["n"]
    weights = None if targets is None else np.array([targets.get(s, 0) for s in sources] + [0] * (MAX_QUEUES - len(sources)), np.float64)
    where = Places(schedule(totals, weights))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queue, first, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("queue", "first", "doc_tokens"))
            ids = [v.as_buffer() for v in batch.column("ids")]
            for q in np.unique(queue).tolist():
                mine = np.flatnonzero(queue == q)
                row, start, length, sequence, offset = where.pieces(q, first[mine], first[mine] + n[mine])
                row = mine[row]
                crc = [zlib.crc32(ids[r][4 * a : 4 * (a + b)]) for r, a, b in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                columns = [batch.column("doc_id").take(pa.array(row))] + [pa.array(x, pa.int64()) for x in (start, length, crc, n[row], sequence, offset)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    few = sums.count() <= MAX_BROADCAST_ROWS
    at = coded.join(F.broadcast(places) if few else places, (F.col("queue") == F.col("of_queue")) & (F.col("part") == F.col("of_part")))
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return at.select("doc_id", "queue", (F.col("base") + F.col("before")).alias("first"), "doc_tokens", "ids").mapInArrow(cut, out)
