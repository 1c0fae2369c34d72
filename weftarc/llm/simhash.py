"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A text's fingerprint is one or more 64-bit words; its bytes, each with its position, are its postings. Two
fingerprints of 8 bytes that differ in at most d bits share at least 8 - d positional bytes, so pairs are
retained only if the tally of their shared bytes reaches that minimum, and are then verified by counting bits.
A list of single bytes would hold a 256th of all fingerprints; therefore a posting list is for the bytes at
a few positions together, chosen so that any pair with the minimum meets in at least one list
(``covering_positions``). There the tally over all positions is made, on arrays of many lists at once.

Scale: fingerprints are made where the texts are read; only (id, fingerprint) rows are shuffled. Equal
fingerprints are one class from the start, so copies cost nothing. A list longer than ``BLOCK`` is cut into
blocks, and the pairs of blocks are dealt over many tasks. From each list at most one link for each member
is sent on (a spanning forest of the pairs that were verified), never all pairs. Components are found by
rounds of joins (``components``); no list, class or component ever comes together in one task or the driver.

With ``Plan.similarity`` a class is of equal fingerprints and equal sets of shingles, and the components are only
groups of candidates: their members' sets of shingles meet in blocks of bounded rows and bytes, where every
candidate pair is held against the bound, and a spanning forest of the pairs that pass is sent on
(``verified_links``). What passes depends on the two texts alone, never on a third one.

Edge cases: words are runs of anything but ASCII white space; A-Z are lower-cased. A text with fewer words
than a shingle has its whole sequence as its one shingle; null and texts without words have fingerprint
zero, which links like any other. Repeated rows are copies of one another. Null ids stay null and do not
name a component unless it has no other id. Columns of the input other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from weftarc.llm import flat
from weftarc.llm.components import components
from weftarc.llm.scratch import stored

SEED = 42
BLOCK = 2048
#: Rows of some longs, so at most some ten megabytes.
MAX_BROADCAST_ENDS = 200_000
#: Rows and shingles (of 8 bytes) of a block of candidates, on average; a candidate group of more has several blocks.
VERIFIED_ROWS, VERIFIED_SHINGLES = 512, 1 << 21
_LOWER = np.frombuffer(flat.LOWER, np.uint8)


@dataclass(frozen=True)
class Plan:
    """How fingerprints are made and linked.

    words: of a shingle. parts: 64-bit words of a fingerprint. lists: the byte positions of each posting list.
    min_shared: least tally of shared positional bytes. max_bits: most differing bits of linked fingerprints.
    similarity: if set, fingerprints are of a text's different shingles (by a polynomial hash instead of XXH64), and
    links are verified further, by the share of their texts' different shingles that both have. Lists are then for texts of
    about as many shingles only.
    """

    words: int
    parts: int
    lists: tuple[tuple[int, ...], ...]
    min_shared: int
    max_bits: int
    similarity: float | None = None


def covering_positions() -> tuple[tuple[int, ...], ...]:
    """20 triples of 8 positions; any 4 positions hold one: triples in one of three groups, or of two of one and one of the next."""
    groups = ((0, 1, 2), (3, 4, 5), (6, 7))
    of = {p: g for g, ps in enumerate(groups) for p in ps}

    def chosen(t: tuple[int, ...]) -> bool:
        counts = [sum(of[p] == g for p in t) for g in range(3)]
        return 3 in counts or any(counts[g] == 2 and counts[(g + 1) % 3] == 1 for g in range(3))

    return tuple(t for t in combinations(range(8), 3) if chosen(t))


#: 64 bits; pairs of up to 4 differing bits share at least 4 of 8 bytes, and no such pair is missed.
EXACT = Plan(words=4, parts=1, lists=covering_positions(), min_shared=4, max_bits=4)


def ring_positions(n_bytes: int, steps: tuple[int, ...]) -> tuple[tuple[int, int], ...]:
    """Pairs of positions: each with the one that lies a step further on the ring of all."""
    return tuple((p, (p + s) % n_bytes) for s in steps for p in range(n_bytes))


#: 256 bits of five-word shingles. Texts that share 0.8 of their shingles have a cosine of 0.89 and differ in 39 of
#: 256 bits on average (one in a hundred such pairs in over 52), and most share 4 to 10 of 32 bytes; unrelated texts
#: differ in 128 and share 0 or 1. What these bounds let through is verified on the shingles themselves.
SIMILAR = Plan(words=5, parts=4, lists=ring_positions(32, (1, 11)), min_shared=3, max_bits=52, similarity=0.8)


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows): XXH64 of every run of ``size`` words joined by a space, or of a shorter row's whole sequence."""
    starts, ends, first = flat.words(buf, offsets)
    # the words with one space after each, as one byte string
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts + 1, out=at[1:])
    joined = np.full(at[-1], 0x20, np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    joined[inside] = _LOWER[buf[flat.WORD_BYTE[buf]]]
    rows = flat.row_numbers(first)
    heads = np.arange(len(starts))
    whole = heads + size <= first[rows + 1]
    short = (heads == first[rows]) & ~whole
    heads = heads[whole | short]
    rows = rows[heads]
    a, b = at[heads], at[np.minimum(heads + size, first[rows + 1])] - 1
    data = joined.tobytes()
    found = [xxh64_intdigest(data[i:j], SEED) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    return np.array(found, np.uint64), rows


def different_shingles(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows): the different shingles of each row as ``shingle_hashes`` cuts them, sorted in each row."""
    starts, ends, first = flat.words(buf, offsets)
    rows = flat.row_numbers(first)
    heads = np.arange(len(starts))
    whole = heads + size <= first[rows + 1]
    heads = heads[whole | ((heads == first[rows]) & ~whole)]
    rows = rows[heads]
    of = flat.Spans(flat.Spans(_LOWER[buf]).hashes(starts, ends)).hashes(heads, np.minimum(heads + size, first[rows + 1]))
    order = np.lexsort((of, rows))
    of, rows = of[order], rows[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (rows[1:] != rows[:-1])
    return of[new], rows[new]


def fingerprint_part(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Bit k is set where it is in over half of a row's hashes; zero without hashes."""
    out = np.zeros(n_rows, np.uint64)
    if len(hashes):
        heads = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        sizes = np.diff(np.append(heads, len(rows)))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
        out[rows[heads]] = np.packbits(2 * sums > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprinter(plan: Plan):
    """A column function: struct<fp, content, size> of each whole text: the fingerprint as an array of longs, of which the first is of the
    hashes as they are, and with ``plan.similarity`` a hash of the set of shingles (else null); how many shingles there are."""

    @F.arrow_udf("struct<fp: array<long>, content: long, size: long>")
    def fingerprint(text: pa.Array) -> pa.Array:
        found, contents, sizes = [np.zeros((0, plan.parts), np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, hi, buf, offsets in flat.slices(text):
            hashes, rows = (shingle_hashes if plan.similarity is None else different_shingles)(buf, offsets, plan.words)
            parts = [fingerprint_part(hashes if k == 0 else flat.mix(hashes + np.uint64(k)), rows, hi - lo) for k in range(plan.parts)]
            found.append(np.stack(parts, 1))
            content = np.zeros(hi - lo, np.uint64)
            np.add.at(content, rows, flat.mix(hashes))
            contents.append(content)
            sizes.append(np.bincount(rows, minlength=hi - lo))
        values, content = np.concatenate(found).view(np.int64), np.concatenate(contents).view(np.int64)
        fp = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * plan.parts, pa.int32()), pa.array(values.ravel()))
        return pa.StructArray.from_arrays([fp, pa.array(content, mask=np.full(len(content), plan.similarity is None)), pa.array(np.concatenate(sizes))], names=["fp", "content", "size"])

    return fingerprint


def fingerprints(docs: DataFrame, plan: Plan = EXACT, *more: Column) -> DataFrame:
    """doc_id, fp (array<long>), content, size and ``more`` columns of every row."""
    return docs.select("doc_id", fingerprinter(plan)("text").alias("f"), *more).select("doc_id", "f.*", *docs.select(*more).columns)


#: How much larger the largest text of a list can be than the smallest.
SIZE_CLASS = 2.0


def list_keys(fp: Column, plan: Plan, size: Column | None = None) -> Column:
    """The posting lists of a fingerprint: the list's number and its bytes in one long.

    With ``plan.similarity`` s a list is for a class of ``size`` too, and a text is in the lists of its own class and of that of size / s:
    no text of more than size / s shingles can share s of them with it, so each such pair still meets in the larger one's class.
    """
    byte = [F.shiftrightunsigned(fp[p // 8], 8 * (p % 8)).bitwiseAND(0xFF) for p in range(8 * plan.parts)]
    keys = []
    for k, positions in enumerate(plan.lists):
        key = F.lit(k).cast("long")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(byte[p])
        keys.append(key)
    if plan.similarity is None:
        return F.array(*keys)
    of = lambda n: F.floor(F.log(SIZE_CLASS, F.greatest(n, F.lit(1)).cast("double"))).cast("long")
    classes = F.array_distinct(F.array(of(size), of(F.ceil(size / plan.similarity) + 1)))
    return F.flatten(F.transform(classes, lambda c: F.transform(F.array(*keys), lambda k: k.bitwiseOR(F.shiftleft(c + 1, 40)))))


def linked_pairs(runs: np.ndarray, fps: np.ndarray, min_shared: int, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i < j and differing bits of the verified pairs inside each run of equal ``runs``; fps has a row of words for each place."""
    left, right, bits = [], [], []
    at = np.arange(len(runs))
    for step in range(1, len(runs)):
        at = at[at + step < len(runs)]
        at = at[runs[at] == runs[at + step]]
        if not len(at):
            break
        differ = fps[at] ^ fps[at + step]
        tally = (differ.view(np.uint8).reshape(len(at), -1) == 0).sum(axis=1)
        some = np.flatnonzero(tally >= min_shared)
        n = np.bitwise_count(differ[some]).sum(axis=1, dtype=np.int64)
        some, n = some[n <= max_bits], n[n <= max_bits]
        left.append(at[some])
        right.append(at[some] + step)
        bits.append(n)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right), np.concatenate(bits)) if left else (none, none, none)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of each of ``n`` places, the least place that it is linked with."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        label = label[label]
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    while True:
        jumped = label[label]
        if np.array_equal(jumped, label):
            return label
        label = jumped


def nearest_tree(n: int, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the pairs make a spanning forest of least weights: every part takes its lightest pair, again and again."""
    order = np.lexsort((right, left, weight))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    label, open_, chosen = np.arange(n), np.arange(len(order)), np.zeros(len(order), bool)
    while True:
        open_ = open_[label[left[open_]] != label[right[open_]]]
        if not len(open_):
            return np.flatnonzero(chosen)
        best = np.full(n, len(order))
        np.minimum.at(best, label[left[open_]], rank[open_])
        np.minimum.at(best, label[right[open_]], rank[open_])
        taken = order[np.unique(best[best < len(order)])]
        chosen[taken] = True
        label = forest(n, label[left[taken]], label[right[taken]])[label]


def _links(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list and blocks to links (a, b); a list that goes on in the next batch waits for it."""
    rest: list[np.ndarray] = []

    def found(run, fps, ids):
        left, right, _ = linked_pairs(run, fps, plan.min_shared, plan.max_bits)
        label = forest(len(run), left, right)
        some = np.flatnonzero(label != np.arange(len(run)))
        return pa.RecordBatch.from_pydict({"a": ids[some], "b": ids[label[some]]})

    for batch in batches:
        if not len(batch):
            continue
        key, pair, ids = (batch[k].to_numpy() for k in ("key", "pair", "id"))
        fps = _words_of(batch["fp"], plan)
        if rest:
            key, pair, ids, fps = (np.concatenate(x) for x in zip(rest, (key, pair, ids, fps), strict=True))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])))
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield found(np.cumsum(new[:last]), fps[:last], ids[:last])
        rest = [x[last:] for x in (key, pair, ids, fps)]
    if rest:
        yield found(np.zeros(len(rest[0]), np.int64), rest[3], rest[2])


def _words_of(fp: pa.Array, plan: Plan) -> np.ndarray:
    return np.ascontiguousarray(fp.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, plan.parts))


def links(classes: DataFrame, plan: Plan, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join what verified pairs join, of a table of id, fp and, with ``plan.similarity``, size."""
    keys = F.explode(list_keys(F.col("fp"), plan, None if plan.similarity is None else F.col("size"))).alias("key")
    rows = classes.select(keys, "id", "fp")
    long_lists = stored(
        classes.select(keys).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block), "long-lists"
    )
    # a list of n rows has m blocks; a row is in block x, and is sent to the pairs of x with each block
    m = F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int")
    x = F.pmod(F.xxhash64("id"), F.col("m")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda y: F.least(F.col("x"), y) * F.col("m") + F.greatest(F.col("x"), y))
    dealt = rows.join(long_lists, "key", "left").withColumn("m", m).withColumn("x", x).select("key", F.explode(pairs).alias("pair"), "id", "fp")
    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(lambda it: _links(it, plan), "a long, b long")


# -- links that are verified on the texts


def shingle_setter(plan: Plan):
    """A column function: the different shingle hashes of each whole text."""

    @F.arrow_udf("array<long>")
    def shingles(text: pa.Array) -> pa.Array:
        counts, parts = [np.zeros(1, np.int64)], [np.zeros(0, np.uint64)]
        for lo, hi, buf, offsets in flat.slices(text):
            hashes, rows = different_shingles(buf, offsets, plan.words)
            parts.append(hashes)
            counts.append(np.bincount(rows, minlength=hi - lo))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))

    return shingles


def meet_in_a_list(fps: np.ndarray, left: np.ndarray, right: np.ndarray, lists: tuple[tuple[int, ...], ...]) -> np.ndarray:
    """Which pairs have equal bytes at all positions of some list."""
    equal = (fps[left] ^ fps[right]).view(np.uint8).reshape(len(left), 8 * fps.shape[1]) == 0
    return np.any([equal[:, list(ps)].all(axis=1) for ps in lists], axis=0)


_COLUMNS = 1 << 14


def shared_shingles(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(rows, rows): how many shingles each two rows share, by products of 0/1 matrices of the shingles that several rows have."""
    n = len(sizes)
    _, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    common = counts > 1
    inside = common[at]
    row, column = np.repeat(np.arange(n), sizes)[inside], (np.cumsum(common) - 1)[at[inside]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, int(common.sum()), _COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + _COLUMNS))
        has = np.zeros((n, int(column[b - 1]) - lo + 1), np.float32)
        has[row[a:b], column[a:b] - lo] = 1
        out += has @ has.T
    return out


def similar_pairs(fps: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, part: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that join what all candidate pairs of different parts with enough shared shingles join."""
    left, right, bits = linked_pairs(np.zeros(len(fps), np.int64), fps, plan.min_shared, plan.max_bits)
    some = np.flatnonzero(part[left] != part[right])
    if len(some):
        some = some[meet_in_a_list(fps, left[some], right[some], plan.lists)]
    if not len(some):
        return some, some
    left, right, bits = left[some], right[some], bits[some]
    shared = shared_shingles(hashes, sizes)[left, right].astype(np.int64)
    some = np.flatnonzero(shared >= plan.similarity * (sizes[left] + sizes[right] - shared))
    left, right, bits = left[some], right[some], bits[some]
    tree = nearest_tree(len(fps), left, right, bits)
    return left[tree], right[tree]


def _verified(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and block to links (a, b) of similar texts; a block that goes on in the next batch waits for it."""

    def found(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        ids, part = table["id"].to_numpy(), table["part"].to_numpy()
        lists = table["shingles"].combine_chunks()
        where, hashes = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        fps, sizes = _words_of(table["fp"].combine_chunks(), plan), np.diff(where)
        out = [(np.zeros(0, np.int64),) * 2]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo + 1:
                left, right = similar_pairs(fps[lo:hi], hashes[where[lo] : where[hi]], sizes[lo:hi], part[lo:hi], plan)
                out.append((ids[lo + left], ids[lo + right]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_pydict({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    rest: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        group, block = table["group"].to_numpy(), table["block"].to_numpy()
        cuts = np.concatenate(([0], 1 + np.flatnonzero((group[1:] != group[:-1]) | (block[1:] != block[:-1]))))
        if len(cuts) > 1:
            yield found(table.slice(0, int(cuts[-1])).combine_chunks(), cuts)
        rest = table.slice(int(cuts[-1])).combine_chunks()
    if rest is not None:
        yield found(rest, np.array([0, len(rest)]))


def _sizes(rows: DataFrame, *keys: str) -> DataFrame:
    """How many blocks (m) the rows of each key make."""
    m = F.greatest(F.ceil(F.count(F.lit(1)) / VERIFIED_ROWS), F.ceil(F.sum(F.size("shingles")) / VERIFIED_SHINGLES))
    return rows.groupBy(*keys).agg(m.cast("int").alias("m"))


def _verify(dealt: DataFrame, plan: Plan) -> DataFrame:
    rows = dealt.select("group", "block", "id", "part", "fp", "shingles")
    return rows.repartition("group", "block").sortWithinPartitions("group", "block").mapInArrow(lambda it: _verified(it, plan), "a long, b long")


def _crossing_blocks(rows: DataFrame) -> DataFrame:
    """Rows of a group, dealt so that any two of different parts meet in some block.

    A part of more than one block has blocks of its own, all smaller ones share some; a row is sent to the pairs of
    its block with each block that can hold another part.
    """
    large = _sizes(rows, "group", "part").filter("m > 1").select("group", "part", F.col("part").alias("unit"))
    unit = F.coalesce("unit", F.lit(-1))
    of = stored(rows.join(large, ["group", "part"], "left").withColumn("unit", unit), "simhash-units")
    units = _sizes(of, "group", "unit")
    blocks = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("unit", "m"))), lambda u: F.array_repeat(u["unit"], u["m"])))
    named = units.join(units.groupBy("group").agg(blocks.alias("blocks")), "group")
    x = F.array_position("blocks", F.col("unit")) - 1 + F.pmod(F.xxhash64("id"), F.col("m"))
    others = F.filter(F.sequence(F.lit(0), F.size("blocks") - 1), lambda y: (F.col("unit") == -1) | (F.get("blocks", y) != F.col("unit")))
    pairs = F.transform(others, lambda y: F.least(F.col("x"), y) * F.size("blocks") + F.greatest(F.col("x"), y))
    return of.join(named, ["group", "unit"]).withColumn("x", x).withColumn("block", F.explode(pairs))


def verified_links(candidates: DataFrame, classes: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) of classes whose texts share at least ``plan.similarity`` of their different shingles.

    ``candidates``: (a, b), the members of candidate groups and each group's least id. Of each class the text of its
    least id speaks for it; a class is of texts with equal sets. A group that is one block is done in one pass. The
    rows of a larger one are dealt to blocks by a hash, twice, which makes most of a family of copies one part with
    every row sent once; then what is still apart meets in pairs of blocks, so that no pair is left out.
    """
    groups = candidates.withColumnsRenamed({"a": "id", "b": "group"})
    members = groups.unionByName(groups.select(F.col("group").alias("id"), "group").distinct())
    named = stored(members.join(classes.select("id", "fp", "least_id", "least_key"), "id"), "simhash-members")
    same = docs["doc_id"].eqNullSafe(F.col("least_id")) & (F.xxhash64(docs["text"]) == F.col("least_key"))
    # few enough members go to the texts; otherwise both are shuffled
    few = named.count() <= MAX_BROADCAST_ENDS
    texts = docs.select("doc_id", "text").join(F.broadcast(named) if few else named.hint("shuffle_hash"), same)
    sets = texts.select("id", "group", "fp", shingle_setter(plan)("text").alias("shingles")).dropDuplicates(["id"])
    sets = stored(sets.withColumn("part", F.col("id")), "simhash-shingles")
    large = stored(_sizes(sets, "group").filter("m > 1"), "simhash-large-groups")
    by_hash = lambda rows, salt: rows.withColumn("block", F.when(F.col("m") > 1, F.pmod(F.xxhash64("id", F.lit(salt)), F.col("m"))).otherwise(0))
    found = stored(_verify(by_hash(sets.join(large, "group", "left"), 0), plan), "simhash-verified")
    if large.isEmpty():
        return found
    for salt in (1, None):
        parts = components(found).withColumnsRenamed({"a": "id", "b": "new_part"})
        rows = sets.join(large, "group").join(parts, "id", "left").withColumn("part", F.coalesce("new_part", "id")).drop("new_part")
        apart = rows.groupBy("group").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("group")
        rows = stored(rows.join(apart, "group", "left_semi"), "simhash-apart")
        found = stored(found.unionByName(_verify(by_hash(rows, salt) if salt else _crossing_blocks(rows.drop("m")), plan)), "simhash-verified")
    return found


def _class_columns(plan: Plan) -> list[str]:
    return ["fp"] if plan.similarity is None else ["fp", "content"]


def components_of(fps: DataFrame, plan: Plan = EXACT, block: int = BLOCK, docs: DataFrame | None = None) -> DataFrame:
    """fp (with content, if ``plan.similarity``) and component_id of every class of a (written) table of doc_id, text_key, fp, content, size: the
    smallest doc_id that can be reached.

    ``docs`` are the texts that ``plan.similarity`` is verified on.
    """
    of = _class_columns(plan)
    once = fps.groupBy(*of).agg(F.min("doc_id").alias("least_id"), F.min_by("text_key", F.struct("doc_id", "text_key")).alias("least_key"), *([] if plan.similarity is None else [F.min("size").alias("size")]))
    classes = stored(once.withColumn("id", F.monotonically_increasing_id()), "simhash-classes")
    edges = links(classes, plan, block)
    if plan.similarity is not None:
        edges = verified_links(components(edges), classes, docs, plan)
    named = classes.join(components(edges).withColumnsRenamed({"a": "id", "b": "root"}), "id", "left").withColumn("root", F.coalesce("root", "id")).select(*of, "root", "least_id")
    # written, so that Spark can split the join at a root with very many members
    least = stored(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-least")
    return named.join(least, "root").select(*of, "component_id")


def near_duplicates(docs: DataFrame, plan: Plan = EXACT) -> DataFrame:
    """doc_id, text_key, fp, component_id of every row of ``docs`` (doc_id, text)."""
    fps = stored(fingerprints(docs, plan, F.xxhash64("text").alias("text_key")), "simhash-fingerprints")
    return fps.join(stored(components_of(fps, plan, docs=docs), "simhash-components"), _class_columns(plan)).select("doc_id", "text_key", "fp", "component_id")


def keep_one(docs: DataFrame, plan: Plan = SIMILAR) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with its id stays, all columns as they were.

    Documents are told apart by id and text; of repeated rows one stays. Rows without an id always stay.
    """
    named = near_duplicates(docs, plan)
    key = [F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")]
    gone = stored(named.filter("doc_id != component_id").select(*key).distinct(), "simhash-gone")
    twice = stored(named.filter("doc_id = component_id").groupBy(*key).count().filter("count > 1").drop("count"), "simhash-repeated")
    # the row goes along as one column, so that no name of its own can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("text_key"))
    same = (F.col("doc_id") == F.col("gone_id")) & (F.col("text_key") == F.col("gone_key"))
    kept = rows.join(gone.hint("shuffle_hash"), same, "left_anti")
    if not twice.isEmpty():
        once = kept.join(twice.hint("shuffle_hash"), same, "left_semi").dropDuplicates(["doc_id", "text_key"])
        kept = kept.join(twice.hint("shuffle_hash"), same, "left_anti").unionByName(once)
    return kept.select("row.*")
