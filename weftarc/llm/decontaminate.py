"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some of the words in a window and ignore the others. Hashes of the selected words of all
benchmark windows are joined with those of all training windows inside the tasks that read the texts; texts
are never shuffled. Around a hit the two word sequences are laid on each other and, of all segments of
which at least ``min_share`` agrees, the one with the most agreeing words is taken. It counts as a leak if at
least ``min_words`` words agree (all words of a shorter item).

The benchmark's different texts go to the tasks in blocks of bounded size, one pass over the texts for each block;
the usual benchmark is one block. A seed that very many items share (a template) gives all its items at once
as arrays; items that agree in too few words where the seed lays them are left before any is looked at alone.

Edge cases: words are runs of ASCII letters and digits and of any non-ASCII characters, in lower case. Null
and empty texts have no words and match nothing, as do items without words. Items of under ``LEAST_ITEM`` words
are part of much ordinary text, so they count only where they are a whole line; items shorter than a mask are
sought whole. Repeated items and rows each give their own result. An empty benchmark leaves every document
clean. Columns of the documents other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftarc.llm import flat

#: 1: the word counts, 0: it is ignored.
MASKS = ("111011", "11010111", "1100110011", "101101001011")
MIN_WORDS = 13
MIN_SHARE = 0.8
LEAST_ITEM = 5
BLOCK_BYTES = 8 << 20

LEAK_TYPE = "array<struct<item_no: int, matched_words: int, overlap_words: int, first_word: int>>"
_IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_FILTER_BITS = 22
#: Seeds with their items, or words of items, that are looked at together.
MAX_PAIRS = 1 << 19


def _word_hashes(column: pa.Array):
    """(first row, hashes of the words, first word of each row, whether a line begins before each word and after the last) of each slice."""
    lowered = pc.utf8_lower(column)
    for lo, _, buf, offsets in flat.slices(lowered):
        starts, ends, first = flat.words(buf, offsets, _IS_WORD)
        lines = np.searchsorted(np.flatnonzero(buf == 10), starts)
        begins = np.ones(len(starts) + 1, bool)
        begins[1:-1] = lines[1:] != lines[:-1]
        begins[first] = True
        yield lo, flat.Spans(buf).hashes(starts, ends), first, begins


def _seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the selected words of the window that starts at each word; windows may cross rows."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask) * 1_000_003 + int(mask, 2), np.uint64)
    up, _ = flat.powers(len(mask) + 1)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += words[k : k + n] * up[k + 1]
    return flat.mix(out)


def _portions(counts: np.ndarray) -> list[tuple[int, int]]:
    """Runs (from, to) of places whose counts sum up to about MAX_PAIRS."""
    ends = np.cumsum(counts)
    cuts = np.unique([0, *np.searchsorted(ends, np.arange(MAX_PAIRS, int(ends[-1]), MAX_PAIRS), "right"), len(ends)]) if len(ends) else np.zeros(1, int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


class SeedIndex:
    """Seeds of a block of benchmark items as sorted arrays, with the items' words."""

    def __init__(self, texts: list[str], min_words: int = MIN_WORDS, min_share: float = MIN_SHARE):
        self.min_words, self.min_share = min_words, min_share
        parts = list(_word_hashes(pa.array(texts, pa.string()))) if texts else []
        self.words = np.concatenate([np.zeros(0, np.uint64), *(p[1] for p in parts)])
        self.sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(p[2]) for p in parts)])
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        sizes = {int(n) for n in self.sizes if LEAST_ITEM <= n < max(map(len, MASKS))}
        self.masks = [*MASKS, *("1" * n for n in sorted(sizes))]
        keys, owners, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        owner = flat.row_numbers(self.first)
        for mask in self.masks:
            found = _seeds(self.words, mask)
            at = np.arange(len(found))
            of = owner[at]
            size = self.sizes[of]
            inside = (at + len(mask) <= self.first[of + 1]) & (size >= LEAST_ITEM)
            if "0" not in mask:
                inside &= size == len(mask)
            at = at[inside]
            keys.append(found[at])
            owners.append(owner[at])
            places.append(at - self.first[owner[at]])
        self.keys, self.owners, self.places = self._sorted(np.concatenate(keys), np.concatenate(owners), np.concatenate(places))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - _FILTER_BITS)] = True
        short = np.flatnonzero((self.sizes > 0) & (self.sizes < LEAST_ITEM))
        self.line_keys, self.line_owners = self._sorted(flat.Spans(self.words).hashes(self.first[short], self.first[short + 1]), short)

    @staticmethod
    def _sorted(keys: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(keys, kind="stable")
        return (keys[order], *(x[order] for x in others))

    def item(self, no: int) -> np.ndarray:
        return self.words[self.first[no] : self.first[no + 1]]

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, the word where the item would begin), each once, where a seed is shared and enough words agree."""
        seen = [np.zeros((3, 0), np.int64)]
        for mask in self.masks:
            seeds = _seeds(words, mask)
            at = np.flatnonzero(self.filter[seeds >> np.uint64(64 - _FILTER_BITS)])
            lo, hi = np.searchsorted(self.keys, seeds[at], "left"), np.searchsorted(self.keys, seeds[at], "right")
            rows = np.searchsorted(first, at, "right") - 1
            some = (hi > lo) & (at + len(mask) <= first[rows + 1])
            at, lo, n, rows = at[some], lo[some], (hi - lo)[some], rows[some]
            # a bounded number of pairs of a seed and an item at a time
            for i, j in _portions(n):
                of = np.repeat(np.arange(i, j), n[i:j])
                entry = lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
                pairs = np.unique(np.stack((rows[of], self.owners[entry], at[of] - self.places[entry])), axis=1)
                seen.append(pairs[:, self._agreeing(words, first, *pairs) >= np.minimum(self.min_words, self.sizes[pairs[1]])])
        return tuple(np.unique(np.concatenate(seen, axis=1), axis=1))

    def _agreeing(self, words: np.ndarray, first: np.ndarray, rows: np.ndarray, items: np.ndarray, shifts: np.ndarray) -> np.ndarray:
        """How many words of each item agree with the row's where it is laid."""
        out = np.zeros(len(rows), np.int64)
        size = self.sizes[items]
        for i, j in _portions(size):
            of = np.repeat(np.arange(i, j), size[i:j])
            k = np.arange(len(of)) - np.repeat(np.cumsum(size[i:j]) - size[i:j], size[i:j])
            at = shifts[of] + k
            inside = (at >= first[rows[of]]) & (at < first[rows[of] + 1])
            same = inside & (words[np.where(inside, at, 0)] == self.words[self.first[items[of]] + k])
            out += np.bincount(of[same], minlength=len(rows))
        return out

    def whole_lines(self, words: np.ndarray, first: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, words, words, first word) of the first line of a row that is a short item."""
        if not len(self.line_keys) or not len(words):
            return []
        cuts = np.flatnonzero(begins)
        n = np.diff(cuts)
        cuts = cuts[:-1][n < LEAST_ITEM]
        n = n[n < LEAST_ITEM]
        sought = flat.Spans(words).hashes(cuts, cuts + n)
        lo, hi = np.searchsorted(self.line_keys, sought, "left"), np.searchsorted(self.line_keys, sought, "right")
        rows, found = np.searchsorted(first, cuts, "right") - 1, {}
        for k in np.flatnonzero(hi > lo).tolist():
            for no in self.line_owners[lo[k] : hi[k]].tolist():
                if np.array_equal(self.item(no), words[cuts[k] : cuts[k] + n[k]]):
                    found.setdefault((int(rows[k]), no), (int(n[k]), int(n[k]), int(cuts[k] - first[rows[k]])))
        return [(*key, *x) for key, x in found.items()]

    def leaks(self, words: np.ndarray, first: np.ndarray, begins: np.ndarray | None = None) -> dict[int, list[tuple[int, int, int, int]]]:
        """By row: (item, agreeing words, words in the segment, first word), the best segment for each item."""
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        if len(self.keys) and len(words):
            for r, no, shift in zip(*(x.tolist() for x in self.hits(words, first)), strict=True):
                item, lo, hi = self.item(no), int(first[r]), int(first[r + 1])
                a, b = max(shift, lo), min(shift + len(item), hi)
                matched, length, start = best_segment(words[a:b] == item[a - shift : b - shift], self.min_share)
                if matched >= min(self.min_words, len(item)):
                    new = (no, matched, length, a + start - lo)
                    best[r, no] = max(best.get((r, no), new), new, key=lambda x: (x[1], -x[2], -x[3]))
        for r, no, *x in self.whole_lines(words, first, begins) if begins is not None else ():
            best[r, no] = (no, *x)
        out: dict[int, list] = {}
        for r, no in sorted(best):
            out.setdefault(r, []).append(best[r, no])
        return out


def best_segment(same: np.ndarray, min_share: float = MIN_SHARE) -> tuple[int, int, int]:
    """(agreeing words, length, start) of the segment with the most agreeing words of those with at least ``min_share``; the shortest, then first, of equals."""
    share = Fraction(str(min_share))
    # whole numbers, so that a sum is at least 0 exactly where the share is reached
    sums = np.concatenate(([0], np.cumsum(np.where(same, share.denominator - share.numerator, -share.numerator))))
    # for each end, the first start that is not above it: the longest segment, which has the most agreeing words
    begin = np.searchsorted(-np.minimum.accumulate(sums), -sums, "left")
    counts = np.concatenate(([0], np.cumsum(same)))
    matched = counts - counts[begin]
    if not matched.any():
        return 0, 0, 0
    # without the differing words at its start
    hits = np.flatnonzero(same)
    begin = np.where(matched > 0, hits[np.minimum(counts[begin], len(hits) - 1)], begin)
    length = np.arange(len(sums)) - begin
    end = int(np.lexsort((begin, length, -matched))[0])
    return int(matched[end]), int(length[end]), int(begin[end])


def leak_finder(index):
    """A column function: the leaks of whole texts against a broadcast SeedIndex."""

    @F.arrow_udf(LEAK_TYPE)
    def leaks(text: pa.Array) -> pa.Array:
        rows: list = [[]] * len(text)
        for lo, words, first, begins in _word_hashes(text):
            for r, found in index.value.leaks(words, first, begins).items():
                rows[lo + r] = [dict(zip(("item_no", "matched_words", "overlap_words", "first_word"), x, strict=True)) for x in found]
        kind = pa.list_(pa.struct([(k, pa.int32()) for k in ("item_no", "matched_words", "overlap_words", "first_word")]))
        return pa.array(rows, kind)

    return leaks


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The different texts of the benchmark, in blocks of about ``block_bytes``."""
    texts = benchmark.select("text").filter("text is not null and text != ''").distinct()
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        part = texts if n == 1 else texts.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield [r["text"] for r in part.collect()]  # at most about block_bytes by the sum above


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, matched_words, overlap_words, first_word, item_words."""
    spark = docs.sparkSession
    items = benchmark.filter("text is not null").select("item_id", F.sha2("text", 256).alias("text_key"))
    out = None
    for texts in _blocks(benchmark, block_bytes):
        index = SeedIndex(texts)
        leaks = docs.select("doc_id", F.explode(leak_finder(spark.sparkContext.broadcast(index))("text")).alias("leak")).select("doc_id", "leak.*")
        rows = [(no, hashlib.sha256(t.encode()).hexdigest(), int(n)) for no, (t, n) in enumerate(zip(texts, index.sizes, strict=True))]
        names = items.join(F.broadcast(spark.createDataFrame(rows, "item_no int, text_key string, item_words int")), "text_key")
        part = leaks.join(names, "item_no").select("doc_id", "item_id", "matched_words", "overlap_words", "first_word", "item_words")
        out = part if out is None else out.unionByName(part)
    if out is None:
        counts = [F.lit(None).cast("int").alias(k) for k in ("matched_words", "overlap_words", "first_word", "item_words")]
        out = docs.select("doc_id", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), *counts).filter(F.lit(False))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they were."""
    for texts in _blocks(benchmark, block_bytes):
        docs = docs.filter(F.size(leak_finder(docs.sparkSession.sparkContext.broadcast(SeedIndex(texts)))(F.col("text"))) == 0)
    return docs
