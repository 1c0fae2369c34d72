"""Substring dedup by sliding sentence spans.

From every sentence the shortest run of at least ``MIN_SENTENCES`` sentences and ``MIN_RUN_WORDS`` words is
hashed (a sentence of ``LONG_SENTENCE`` words or more is a run of its own, beyond the method: long passages without
a stop are one sentence here), and also the shortest that ends with the sentence. Any longer run is covered by such
runs inside it: what follows too near its end to start one by a run that ends there. Runs of
all documents meet by two 64-bit hashes with different multipliers, so that one hash confirms the other; of each run that occurs more than once, the first occurrence stays (by document id, then text hash,
then place) and the sentences that any other occurrence covers are removed.

Scale: occurrences are counted with partial sums before the shuffle, so a passage that a third of all
documents share sends one row from each task. Only runs that repeat are joined back, on hashes that are unique on
the small side, so Spark can split a hot hash. Spans are gathered by document and bounded by its sentences.

Edge cases: sentences end with a word that ends in . ! or ? or before a newline; case and white space are
ignored. Null and empty texts have no runs and stay as they are. Documents are told apart by id and text:
rows with both equal count as one document and get the same result. A text may become empty; its row stays.
Columns of any other names stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftarc.llm import flat
from weftarc.llm.scratch import stored

MIN_SENTENCES = 2
MIN_RUN_WORDS = 20
LONG_SENTENCE = 40

RUN_TYPE = "array<struct<run: long, proof: long, start: int, stop: int>>"
_LOWER = np.frombuffer(flat.LOWER, np.uint8)
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def sentences(buf: np.ndarray, offsets: np.ndarray):
    """(words' starts, words' ends, first word of each row, first word of each sentence and the number of words)."""
    starts, ends, first = flat.words(buf, offsets)
    if not len(starts):
        return starts, ends, first, np.zeros(1, np.int64)
    lines = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(buf == 10, out=lines[1:])
    last = _STOP[buf[ends - 1]]
    last[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    last[first[1:][first[1:] > 0] - 1] = True
    return starts, ends, first, np.concatenate(([0], np.flatnonzero(last) + 1))


def _runs(buf: np.ndarray, offsets: np.ndarray, min_sentences: int, min_words: int, long_sentence: int, kinds: tuple[int, ...]):
    """(row, a list of the hashes of each of ``kinds``, start, stop) of every run; start and stop are byte offsets in the row."""
    starts, ends, first, cuts = sentences(buf, offsets)
    n = len(cuts) - 1
    i = np.arange(n)
    j = np.maximum(np.searchsorted(cuts[1:], cuts[:-1] + min_words), i + min_sentences - 1)
    j = np.where(np.diff(cuts) >= long_sentence, i, j)
    rows = np.searchsorted(first, cuts[:-1], "right") - 1
    keep = j < n
    i, j = i[keep], j[keep]
    e = np.arange(n)
    s = np.minimum(np.searchsorted(cuts, cuts[1:] - min_words, "right") - 1, e - min_sentences + 1)
    keep = (s >= 0) & (np.diff(cuts) < long_sentence)
    i, j = np.divmod(np.unique(np.concatenate((i * n + j, s[keep] * n + e[keep]))), max(n, 1))
    keep = rows[i] == rows[j]
    i, j = i[keep], j[keep]
    lowered = _LOWER[buf]
    of = [flat.Spans(flat.Spans(lowered, k).hashes(starts, ends), k).hashes(cuts[i], cuts[j + 1]) for k in kinds]
    begin = np.append(starts, 0)[cuts]  # of the first word of each sentence
    stop = np.where((j + 1 < n) & (np.append(rows, -1)[np.minimum(j + 1, n)] == rows[j]), begin[np.minimum(j + 1, n)], offsets[rows[j] + 1])
    base = offsets[rows[i]]
    return rows[i], of, begin[i] - base, stop - base


def runs_of_slice(buf: np.ndarray, offsets: np.ndarray, min_sentences: int, min_words: int, long_sentence: int):
    """(row, hash, start, stop) of every run."""
    rows, (of,), start, stop = _runs(buf, offsets, min_sentences, min_words, long_sentence, (0,))
    return rows, of, start, stop


def run_finder(min_sentences: int = MIN_SENTENCES, min_words: int = MIN_RUN_WORDS, long_sentence: int = LONG_SENTENCE):
    """A column function: the runs of whole texts."""

    @F.arrow_udf(RUN_TYPE)
    def runs(text: pa.Array) -> pa.Array:
        counts, parts = [], []
        for _, _, buf, offsets in flat.slices(text):
            rows, of, start, stop = _runs(buf, offsets, min_sentences, min_words, long_sentence, (0, 1))
            counts.append(np.bincount(rows, minlength=len(offsets) - 1))
            parts.append((*of, start, stop))
        where = np.concatenate(([0], np.cumsum(np.concatenate(counts) if counts else np.zeros(len(text), np.int64))))
        run, proof, start, stop = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(4))
        fields = [pa.array(x.astype(np.uint64).view(np.int64), pa.int64()) for x in (run, proof)] + [pa.array(x, pa.int32()) for x in (start, stop)]
        return pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.StructArray.from_arrays(fields, names=["run", "proof", "start", "stop"]))

    return runs


def repeated_spans(docs: DataFrame, **params) -> DataFrame:
    """doc_id, text_key, spans (sorted start, stop in bytes), first_doc_ids: of each document that holds a non-first repeated run."""
    runs = stored(docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(run_finder(**params)("text")).alias("r")).select("doc_id", "text_key", "r.*"), "substring-runs")
    # written, so that Spark can split the join where a run is in very many documents
    firsts = stored(
        runs.groupBy("run", "proof").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key", "start")).alias("first")).filter("n > 1").drop("n"),
        "substring-firsts",
    )
    later = runs.join(firsts, ["run", "proof"]).filter(~F.struct("doc_id", "text_key", "start").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"),
        F.array_sort(F.collect_set("first.doc_id")).alias("first_doc_ids"),
    )


def cut(text: Column, spans: Column) -> tuple[Column, Column]:
    """(what stays of ``text`` without the sorted byte spans, the bytes removed)."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, stop: int>>").alias("kept"))
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("stop"))
    folded = F.aggregate(
        spans, zero,
        lambda acc, s: F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] > acc["at"], F.array_append(acc["kept"], pair(acc["at"], s["start"]))).otherwise(acc["kept"]).alias("kept")),
        lambda acc: F.array_append(acc["kept"], pair(acc["at"], F.octet_length(text))),
    )
    data = text.cast("binary")
    pieces = F.transform(folded, lambda k: F.substring(data, k["start"] + 1, k["stop"] - k["start"]).cast("string"))
    left = F.array_join(pieces, "")
    return left, F.octet_length(text) - F.octet_length(left)


def _cut_rows(docs: DataFrame, **params) -> DataFrame:
    """row (the whole row of ``docs`` as one column, so that no name can clash), left (its text), removed_spans, first_doc_ids, removed_bytes."""
    spans = stored(repeated_spans(docs, **params), "substring-spans").withColumnsRenamed({"doc_id": "of_doc_id", "text_key": "of_text_key", "spans": "removed_spans"})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    same = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.xxhash64("text") == F.col("of_text_key"))
    joined = rows.join(spans.hint("shuffle_hash"), same, "left")
    left, removed = cut(F.col("text"), F.col("removed_spans"))
    some = F.col("removed_spans").isNotNull()
    return joined.select("row", F.when(some, left).otherwise(F.col("text")).alias("left"), "removed_spans", "first_doc_ids", F.when(some, removed).otherwise(0).alias("removed_bytes"))


def remove_repeats(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with ``text`` cut; adds removed_spans and first_doc_ids (null where nothing repeats) and removed_bytes.

    Columns of these names are replaced, others stay as they were.
    """
    added = ("removed_spans", "first_doc_ids", "removed_bytes")
    docs = docs.drop(*added)
    of = [(F.col("left") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns]
    return _cut_rows(docs, **params).select(*of, *added)


def without_repeats(docs: DataFrame, length: str | None = None, **params) -> DataFrame:
    """``docs`` with ``text`` cut, and in the column ``length`` the characters of a text that lost some; all else as it was."""
    new = {"text": F.col("left")}
    if length is not None:
        changed = F.col("removed_bytes") > 0
        new[length] = F.when(changed, F.length("left").cast(docs.schema[length].dataType)).otherwise(F.col("row")[length])
    return _cut_rows(docs, **params).select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def removals(docs: DataFrame, **params) -> DataFrame:
    """doc_id, removed_spans, removed_bytes, first_doc_ids and the text that is left, of each document that loses something."""
    return remove_repeats(docs.select("doc_id", "text"), **params).filter("removed_spans is not null").select("doc_id", "removed_spans", "removed_bytes", "first_doc_ids", "text")
