"""Quality rules with robust multivariate outliers.

Every text gives five counts (words, characters in words, symbols, repeated lines, words in repeated
three-word windows). A base rule rejects short and repetitive texts. Of the others, the transformed counts
are held against a minimum-covariance-determinant estimate of their language and source, and texts at a
large Mahalanobis distance are rejected.

The estimate: from each of ``STARTS`` beginnings a group's ``KEPT_SHARE`` nearest rows are taken and their mean and
covariance made, again and again until the determinants fall no further; the beginning that ends with the least
determinant gives the estimate. Groups are (language, source), (language, any) and (any, any), each of all its
rows. A group of n rows is drawn towards the next wider one by n to ``PRIOR_ROWS``: of one row hardly anything
counts, of very many nearly all, and no size is a special case.

Scale: every concentration step is one aggregation by group, beginning and distance bin, with partial sums on
the map side, so a group that holds a third of the rows is never in one task. The statistics are fixed-point
integers, so sums are exact and do not depend on the order of rows. Rows of the bin at the border all count for
the same part of themselves, so equal rows are treated alike and the kept rows weigh exactly ``KEPT_SHARE``.

Edge cases: a null or empty text has no words and fails the base rule. A null language or source is a value
like any other. A group of one row, or of equal rows, has no spread of its own and gets ``LEAST_SPREAD`` and what
the wider groups give. An empty table gives an empty result. Repeated rows each get their own, equal verdict.
Columns of the input other than doc_id, text, lang and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftarc.llm import flat
from weftarc.llm.scratch import stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

#: Distance beyond which a text is rejected. Texts are far from normal, so it is well above a chi-square quantile.
CUTOFF = 6.5
STARTS = 3
MAX_STEPS = 20
#: Steps end when no determinant falls by more than this share.
TOLERANCE = 1e-3
#: Rows of its own with which a group counts as much as the wider group does.
PRIOR_ROWS = 200
KEPT_SHARE = 0.75
#: Least standard deviation of each statistic; else a group without symbols would reject the first symbol.
LEAST_SPREAD = (0.10, 0.50, 0.50, 0.10)
UNIT = 4096  # fixed-point steps in 1.0
DIMS = 4
MAX_BROADCAST_GROUPS = 50_000

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS_TYPE = T.StructType([T.StructField(k, T.LongType()) for k in STATS])
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def count_slice(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The counts of STATS for each row of a slice."""
    n_rows = len(offsets) - 1
    starts, ends, first = flat.words(buf, offsets)
    n_words = np.diff(first)
    in_word = flat.WORD_BYTE[buf]
    word_chars = flat.per_row(in_word & ((buf & 0xC0) != 0x80), offsets)
    n_symbols = flat.per_row(_IS_SYMBOL[buf], offsets)
    spans = flat.Spans(buf)

    cuts = np.flatnonzero(buf == 10)
    line_starts = np.unique(np.concatenate((offsets[:-1], cuts + 1)))
    line_starts = line_starts[line_starts < len(buf)]
    line_ends = np.append(line_starts[1:], len(buf))
    # a line ends before its newline, a row's last line at the row's end
    line_ends = np.where((line_ends > line_starts) & (buf[line_ends - 1] == 10), line_ends - 1, line_ends) if len(line_starts) else line_ends[:0]
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_rows = np.searchsorted(offsets, line_starts, "right") - 1
    keys = flat.within_rows(spans.hashes(line_starts, line_ends), line_rows)
    _, kept = np.unique(keys, return_index=True)
    n_dup_lines = np.bincount(line_rows, minlength=n_rows) - np.bincount(line_rows[kept], minlength=n_rows)

    flags = np.zeros(len(starts), bool)
    if len(starts) > 2:
        rows = flat.row_numbers(first)
        of = spans.hashes(starts, ends)
        triples = flat.mix(of[:-2] + flat.mix(of[1:-1] + flat.mix(of[2:])))
        whole = np.flatnonzero(rows[:-2] == rows[2:])
        keys = flat.within_rows(triples[whole], rows[whole])
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = whole[order[twice]]
        for k in range(3):
            flags[at + k] = True
    n_repeat_words = flat.per_row(flags, first)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words]


@F.arrow_udf(STATS_TYPE)
def text_stats(text: pa.Array) -> pa.Array:
    """STATS of each whole text."""
    parts = [count_slice(buf, offsets) for _, _, buf, offsets in flat.slices(text)]
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(len(STATS))]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(STATS))


# Else Spark counts a text twice where a filter on the counts can go below a join: once for it, once for the rest.
text_stats = text_stats.asNondeterministic()


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def transformed(stats: Column) -> list[Column]:
    """Four statistics in fixed point: log mean word length, log shares of symbols and of repeated lines, root of the repeated share."""
    n = F.greatest(stats["n_words"], F.lit(1))
    values = [
        F.log(F.greatest(stats["word_chars"], F.lit(1)) / n),
        F.log1p(100 * stats["n_symbols"] / n),
        F.log1p(100 * stats["n_dup_lines"] / n),
        F.sqrt(stats["n_repeat_words"] / n),
    ]
    return [F.least(F.rint(v * UNIT), F.lit(16.0 * UNIT)).cast("long") for v in values]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def _sized(params: DataFrame) -> DataFrame:
    """Marked for broadcast only if it is counted to be small; else Spark joins by shuffles and splits skewed keys."""
    return F.broadcast(params) if params.count() <= MAX_BROADCAST_GROUPS else params


def group_columns(lang: Column, source: Column) -> list[Column]:
    """Keys without nulls: '=' and the value, or '-' for null. '*' is free to stand for any."""
    return [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")).alias(k) for c, k in ((lang, "lang_k"), (source, "source_k"))]


def _distance(xs: list[Column]) -> Column:
    d = [xs[i] / UNIT - F.col(f"m{i}") for i in range(DIMS)]
    return reduce(lambda a, b: a + b, [(1 if i == j else 2) * F.col(f"s{i}{j}") * d[i] * d[j] for i, j in _pairs()])


GROUP = ("lang_key", "source_key")
_MOMENTS = [*(f"m{i}" for i in range(DIMS)), *(f"c{i}{j}" for i, j in _pairs())]
_PARAMS = "lang_key string, source_key string, start int, n_group long, det double, " + ", ".join(f"{k} double" for k in (*_MOMENTS, *(f"s{i}{j}" for i, j in _pairs())))


def matrices(columns: dict[str, np.ndarray], name: str) -> np.ndarray:
    """(rows, DIMS, DIMS) of columns like c01."""
    out = np.empty((len(columns[f"{name}00"]), DIMS, DIMS))
    for i, j in _pairs():
        out[:, i, j] = out[:, j, i] = columns[f"{name}{i}{j}"]
    return out


def _solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Means, covariances, their determinants and inverses from weighted sums; spreads are kept above LEAST_SPREAD."""
    for f in frames:
        n = f["weight"].to_numpy(float)
        mean = np.stack([f[f"x{i}"].to_numpy(float) for i in range(DIMS)], 1) / n[:, None] / UNIT
        cov = matrices({f"c{i}{j}": f[f"x{i}{j}"].to_numpy(float) / n / UNIT**2 - mean[:, i] * mean[:, j] for i, j in _pairs()}, "c") + np.diag(np.square(LEAST_SPREAD))
        inv = np.linalg.inv(cov)
        out = {k: f[k] for k in (*GROUP, "start", "n_group")} | {"det": np.linalg.det(cov)} | {f"m{i}": mean[:, i] for i in range(DIMS)}
        yield pd.DataFrame(out | {f"{k}{i}{j}": of[:, i, j] for k, of in (("c", cov), ("s", inv)) for i, j in _pairs()})


def _diagonal(q: DataFrame, start: int, middle: list[Column], spread: list[Column]) -> DataFrame:
    return q.select(
        *GROUP, F.lit(start).alias("start"), *[m.alias(f"m{i}") for i, m in enumerate(middle)],
        *[(1 / spread[i] if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in _pairs()],
    )


def _starts(rows: DataFrame) -> DataFrame:
    """The beginnings of each group: medians with quartile ranges, medians with equal spreads, means with variances.

    Percentiles are exact, of fixed-point values, of which there are a bounded number.
    """
    quartiles = [F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(DIMS)]
    q = stored(rows.groupBy(*GROUP).agg(*quartiles, *[F.avg(f"x{i}").alias(f"a{i}") for i in range(DIMS)], *[F.avg(F.col(f"x{i}") * F.col(f"x{i}")).alias(f"v{i}") for i in range(DIMS)]), "quality-quartiles")
    median, mean = ([c / UNIT for c in cs] for cs in ([F.col(f"q{i}")[1] for i in range(DIMS)], [F.col(f"a{i}") for i in range(DIMS)]))
    quartile = [F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / UNIT, 2) / 1.82 + LEAST_SPREAD[i] ** 2 for i in range(DIMS)]
    variance = [F.col(f"v{i}") / UNIT**2 - mean[i] * mean[i] + LEAST_SPREAD[i] ** 2 for i in range(DIMS)]
    equal = [F.lit(float(v) ** 2) for v in LEAST_SPREAD]
    return reduce(DataFrame.unionByName, [_diagonal(q, 0, median, quartile), _diagonal(q, 1, median, equal), _diagonal(q, 2, mean, variance)][:STARTS])


def distance_bin(squared: Column) -> Column:
    """Squared distances in bins of about one in a hundred."""
    return F.least(F.floor(F.log1p(F.greatest(squared, F.lit(0.0))) * 100), F.lit(1500)).cast("int")


def _step(rows: DataFrame, params: DataFrame) -> DataFrame:
    """A concentration step: estimates of the nearest KEPT_SHARE of each group's rows, for each beginning."""
    xs = [F.col(f"x{i}") for i in range(DIMS)]
    names = [*(f"x{i}" for i in range(DIMS)), *(f"x{i}{j}" for i, j in _pairs())]
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"x{i}") for i, x in enumerate(xs)], *[F.sum(xs[i] * xs[j]).alias(f"x{i}{j}") for i, j in _pairs()]]
    used = params.select(*GROUP, "start", *[f"m{i}" for i in range(DIMS)], *[f"s{i}{j}" for i, j in _pairs()])
    bins = rows.join(_sized(used), list(GROUP)).withColumn("bin", distance_bin(_distance(xs))).groupBy(*GROUP, "start", "bin").agg(*sums)
    group = Window.partitionBy(*GROUP, "start")
    before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = bins.withColumn("before", before).withColumn("n_group", F.sum("n").over(group))
    part = F.least(F.lit(1.0), (KEPT_SHARE * F.col("n_group") - F.col("before")) / F.col("n"))
    inner = inner.filter(F.col("before") < KEPT_SHARE * F.col("n_group")).withColumn("part", part)
    total = inner.groupBy(*GROUP, "start").agg(F.max("n_group").alias("n_group"), F.sum(F.col("part") * F.col("n")).alias("weight"), *[F.sum(F.col("part") * F.col(c)).alias(c) for c in names])
    return total.mapInPandas(_solve, _PARAMS)


def _least(params: DataFrame) -> DataFrame:
    """Of each group's beginnings the one with the least determinant, the first of equals."""
    return params.groupBy(*GROUP).agg(F.min_by(F.struct(*params.columns[2:]), F.struct("det", "start")).alias("p")).select(*GROUP, "p.*")


def _drawn(params: DataFrame, prior_rows: int) -> DataFrame:
    """The least estimates, each drawn towards the drawn estimate of the next wider group."""
    best = stored(_least(params), "quality-least")
    wider = best.filter("lang_key = '*'")
    out = [wider.select(*GROUP, *_MOMENTS)]
    for narrow, shared in (("lang_key != '*' and source_key = '*'", "source_key"), ("source_key != '*'", "lang_key")):
        up = wider.select(shared, *[F.col(k).alias(f"up_{k}") for k in _MOMENTS])
        both = best.filter(narrow).join(_sized(up), shared)
        n = F.col("n_group") / (F.col("n_group") + prior_rows)
        wider = both.select(*GROUP, *[(n * F.col(k) + (1 - n) * F.col(f"up_{k}")).alias(k) for k in _MOMENTS])
        out.append(wider)
    return reduce(DataFrame.unionByName, out)


def _inverted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        inv = np.linalg.inv(matrices({k: f[k].to_numpy() for k in _MOMENTS}, "c"))
        yield pd.DataFrame({k: f[k] for k in (*GROUP, *(f"m{i}" for i in range(DIMS)))} | {f"s{i}{j}": inv[:, i, j] for i, j in _pairs()})


_FITTED = "lang_key string, source_key string, " + ", ".join(f"{k} double" for k in (*(f"m{i}" for i in range(DIMS)), *(f"s{i}{j}" for i, j in _pairs())))


def fit(stats: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """Robust estimates by (language, source) of a table with columns lang, source and the struct stats."""
    s = F.col("stats")
    rows = stats.filter(~base_failed(s["n_words"], s["n_repeat_words"])).select(*group_columns(F.col("lang"), F.col("source")), *[x.alias(f"x{i}") for i, x in enumerate(transformed(s))])
    group = lambda lang, source: F.struct(lang.alias("lang_key"), source.alias("source_key"))
    levels = F.array(group(F.col("lang_k"), F.col("source_k")), group(F.col("lang_k"), F.lit("*")), group(F.lit("*"), F.lit("*")))
    rows = rows.select(F.explode(levels).alias("g"), *[f"x{i}" for i in range(DIMS)]).select("g.*", *[f"x{i}" for i in range(DIMS)])
    params, last = stored(_starts(rows), "quality-start"), None
    for _ in range(MAX_STEPS):
        params = stored(_step(rows, params), "quality-step")
        new = params.select(*GROUP, "start", F.col("det").alias("new_det"))
        if last is not None and new.join(last, [*GROUP, "start"]).filter(F.col("new_det") < (1 - TOLERANCE) * F.col("det")).isEmpty():
            break
        last = params.select(*GROUP, "start", "det")
    fitted = _drawn(params, prior_rows).mapInPandas(_inverted, _FITTED)
    return stored(fitted.filter("source_key != '*'").withColumnsRenamed({"lang_key": "lang_k", "source_key": "source_k"}), "quality-fitted")


def judged(docs: DataFrame, params: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` with a struct ``stats`` gets base_failed, distance (null if the base rule fails) and kept.

    A language and source of which no row passed the base rule has no estimate and needs none.
    """
    keyed = docs.select("*", *group_columns(F.col("lang"), F.col("source")))
    s = F.col("stats")
    return (
        keyed.join(_sized(params), ["lang_k", "source_k"], "left")
        .withColumn("base_failed", base_failed(s["n_words"], s["n_repeat_words"]))
        .withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(F.greatest(_distance(transformed(s)), F.lit(0.0)))))
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff))
        .drop("lang_k", "source_k", *[f"m{i}" for i in range(DIMS)], *[f"s{i}{j}" for i, j in _pairs()])
    )


def quality_verdicts(docs: DataFrame, cutoff: float = CUTOFF, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """doc_id, the five counts, base_failed, distance and kept of every row of ``docs`` (doc_id, text, lang, source)."""
    stats = stored(docs.select("doc_id", "lang", "source", text_stats("text").alias("stats")), "quality-stats")
    return judged(stats, fit(stats, prior_rows), cutoff).select("doc_id", *[F.col("stats")[k].alias(k) for k in STATS], "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, cutoff: float = CUTOFF, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were.

    Texts are read twice and never shuffled: once for the estimates, once to apply them.
    """
    names = docs.columns
    params = fit(stored(docs.select("lang", "source", text_stats("text").alias("stats")), "quality-stats"), prior_rows)
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "lang", "source", text_stats("text").alias("stats"))
    return judged(inner, params, cutoff).filter("kept").select("row.*")
