"""Language identification by a byte convolutional network.

The network looks at a window of ``WINDOW`` bytes: an embedding of each byte, filters of several widths, ReLU,
the maximum of each filter over the window, and a softmax. It is trained in numpy on the driver, on a bounded
sample: about ``ROWS_PER_LANG`` labelled rows of each language (chosen by a hash of their ids and texts), at
``WINDOWS_PER_ROW`` places each. It is applied to every window of every whole text; a text's probabilities are
the mean of its windows', weighted by their bytes.

Scale: the sample's size does not depend on the table's; the weights are a few kilobytes and go with the
tasks. Texts are read once, and nothing is shuffled. A task works on slices of about half a megabyte, so a
very long text costs time in proportion and a bounded number of bytes of memory for each of its own.

Edge cases: texts that are null or have no letter are ``und`` with score 0. Rows without an id are not held
out and are not learned from; nor are rows without a text or language. With no labelled rows all texts are
``und``. Repeated rows get equal results. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftarc.llm import flat

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
EMBEDDING = 8
ROWS_PER_LANG = 1000
WINDOWS_PER_ROW = 8
MAX_LANGS = 256
STEPS, BATCH, RATE = 1200, 64, 0.01
UNDETERMINED = "und"

_LOWER = np.frombuffer(flat.LOWER, np.uint8)


@dataclass(frozen=True)
class Model:
    """langs and weights: embedding (256, EMBEDDING); filters and their biases by width; output and its bias."""

    langs: tuple[str, ...]
    embedding: np.ndarray
    filters: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]
    out: np.ndarray
    out_bias: np.ndarray


def _forward(p: dict, windows: np.ndarray):
    """Pooled filters (rows, all filters), the place of each maximum, and class probabilities of (rows, WINDOW) bytes."""
    x = p["embedding"][windows]
    pooled, places = [], []
    for w in WIDTHS:
        patches = np.lib.stride_tricks.sliding_window_view(x, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), x.shape[1] - w + 1, -1)
        z = patches @ p[f"filters{w}"] + p[f"bias{w}"]
        at = z.argmax(axis=1)
        places.append(at)
        pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
    raw = np.concatenate(pooled, 1)
    logits = np.maximum(raw, 0) @ p["out"] + p["out_bias"]
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raw, places, e / e.sum(axis=1, keepdims=True)


def _gradients(p: dict, windows: np.ndarray, labels: np.ndarray) -> dict:
    raw, places, prob = _forward(p, windows)
    n = len(windows)
    d = prob.copy()
    d[np.arange(n), labels] -= 1
    d /= n
    pooled = np.maximum(raw, 0)
    g = {"out": pooled.T @ d, "out_bias": d.sum(0), "embedding": np.zeros_like(p["embedding"])}
    back = (d @ p["out"].T) * (raw > 0)
    for k, w in enumerate(WIDTHS):
        part = back[:, k * FILTERS : (k + 1) * FILTERS]
        at = places[k][:, :, None] + np.arange(w)
        read = np.take_along_axis(windows[:, None, :], at, 2)  # the bytes under each maximum
        patch = p["embedding"][read].reshape(n, FILTERS, -1)
        g[f"filters{w}"] = np.einsum("nf,nfd->df", part, patch)
        g[f"bias{w}"] = part.sum(0)
        into = np.einsum("nf,df->nfd", part, p[f"filters{w}"]).reshape(n, FILTERS, w, EMBEDDING)
        np.add.at(g["embedding"], read, into)
    return g


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = STEPS, seed: int = 0) -> Model:
    """A network for windows (rows, WINDOW) of bytes and class numbers, by Adam on batches balanced over the languages."""
    rng = np.random.default_rng(seed)
    n = len(langs)
    p = {"embedding": rng.normal(0, 0.3, (256, EMBEDDING)), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, n)), "out_bias": np.zeros(n)}
    for w in WIDTHS:
        p |= {f"filters{w}": rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)), f"bias{w}": np.zeros(FILTERS)}
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    members = [np.flatnonzero(labels == c) for c in range(n)]
    for t in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(members[c], -(-BATCH // n)) for c in range(n)])
        rate = RATE * (1 - t / (steps + 1))
        seen = windows[chosen].copy()
        # a third of the windows are shortened, so that short texts are learned too
        short = rng.random(len(chosen)) < 1 / 3
        seen[short[:, None] & (np.arange(WINDOW) >= rng.integers(4, WINDOW, len(chosen))[:, None])] = 0
        for k, v in _gradients(p, seen, labels[chosen]).items():
            mean[k] += 0.1 * (v - mean[k])
            square[k] += 0.001 * (v * v - square[k])
            p[k] -= rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
    f32 = {k: v.astype(np.float32) for k, v in p.items()}
    return Model(tuple(langs), f32["embedding"], tuple(f32[f"filters{w}"] for w in WIDTHS), tuple(f32[f"bias{w}"] for w in WIDTHS), f32["out"], f32["out_bias"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(windows, labels, languages) of about ``rows_per_lang`` rows of each language that are not held out."""
    rows = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    langs = sorted(counts)
    if not langs:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, rows_per_lang / counts[k]))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(1 << 30)
    data = F.encode("text", "UTF-8")
    room = F.greatest(F.octet_length("text") - WINDOW, F.lit(0)) + 1
    cut = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_PER_ROW - 1)), lambda k: F.substring(data, F.pmod(F.xxhash64("doc_id", k), room).cast("int") + 1, F.lit(WINDOW)))
    found = rows.filter(draw < F.try_element_at(share, F.col("lang"))).select("doc_id", "lang", F.posexplode(cut).alias("k", "bytes")).orderBy("doc_id", "lang", "k").collect()
    windows = np.zeros((len(found), WINDOW), np.uint8)
    for w, r in zip(windows, found, strict=True):
        w[: len(r["bytes"])] = _LOWER[np.frombuffer(bytes(r["bytes"]), np.uint8)]
    of = {k: i for i, k in enumerate(langs)}
    labels = np.array([of[r["lang"]] for r in found], np.int64)
    present = sorted(set(labels.tolist()))
    return windows, np.searchsorted(present, labels), [langs[i] for i in present]


class Tables:
    """For each filter, its response to any two neighbouring bytes, so that a response is one or two look-ups."""

    def __init__(self, model: Model):
        self.of = []
        for w, filters, bias in zip(WIDTHS, model.filters, model.biases, strict=True):
            single = [model.embedding @ filters[k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(w)]
            steps = []
            for k in range(0, w, 2):
                t = single[k][:, None] + single[k + 1][None] if k + 1 < w else single[k][:, None] + np.zeros((1, 256, 1), np.float32)
                steps.append((k, np.ascontiguousarray((t.reshape(1 << 16, FILTERS) + (bias if k == 0 else 0)).T.astype(np.float32))))
            self.of.append((w, steps))


@lru_cache(maxsize=2)
def _tables(key: int, holder) -> Tables:
    return Tables(holder.model)


class Holder:
    """A model with a key, so that a worker builds its tables once."""

    def __init__(self, model: Model):
        self.model = model
        self.key = int(flat.mix(np.concatenate([model.out.ravel(), model.embedding.ravel()]).view(np.uint32).astype(np.uint64)).sum() >> np.uint64(1))

    def __eq__(self, other) -> bool:
        return isinstance(other, Holder) and self.key == other.key

    def __hash__(self) -> int:
        return hash(self.key)


def probabilities(model: Model, tables: Tables, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, languages): mean probabilities over each row's windows; zero for rows without bytes."""
    sizes = np.diff(offsets)
    n_windows = -(-sizes // WINDOW)
    out = np.zeros((len(sizes), len(model.langs)))
    if not len(buf):
        return out
    row = np.repeat(np.arange(len(sizes)), n_windows)
    first = np.concatenate(([0], np.cumsum(n_windows)))
    starts = offsets[row] + (np.arange(len(row)) - first[row]) * WINDOW
    data = _LOWER[buf].astype(np.intp)
    n = len(data)
    padded = np.concatenate((data, np.zeros(max(WIDTHS) + 1, np.intp)))
    pair = padded[:-1] * 256 + padded[1:]
    pooled = np.empty((len(row), len(WIDTHS) * FILTERS), np.float32)
    z, more = np.empty(n, np.float32), np.empty(n, np.float32)
    for k, (w, steps) in enumerate(tables.of):
        # a filter must not reach into the next row
        beyond = (offsets[1:, None] - np.arange(1, w)).ravel()
        beyond = beyond[(beyond >= 0) & (beyond < n)]
        for f in range(FILTERS):
            np.take(steps[0][1][f], pair[:n], out=z, mode="clip")
            for at, table in steps[1:]:
                np.take(table[f], pair[at : at + n], out=more, mode="clip")
                np.add(z, more, out=z)
            z[beyond] = 0
            pooled[:, k * FILTERS + f] = np.maximum.reduceat(z, starts)
    logits = np.maximum(pooled, 0) @ model.out + model.out_bias
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    weight = np.minimum(WINDOW, offsets[row + 1] - starts)
    prob = e / e.sum(axis=1, keepdims=True) * weight[:, None]
    some = np.flatnonzero(n_windows)
    out[some] = np.add.reduceat(prob, first[some], axis=0) / sizes[some, None]
    return out


def predictor(model: Model):
    """A column function: struct<lang, score> of whole texts."""
    holder = Holder(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(text: pa.Array) -> pa.Array:
        tables = _tables(holder.key, holder)
        prob = np.concatenate([np.zeros((0, len(model.langs)))] + [probabilities(model, tables, buf, offsets) for _, _, buf, offsets in flat.slices(text)])
        best = prob.argmax(axis=1) if len(prob) else np.zeros(0, np.int64)
        score = np.clip(prob[np.arange(len(best)), best], 0, 1)
        return pa.StructArray.from_arrays([pa.array(np.array(model.langs, object)[best], pa.string()), pa.array(score.astype(np.float64))], names=["lang", "score"])

    return predict


def identify(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, by a network trained on rows that are not held out."""
    windows, labels, langs = sample(docs, rows_per_lang)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    if not langs:
        return out.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    model = train(windows, labels, langs)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = out.select("doc_id", "held_out", letters.alias("letters"), predictor(model)("text").alias("p"))
    return found.select("doc_id", "held_out", F.when(F.col("letters"), F.col("p.lang")).otherwise(UNDETERMINED).alias("lang_pred"), F.when(F.col("letters"), F.col("p.score")).otherwise(0.0).alias("score"))
