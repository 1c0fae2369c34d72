"""Fill-in-middle transformation: texts cut at two chosen units and put together in another order.

Each text is decoded to an array of code points (UTF-32). The classes of neighbouring code points say where a unit
ends (``UNITS``: lines end after a newline, words before a word that follows white space, characters everywhere),
``flatnonzero`` gives the ends, two of them are taken by their ranks, and the three slices are encoded again.
Ranks, form and rate come from the SHA-256 of ``seed:doc_id``, so a rerun or a retried task gives the same.

Scale: one pass, no shuffle. A task holds one Arrow batch and the code points of one text (four bytes each).

Edge cases: a null text counts as empty. Empty texts and those that hold a marker stay plain: the output is the
text, prefix_chars and middle_chars are null. A null doc_id counts as an empty one. A very long text is taken whole;
rows with equal doc_id and text get the same output. An empty table gives none. Only doc_id and text are read, so
columns of any other names do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50

_LINE, _SPACE = np.zeros(128, np.uint8), np.zeros(128, np.uint8)
_LINE[10] = 1
_SPACE[[0x20, *range(0x09, 0x0E)]] = 1
#: For each kind of unit: the class of each code point (those beyond the table have class 0), and whether a unit ends between two classes.
UNITS = {
    "line": (_LINE, np.array([[False, False], [True, True]])),
    "word": (_SPACE, np.array([[False, False], [True, False]])),
    "char": (np.zeros(128, np.uint8), np.array([[True]])),
}


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.dtype("<u4"))


def encoded(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


def unit_ends(points: np.ndarray, units: str = "line") -> np.ndarray:
    """Where each unit ends, in code points; none in an empty text."""
    if not len(points):
        return np.zeros(0, np.int64)
    table, breaks = UNITS[units]
    classes = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 0)
    return np.append(np.flatnonzero(breaks[classes[:-1], classes[1:]]) + 1, len(points))


def rearranged(text: str, digest: str, units: str, rate: int, spm_rate: int) -> dict:
    """n, form, prefix_chars, middle_chars and output of one text, by the hexadecimal ``digest``."""
    points = code_points(text)
    ends = unit_ends(points, units)
    n = len(ends)
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not n or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text}
    first, last = np.append(0, ends)[sorted((h[0] % (n + 1), h[1] % (n + 1)))].tolist()
    prefix, middle, suffix = (encoded(p) for p in (points[:first], points[first:last], points[last:]))
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    output = SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if form == "spm" else PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return {"n": n, "form": form, "prefix_chars": first, "middle_chars": last - first, "output": output}


_KIND = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def rearranger(units: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE):
    """A column function of texts and their digests: struct<n, form, prefix_chars, middle_chars, output>."""

    @F.arrow_udf("struct<n: long, form: string, prefix_chars: long, middle_chars: long, output: string>")
    def rearrange(text: pa.Array, digest: pa.Array) -> pa.Array:
        rows = (rearranged(t.as_py() or "", d.as_py(), units, rate, spm_rate) for t, d in zip(text, digest, strict=True))
        return pa.array(rows, _KIND, size=len(text))

    return rearrange


def transform(docs: DataFrame, units: str = "line", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output of every row.

    Of a hundred texts about ``rate`` are rearranged, and of a hundred of those about ``spm_rate`` with the suffix first.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return docs.select("doc_id", rearranger(units, rate, spm_rate)("text", digest).alias("cut")).select("doc_id", "cut.*")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``form`` was made of. Markers cannot come about where pieces meet, as none overlaps another."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)))
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
