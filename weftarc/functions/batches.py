"""Arrow functions that go through a batch in pieces, so that the Python values of a whole batch are never there at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the texts of a piece; a longer text is a piece of its own.
PIECE_BYTES = 1 << 18
#: What a row counts besides its texts.
_ROW_BYTES = 256


def _lengths(column: pa.Array) -> np.ndarray:
    listed = pa.types.is_nested(column.type)
    n = pc.fill_null(pc.list_value_length(column) if listed else pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return n * _ROW_BYTES if listed else n


def pieces(columns: tuple[pa.Array, ...], size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """First row and number of rows of each piece of ``columns`` (texts, or lists of what has about _ROW_BYTES)."""
    sizes = sum((_lengths(c) for c in columns), np.full(len(columns[0]), _ROW_BYTES))
    first = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // size, prepend=-1))
    return zip(first.tolist(), np.diff(first, append=len(sizes)).tolist(), strict=True)


def each(f: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``f`` of the values of each row of ``columns``, as an array of ``kind``."""
    done = list(_done(f, kind, columns))
    return pa.concat_arrays(done) if done else pa.array([], kind)


def handed_on(f: Callable, kind: pa.DataType, batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """The same of batches of columns, one after the other; each piece is handed on when it is done, so that the result of a whole batch is never there."""
    for columns in batches:
        yield from _done(f, kind, columns)


def _done(f: Callable, kind: pa.DataType, columns: tuple[pa.Array, ...]) -> Iterator[pa.Array]:
    for at, n in pieces(columns):
        yield pa.array([f(*values) for values in zip(*(c.slice(at, n).to_pylist() for c in columns), strict=True)], kind)
