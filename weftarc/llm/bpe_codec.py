"""BPE encoding and decoding in batched numpy merge rounds.

Encoding normalises a text, cuts it into words, and merges the symbols of many words in one flat array, with
each round's lowest-ranked pairs found by binary search over the sorted pair keys. Decoding takes the ids'
strings and joins them as the tokenizer file says.

Scale: one pass, no shuffle; memory as for the token counts. Ids and texts pass between Spark and Python as
Arrow lists.

Edge cases: null and empty texts give no ids and decode to an empty text. Special strings in a text become
their ids. Files with word ends drop white space and case, so decoded texts are not the texts that were
encoded; the exact round trip is that of the ids' strings. Ids outside the table are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftarc.llm import bpe


def encode_batch(text: pa.Array, store: bpe.WordStore) -> pa.Array:
    """Lists of ids of whole texts; ``store`` has the words that the task has met."""
    table = store.table
    parts, counts = [np.zeros(0, np.int32)], np.zeros(len(text) + 1, np.int64)
    for rows, lists in bpe.word_groups(text, table):
        at = store.look_up(lists)
        parts.append(store.ids(at))
        counts[1:] += bpe.counts_of(rows, lists, store.sizes(at), len(text))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), pa.array(np.concatenate(parts)))


@lru_cache(maxsize=4)
def _strings(path: str) -> pa.Array:
    return pa.array(bpe.load(path).tokens, pa.large_string())


def decode_batch(ids: pa.Array, path: str) -> pa.Array:
    """The texts of lists of ids; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    where = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int64())
    strings = pa.LargeListArray.from_arrays(where, pc.take(_strings(path), ids.flatten()))
    return pc.binary_join(strings, pa.scalar(" ", pa.large_string())).cast(pa.string())


def encoder(path: str):
    """A column function: the ids of each text by the tokenizer file at ``path`` (on every machine)."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        store = bpe.WordStore(bpe.load(path))
        for text in batches:
            yield encode_batch(text, store)

    return ids


def decoder(path: str):
    """A column function: the texts of ids, their strings joined by spaces (the files have no decoder of their own)."""

    @F.arrow_udf("string")
    def texts(ids: pa.Array) -> pa.Array:
        return decode_batch(ids, path)

    return texts


def coder(path: str):
    """A column function: struct<token_ids, decoded_text> of each text; one pass where both are wanted."""

    @F.arrow_udf("struct<token_ids: array<int>, decoded_text: string>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        store = bpe.WordStore(bpe.load(path))
        for text in batches:
            ids = encode_batch(text, store)
            yield pa.StructArray.from_arrays([ids, decode_batch(ids, path)], names=["token_ids", "decoded_text"])

    return code


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and token_ids (array<int>) of every row."""
    return docs.select("doc_id", encoder(path)("text").alias("token_ids"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with decoded_text; a column of that name is replaced."""
    return encoded.withColumn("decoded_text", decoder(path)("token_ids"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, token_ids and decoded_text of every row, encoded and decoded in one pass."""
    return docs.select("doc_id", coder(path)("text").alias("coded")).select("doc_id", "coded.token_ids", "coded.decoded_text")
