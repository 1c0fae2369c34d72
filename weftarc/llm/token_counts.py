"""Token counts of whole texts by rank-synchronous merging of ragged arrays.

The words (pre-tokens) of many texts are held as one ragged numpy array; each round merges every word's
lowest-ranked pair at once, and the symbols that survive are the tokens. A task keeps the counts of words
that it has met, so a word is merged about once for each task.

Scale: one pass, no shuffle. A task holds one Arrow batch, the words of about ``bpe.GROUP_CHARS`` of text
and a bounded store of words; a long text is counted piece by piece.

Edge cases: null and empty texts have no tokens. Special strings (``<|endoftext|>``) in a text are one token
each, as the tokenizer file's library does by default. Repeated rows each get their count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftarc.llm import bpe

LIMIT = 1024


def token_counter(path: str):
    """A column function: the tokens of each text by the tokenizer file at ``path`` (on every machine)."""

    @F.arrow_udf("long")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        store = bpe.WordStore(bpe.load(path))
        for text in batches:
            counts = np.zeros(len(text), np.int64)
            for rows, lists in bpe.word_groups(text, store.table):
                counts += bpe.counts_of(rows, lists, store.sizes(store.look_up(lists)), len(text))
            yield pa.array(counts)

    return n_tokens


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (of the UTF-8 text), n_tokens, over_limit (more than ``limit`` tokens) of every row."""
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_counter(path)("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
