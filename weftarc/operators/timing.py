"""Resource timings: valid entries, one for each page and URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftarc.functions.media import MAX_SAFE, initiator
from weftarc.functions.urls import with_url


def first_timings(entries: DataFrame) -> DataFrame:
    """page_id, url, initiator, start_ms, duration_ms, transfer_size, encoded_size, decoded_size: the first valid entry of each URL.

    ``entries``: page_id, name, entry_type, initiator_type, start_ms, duration_ms, transfer_size, encoded_size,
    decoded_size. Valid are resources at network URLs without credentials, with finite times and whole sizes of
    at least 0. First by start, then initiator.
    """
    finite = lambda c: F.coalesce((F.col(c) >= 0) & (F.col(c) < float("inf")) & ~F.isnan(c), F.lit(False))
    whole = lambda c: F.coalesce(F.col(c).between(0, MAX_SAFE), F.lit(False))
    valid = finite("start_ms") & finite("duration_ms") & whole("transfer_size") & whole("encoded_size") & whole("decoded_size")
    rows = with_url(entries.filter((F.col("entry_type") == "resource") & valid), "name", "u").filter(F.col("u.scheme").isin("http", "https") & (F.col("u.userinfo") == ""))
    row = F.struct("start_ms", initiator(F.col("initiator_type")).alias("initiator"), "duration_ms", "transfer_size", "encoded_size", "decoded_size")
    return rows.groupBy("page_id", F.col("u.href").alias("url")).agg(F.min(row).alias("r")).select("page_id", "url", "r.*")
