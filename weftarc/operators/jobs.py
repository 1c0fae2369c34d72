"""Capture jobs: their states replayed from events, history, results, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# The states of a job and those that may follow each. A paused job goes on where it was, or is cancelled.
TRANSITIONS = {
    "idle": ("preparing",),
    "preparing": ("discovering", "paused", "cancelling", "failed"),
    "discovering": ("fetching", "paused", "cancelling", "failed"),
    "fetching": ("rewriting", "paused", "cancelling", "failed"),
    "rewriting": ("packaging", "paused", "cancelling", "failed"),
    "packaging": ("completed", "paused", "cancelling", "failed"),
    "completed": (),
    "paused": (),
    "cancelling": ("cancelled",),
    "cancelled": (),
    "failed": ("retrying",),
    "retrying": ("preparing", "paused", "cancelling", "failed"),
}
TERMINAL = ("completed", "cancelled")


def next_state(status: str, resume: str | None, wanted: str) -> tuple[str, str | None] | None:
    """(status, state to resume) after a wanted change, or null if it is not allowed."""
    if status == "paused":
        return (wanted, None) if wanted == "cancelling" or wanted == resume else None
    if wanted not in TRANSITIONS.get(status, ()):
        return None
    return (wanted, status if wanted == "paused" else None)


def _fold_states(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows sorted by job and seq to the last state of each job; only the current job's state is kept."""
    job, state = None, None
    names = ("job_id", "status", "resume_status", "n_applied", "n_rejected")
    types = (kind, pa.string(), pa.string(), pa.int32(), pa.int32())
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    for batch in batches:
        done = []
        for of, wanted in zip(batch["job_id"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
            if state is None or of != job:
                if state is not None:
                    done.append((job, *state))
                job, state = of, ("idle", None, 0, 0)
            status, resume, good, bad = state
            new = next_state(status, resume, wanted)
            state = (status, resume, good, bad + 1) if new is None else (*new, good + 1, bad)
        if done:
            yield made(done)
    if state is not None:
        yield made([(job, *state)])


def replay(events: DataFrame) -> DataFrame:
    """job_id, status, resume_status, n_applied, n_rejected of job_id, seq, wanted: every job starts idle.

    A job's events are gone through in order; those that are not allowed change nothing and are counted. A task holds
    one batch of sorted events and one state, however many events a job has.
    """
    kind = T.StructType([events.schema["job_id"], *(T.StructField(k, t) for k, t in (("status", T.StringType()), ("resume_status", T.StringType()), ("n_applied", T.IntegerType()), ("n_rejected", T.IntegerType())))])
    arrow = to_arrow_type(events.schema["job_id"].dataType)
    return events.select("job_id", "seq", "wanted").repartition("job_id").sortWithinPartitions("job_id", "seq", "wanted").mapInArrow(lambda it: _fold_states(it, arrow), kind)


def history(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """The jobs that changed last: updated_at downwards, then id."""
    return jobs.orderBy(F.col("updated_at").desc(), "id").limit(limit)


def failures(records: DataFrame, most: int = 100) -> DataFrame:
    """job_id, rank, url, type of each job's first ``most`` failures (visual primaries first, then URL and type), with n_omitted."""
    order = Window.partitionBy("job_id").orderBy(F.col("is_primary_visual").desc(), "url", "type", "id")
    rows = records.filter("state = 'failed'").withColumn("rank", F.row_number().over(order))
    n = rows.groupBy("job_id").agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("n_omitted"))
    return rows.filter(F.col("rank") <= most).join(n, "job_id").select("job_id", "rank", "url", "type", "n_omitted")


def results(jobs: DataFrame, records: DataFrame, archives: DataFrame, most: int = 100) -> DataFrame:
    """job_id, status, archive_available, archive_bytes, n_failures, n_omitted of ended ``jobs`` (job_id, status); others have no row.

    ``records``: job_id, state. ``archives``: job_id, archive. Only a completed job has an archive. The failures are
    those of ``failures``, the first ``most`` of each job.
    """
    failed = records.filter("state = 'failed'").groupBy("job_id").agg(F.count(F.lit(1)).alias("n_failures"))
    sizes = archives.groupBy("job_id").agg(F.sum(F.octet_length("archive")).alias("size"))
    ended = jobs.filter(F.col("status").isin("completed", "failed", "cancelled")).join(failed, "job_id", "left").join(sizes, "job_id", "left")
    there = (F.col("status") == "completed") & (F.coalesce("size", F.lit(0)) > 0)
    n = F.coalesce("n_failures", F.lit(0).cast("long"))
    return ended.select("job_id", "status", there.alias("archive_available"), F.when(there, F.col("size")).alias("archive_bytes"), n.alias("n_failures"), F.greatest(n - most, F.lit(0).cast("long")).alias("n_omitted"))


def session_outcomes(events: DataFrame, wait_ms: int, grace_ms: int = 5000) -> DataFrame:
    """session_id, outcome, at_ms of capture sessions: the first of result, navigation, tab-closed, or the time-out.

    ``events``: session_id, at_ms since the start, kind. Sessions without events time out.
    """
    kinds = ("result", "navigation", "tab-closed")
    first = events.groupBy("session_id").agg(F.min(F.when(F.col("kind").isin(*kinds) & (F.col("at_ms") < wait_ms + grace_ms), F.struct("at_ms", "kind"))).alias("f"))
    return first.select("session_id", F.coalesce("f.kind", F.lit("timeout")).alias("outcome"), F.coalesce("f.at_ms", F.lit(wait_ms + grace_ms)).cast("long").alias("at_ms"))


def merged_counters(current: DataFrame, updates: DataFrame, names: list[str]) -> DataFrame:
    """``current`` (id and counters) with the values of ``updates`` where those are not null."""
    renamed = updates.select(F.col("id"), *[F.col(n).alias(f"__{n}") for n in names])
    return current.join(renamed, "id", "left").select("id", *[F.coalesce(f"__{n}", n).alias(n) for n in names])


# Bounds of a capture's settings.
BOUNDS = {"render_wait_ms": (0, 30_000), "concurrency": (1, 12), "max_retries": (0, 10)}


def settings_faults(settings: DataFrame) -> DataFrame:
    """job_id, fault of jobs whose settings (columns of BOUNDS, file_name) cannot be used."""
    outside = [F.when(F.col(c).isNull() | ~F.col(c).between(low, high), c) for c, (low, high) in BOUNDS.items()]
    name = F.trim(F.coalesce("file_name", F.lit("")))
    bad_name = F.when((name != "") & (name.rlike(r'[\x00-\x1f<>:"/\\|?*]') | name.rlike("[ .]$")), "file_name")
    return settings.select("job_id", F.explode(F.filter(F.array(*outside, bad_name), lambda f: f.isNotNull())).alias("fault"))
