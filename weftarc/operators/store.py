"""Tables of jobs and their records, changed by making the new table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftarc.operators.jobs import TERMINAL, TRANSITIONS


def replaced(current: DataFrame, incoming: DataFrame, scope: str = "job_id") -> DataFrame:
    """``current`` with all rows of each ``scope`` that ``incoming`` has replaced by ``incoming``'s."""
    return current.join(incoming.select(scope).distinct(), scope, "left_anti").unionByName(incoming)


def updated_jobs(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """``jobs`` (id, status) with the statuses of ``changes`` (id, status); a change that is not allowed is an error."""
    pairs = reduce(lambda x, y: x | y, [(F.col("status") == k) & F.col("__new").isin(*v) for k, v in TRANSITIONS.items() if v])
    joined = jobs.join(changes.select("id", F.col("status").alias("__new")), "id", "left")
    wrong = F.raise_error(F.concat(F.col("status"), F.lit(" can not become "), F.col("__new")))
    status = F.when(F.col("__new").isNull(), F.col("status")).when(pairs, F.col("__new")).otherwise(wrong)
    return joined.withColumn("status", status).drop("__new")


def without_old(jobs: DataFrame, records: DataFrame, before) -> tuple[DataFrame, DataFrame]:
    """Jobs and records without terminal jobs last changed before a time; records go with their jobs."""
    gone = jobs.filter(F.col("status").isin(*TERMINAL) & (F.col("updated_at") < before)).select("id")
    return jobs.join(gone, "id", "left_anti"), records.join(gone.select(F.col("id").alias("job_id")), "job_id", "left_anti")


def without_history(jobs: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only jobs that are still active (neither terminal nor failed) and their records."""
    kept = jobs.filter(~F.col("status").isin(*TERMINAL, "failed"))
    return kept, records.join(kept.select(F.col("id").alias("job_id")), "job_id", "left_semi")
