"""Recorded fetches replayed: retries, byte budgets, redirects, batches, and what was saved twice."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftarc.functions.media import is_retryable, retry_delay_ms
from weftarc.functions.tables import written
from weftarc.functions.urls import network_target, with_url
from weftarc.sources.text_scans import javascript_references

MAX_RETRIES = 2
SOURCES = ("dom", "css", "performance", "cdp", "runtime")


def retry_outcomes(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """resource_id, attempts used, outcome, status, exhausted, timed_out, delay_ms of each resource.

    ``attempts``: resource_id, attempt (from 1), status, timed_out, thrown, retry_after_ms. A 2xx status ends the
    loop well. Time-outs and retryable statuses are tried again up to ``max_retries`` times; other statuses and
    thrown errors end it. Attempts recorded after the end are ignored.
    """
    good = ~F.col("timed_out") & ~F.col("thrown") & F.coalesce(F.col("status").between(200, 299), F.lit(False))
    again = ~F.col("thrown") & (F.col("timed_out") | is_retryable(F.col("status")))
    ends = good | ~again | (F.col("attempt") > max_retries)
    last = F.min(F.when(ends, F.col("attempt"))).over(Window.partitionBy("resource_id"))
    used = attempts.withColumn("good", good).withColumn("again", again).withColumn("last", last).filter("last is null or attempt <= last")
    delay = F.when(F.coalesce(F.col("attempt") < F.col("last"), F.lit(True)), retry_delay_ms(F.col("attempt"), F.col("retry_after_ms"))).otherwise(0)
    final = F.max_by(F.struct("good", "again", "status", "timed_out", "last"), "attempt")
    done = used.withColumn("delay", delay).groupBy("resource_id").agg(F.max("attempt").cast("long").alias("attempts"), final.alias("f"), F.sum("delay").alias("delay_ms"))
    outcome = F.when(F.col("f.good"), "succeeded").when(F.col("f.last").isNull(), "pending").otherwise("failed")
    return done.select(
        "resource_id", "attempts", outcome.alias("outcome"), F.when(~F.col("f.timed_out"), F.col("f.status")).alias("status"),
        ((outcome == "failed") & F.col("f.again")).alias("exhausted"), ((outcome == "failed") & F.col("f.timed_out")).alias("timed_out"), "delay_ms",
    )


def _fold_budget(batches: Iterator[pa.RecordBatch], file_limit: int, total_limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by job and index with their outcome; only the job's sum is kept."""
    job, used = object(), 0
    for batch in batches:
        outcomes = []
        for of, size in zip(batch["job_id"].to_pylist(), batch["bytes"].to_pylist(), strict=True):
            if of != job:
                job, used = of, 0
            outcome = "file-limit" if size > file_limit else "total-limit" if used + size > total_limit else "saved"
            used += size if outcome == "saved" else 0
            outcomes.append(outcome)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(outcomes, pa.string())], names=[*batch.schema.names, "outcome"])


def within_budget(resources: DataFrame, file_limit: int, total_limit: int) -> DataFrame:
    """job_id, index, bytes and outcome (saved, file-limit, total-limit) of each resource, in the order of index.

    A resource that would pass the job's total is left out and takes nothing, so a smaller one after it may still
    fit; a running sum cannot say that, so a job's sorted rows are gone through in order, a batch at a time: however
    large a job is, its task holds one batch and a number.
    """
    rows = resources.select("job_id", F.col("index").cast("long").alias("index"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    kind = T.StructType([*rows.schema.fields, T.StructField("outcome", T.StringType())])
    return rows.repartition("job_id").sortWithinPartitions("job_id", "index", "bytes").mapInArrow(lambda it: _fold_budget(it, file_limit, total_limit), kind)


def batch_summaries(results: DataFrame) -> DataFrame:
    """job_id, counts by state, saved bytes and the batch's status, of job_id, state, bytes, is_primary, interruption."""
    state = F.col("state")
    fatal = F.bool_or(F.col("is_primary") & (state == "failed"))
    cancelled, paused = (F.bool_or(F.coalesce(F.col("interruption") == k, F.lit(False))) for k in ("cancel", "pause"))
    unsaved = F.count_if(state != "saved")
    status = F.when(fatal, "failed").when(cancelled, "cancelled").when(paused, "paused").when(unsaved > 0, "completed-with-errors").otherwise("completed")
    counts = [F.count_if(state == k).alias(f"n_{k.replace('-', '_')}") for k in ("saved", "failed", "aborted", "not-started")]
    return results.groupBy("job_id").agg(*counts, F.sum(F.when(state == "saved", F.coalesce("bytes", F.lit(0))).otherwise(0)).alias("saved_bytes"), status.alias("status"))


def redirect_faults(traces: DataFrame) -> DataFrame:
    """resource_id, fault of traces (original_url, final_url, complete, hops of from_url, to_url): gaps and wrong ends; null for sound ones."""
    hops, n = F.col("hops"), F.size("hops")
    gap = F.exists(F.zip_with(F.slice(hops, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(hops, F.lit(2), F.greatest(n - 1, F.lit(1))), lambda a, b: a["to_url"] != b["from_url"]), lambda x: x)
    fault = (
        F.when(~F.col("complete"), F.when(n > 0, "hops-of-an-incomplete-trace"))
        .when(n == 0, F.when(F.col("original_url") != F.col("final_url"), "no-hops"))
        .when(F.get(hops, F.lit(0))["from_url"] != F.col("original_url"), "wrong-start")
        .when(F.element_at(hops, -1)["to_url"] != F.col("final_url"), "wrong-end")
        .when((n > 1) & gap, "gap")
    )
    return traces.select("resource_id", fault.alias("fault"))


def blocked_responses(responses: DataFrame, grants: DataFrame) -> DataFrame:
    """resource_id, stage, redirect_index, reason of the first URL of a response's way that must not be read.

    The way is the original URL, the hops of a complete trace, the final URL. ``grants``: pattern.
    """
    hop = lambda url, stage, k: F.struct(url.alias("url"), F.lit(stage).alias("stage"), k.alias("redirect_index"))
    none = F.lit(None).cast("int")
    middle = F.when(F.col("complete"), F.transform("hops", lambda h, k: hop(h["to_url"], "redirect", k.cast("int")))).otherwise(F.array().cast("array<struct<url: string, stage: string, redirect_index: int>>"))
    way = F.concat(F.array(hop(F.col("original_url"), "original", none)), middle, F.array(hop(F.col("final_url"), "final", none)))
    steps = with_url(responses.select("resource_id", F.posexplode(way).alias("seq", "w")).select("resource_id", "seq", "w.*"), "url", "u")
    seen = steps.withColumn("t", network_target(F.col("url"), F.col("u"))).join(grants.select(F.col("pattern").alias("granted")).distinct(), F.col("t.pattern") == F.col("granted"), "left")
    reason = F.coalesce("t.reason", F.when(F.col("granted").isNull(), "permission-denied"))
    return seen.withColumn("reason", reason).filter("reason is not null").groupBy("resource_id").agg(F.min_by(F.struct("stage", "redirect_index", "reason"), "seq").alias("f")).select("resource_id", "f.*")


def reconciled(records: DataFrame) -> DataFrame:
    """job_id, id, state, error, sources: records that ended at one URL become one.

    ``records``: job_id, id, is_primary, state, original_url, final_url, sources (array). Saved secondary records
    of a job with the same normal final URL: the one with the least id stays and gets all their sources, in the
    order of SOURCES; the others fail. Other records stay as they are.
    """
    known = with_url(records.withColumn("ended", F.coalesce("final_url", "original_url")), "ended", "u")
    take = (F.col("state") == "saved") & ~F.col("is_primary")
    bad = take & F.col("u.href").isNull()
    key = F.when(take & ~bad, F.col("u.href"))
    group = Window.partitionBy("job_id", "key")
    rows = known.withColumn("bad", bad).withColumn("key", key).withColumn("rn", F.row_number().over(group.orderBy(F.collate("id", "UNICODE"), "id")))
    everything = F.flatten(F.collect_set("sources").over(group))
    united = F.filter(F.array(*map(F.lit, SOURCES)), lambda s: F.array_contains(everything, s))
    lost = F.col("key").isNotNull() & (F.col("rn") > 1)
    return rows.select(
        "job_id", "id", F.when(F.col("bad") | lost, "failed").otherwise(F.col("state")).alias("state"),
        F.when(F.col("bad"), "final-url").when(lost, "duplicate-final-url").alias("error"),
        F.when(F.col("key").isNotNull() & ~lost, united).otherwise(F.col("sources")).alias("sources"),
    )


def script_closure(scripts: DataFrame, responses: DataFrame, max_rounds: int = 8) -> DataFrame:
    """job_id, url, round: what saved scripts refer to, and the scripts among it, and so on, each URL of a job once.

    ``scripts`` and ``responses``: job_id, url, text; what has no response is found but leads no further.
    """
    known = written(with_url(scripts.select("job_id", F.col("url").alias("given")), "given", "u").select("job_id", F.col("u.href").alias("url")).distinct(), "closure-known")
    frontier, found = scripts, None
    for k in range(1, max_rounds + 1):
        refs = frontier.select("job_id", F.col("url").alias("base"), F.explode(javascript_references("text")).alias("r")).select("job_id", "base", "r.raw_url")
        urls = with_url(refs, "raw_url", "u", "base").filter(F.col("u.scheme").isin("http", "https")).select("job_id", F.col("u.href").alias("url")).distinct()
        new = written(urls.join(known, ["job_id", "url"], "left_anti").withColumn("round", F.lit(k)), "closure-round")
        found = new if found is None else found.unionByName(new)
        if new.isEmpty():
            break
        known = known.unionByName(new.drop("round"))
        scripted = F.lower(F.regexp_extract("url", r"^[^?#]*\.([^./?#]+)", 1)).isin("js", "mjs", "cjs")
        frontier = new.filter(scripted).join(responses, ["job_id", "url"]).select("job_id", "url", "text")
    return found


def with_metadata(records: DataFrame, metadata: DataFrame) -> DataFrame:
    """``records`` (id, final_url, http_status, mime_type) with what responses said (id, final_url, http_status, mime_type).

    Final URL and status are taken as they are; the media type only where the response has one.
    """
    new = metadata.select("id", *[F.col(c).alias(f"__{c}") for c in ("final_url", "http_status", "mime_type")], F.lit(True).alias("__seen"))
    joined = records.join(new, "id", "left")
    taken = {c: F.when(F.col("__seen"), F.col(f"__{c}")).otherwise(F.col(c)) for c in ("final_url", "http_status")}
    return joined.withColumns(taken | {"mime_type": F.coalesce("__mime_type", "mime_type")}).select(records.columns)


def batch_faults(records: DataFrame) -> DataFrame:
    """batch_id, fault of batches (batch_id, id, job_id, is_primary) that must not start: repeated ids, several jobs, not one primary."""
    summed = records.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("job_id").alias("jobs"), F.count_if("is_primary").alias("primaries"))
    faults = F.array(F.when(F.col("ids") < F.col("n"), "repeated-id"), F.when(F.col("jobs") != 1, "several-jobs"), F.when(F.col("primaries") != 1, "not-one-primary"))
    return summed.select("batch_id", F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("fault"))
