"""Archives that say what is in them: manifests, original URLs, a report and a note as entries beside the resources.

First, from records alone and the hashes of the entries' bytes, each job's manifests are made; then all entries, these among them, are
packed by ``zip_archives``. Only jobs whose entries agree with their records and whose offline audit passes are packed.

Scale: a manifest is one text of its job, made by one aggregation over the job's records without their data; everything else stays rows.
Equal input gives equal bytes: lists in manifests are sorted, and no time but that of the capture is written.

Edge cases: a job without records has empty manifests and a report without rows. Entries that would lie in the way of the manifests are an
error. Records that are not saved, failed or skipped are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftarc.operators import archives, jobs, reports, zip_archives

FOLDER = "metadata/"
ARCHIVE, RESOURCES, FAILURES, URLS, REPORT, NOTE = (FOLDER + n for n in ("archive.json", "resources.json", "failures.json", "original-urls.json", "report.html", "README.md"))
NOTE_TEXT = "# An archived page\n\nOpen `index.html` through a local web server. `metadata/` says what was saved, what is missing, and where it came from.\n"
VERSION = 1
#: Failures that the report names.
MOST_FAILURES = 100


def _listed(rows: DataFrame, columns: tuple[str, ...], order: list[Column], name: str) -> DataFrame:
    """job_id and ``name``: the job's rows as an array of structs in order."""
    row = F.struct(*[c.alias(f"k{n}") for n, c in enumerate(order)], F.struct(*columns).alias("row"))
    return rows.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["row"]).alias(name))


def metadata_entries(captures: DataFrame, records: DataFrame, entries: DataFrame, dependencies: DataFrame) -> DataFrame:
    """job_id, path, data of six entries for each of ``captures`` (as for ``archives.archive_manifests``).

    ``records``: as for ``archives.manifest_entries``, of saved ones with the path of their entry (job_id, path, data). The hashes in
    the manifest are those of the entries. ``dependencies``: job_id, url.
    """
    hashes = archives.with_hashes(records, entries).select("job_id", "path", F.col("sha256").alias("own"), F.col("bytes").alias("n")).filter("path is not null")
    saved = records.join(hashes, ["job_id", "path"], "left").withColumn("sha256", F.coalesce("own", "sha256")).withColumn("bytes", F.coalesce("n", F.col("bytes").cast("long"))).drop("own", "n")
    rows = archives.manifest_entries(saved)
    said = ("type", "original_url", "final_url", "referrer_url", "mime_type", "http_status", "bytes")
    by_path, by_url = [F.col(c) for c in ("path", "type", "original_url")], [F.col("original_url"), F.col("type"), F.coalesce("final_url", F.lit(""))]
    of = lambda kind: rows.filter(F.col("manifest") == kind)
    listed = captures.select("job_id")
    for part in (
        _listed(of("resources"), ("path", *said, "sha256"), by_path, "resources"), _listed(of("failures"), (*said, "error"), by_url, "failures"), _listed(of("skipped"), said, by_url, "skipped"),
        _listed(of("resources"), ("original_url", "final_url", "path"), by_url + [F.col("path")], "urls"), archives.archive_manifests(captures, records, dependencies),
    ):
        clash = [c for c in part.columns if c in listed.columns and c != "job_id"]
        listed = listed.join(part.withColumnsRenamed({c: f"n_{c}" for c in clash}), "job_id", "left")
    manifest = F.struct(F.lit(VERSION).alias("version"), "captured_at", "start_url", "final_url", "mode", "capture_profile", "pages", F.col("n_resources").alias("resources"), "failed_resources", "online_dependencies")
    none = lambda c: F.when(F.col(c).isNull(), "[]").otherwise(F.to_json(c, {"ignoreNullFields": "false"}))
    text = lambda *parts: F.concat(F.lit(f'{{"version":{VERSION}'), *parts, F.lit("}"))
    totals = F.coalesce(F.aggregate("resources", F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r["bytes"], F.lit(0))), F.lit(0))
    failed = records.select("job_id", F.monotonically_increasing_id().alias("id"), "state", F.lit(False).alias("is_primary_visual"), F.col("original_url").alias("url"), "type")
    report = reports.readable_html(archives.manifest_rows(saved), jobs.failures(failed, most=MOST_FAILURES)).withColumnRenamed("report", "page")
    made = {
        ARCHIVE: F.to_json(manifest, {"ignoreNullFields": "false"}), RESOURCES: text(F.lit(',"total_bytes":'), totals.cast("string"), F.lit(',"resources":'), none("resources")),
        FAILURES: text(F.lit(',"failures":'), none("failures"), F.lit(',"skipped":'), none("skipped")), URLS: text(F.lit(',"resources":'), none("urls")),
        REPORT: F.coalesce("page", F.lit(reports.REPORT_HEAD + "</table><h2>Failures (0)</h2><p>none</p></body></html>")), NOTE: F.lit(NOTE_TEXT),
    }
    files = F.array(*[F.struct(F.lit(path).alias("path"), F.encode(content, "UTF-8").alias("data")) for path, content in made.items()])
    return listed.join(report, "job_id", "left").select("job_id", F.inline(files))


def package(captures: DataFrame, records: DataFrame, entries: DataFrame, references: DataFrame, dependencies: DataFrame) -> DataFrame:
    """The pieces (``zip_archives``) of the archives of jobs that are sound; ``references`` (job_id, source_path, value) are audited."""
    good = archives.sound_jobs(records, entries, references)
    in_the_way = F.raise_error(F.concat(F.lit("an entry lies in the way of the manifests: "), F.col("path")))
    own = entries.select("job_id", F.when(F.startswith("path", F.lit(FOLDER)), in_the_way).otherwise(F.col("path")).alias("path"), "data")
    every = own.unionByName(metadata_entries(captures, records, entries, dependencies))
    return zip_archives.pieces(every.join(good, "job_id", "left_semi"))
