import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from weftarc.operators import archives, evidence, fetch, jobs, packages, zip_archives


def test_runtime_plan(spark):
    schema = "job_id long, id string, is_primary boolean, state string, type string, original_url string, final_url string"
    rows = [(1, "d", True, "saved", "document", "http://h.example/", None), (1, "a", False, "saved", "image", "http://h.example/a#x", "http://H.example/b"), (1, "f", False, "failed", "image", "http://h.example/z", None)]
    paths = spark.createDataFrame([(1, "http://h.example/b", "image", "assets/b")], "job_id long, url string, resource_type string, path string")
    r = archives.runtime_plan(spark.createDataFrame(rows, schema), paths).collect()
    assert [(x.id, x.path, x.aliases) for x in r] == [("a", "assets/b", ["http://H.example/b", "http://h.example/a#x"])]
    with pytest.raises(Exception, match="no path for a"):
        archives.runtime_plan(spark.createDataFrame(rows, schema), paths.limit(0)).collect()


def test_dependencies_and_gate(spark):
    urls = [(1, "https://h.example/?token=1#f"), (1, "https://h.example/?token=2"), (1, "https://a.example/"), (1, "data:,x"), (1, None)]
    assert archives.online_dependencies(spark.createDataFrame(urls, "job_id long, url string")).first().dependencies == ["https://a.example/", "https://h.example/?token=REDACTED"]
    assert archives.gated(spark.createDataFrame([(1, True)], "job_id long, passed boolean")).first().passed
    with pytest.raises(Exception, match="archive-integrity-failed: 2"):
        archives.gated(spark.createDataFrame([(2, False)], "job_id long, passed boolean")).collect()


def test_only_sound_jobs_are_packaged(spark):
    entries = spark.createDataFrame([(1, "i.html", b"x"), (1, "a.png", b"yy"), (2, "i.html", b"x"), (3, "i.html", b"x"), (4, "i.html", b"x")], "job_id long, path string, data binary")
    records = spark.createDataFrame([(1, "i.html", 1, "saved"), (1, "a.png", 2, "saved"), (2, "i.html", 9, "saved"), (3, "i.html", 1, "saved"), (4, "i.html", 1, "saved")], "job_id long, path string, bytes long, state string")
    refs = spark.createDataFrame([(1, "i.html", "a.png"), (2, "i.html", "i.html"), (3, "i.html", "https://x.example/")], "job_id long, source_path string, value string")
    assert sorted(r.job_id for r in archives.packaged(records, entries, refs).collect()) == [1, 4]


def test_responses_and_batches(spark):
    records = spark.createDataFrame([("a", None, None, "image/png"), ("b", "u", 1, None)], "id string, final_url string, http_status int, mime_type string")
    said = spark.createDataFrame([("a", "http://f/", 200, None)], "id string, final_url string, http_status int, mime_type string")
    assert sorted(map(tuple, fetch.with_metadata(records, said).collect())) == [("a", "http://f/", 200, "image/png"), ("b", "u", 1, None)]
    rows = [(1, "a", 1, True), (1, "b", 1, False), (2, "a", 1, True), (2, "a", 2, True), (3, "a", 1, False)]
    got = {(r.batch_id, r.fault) for r in fetch.batch_faults(spark.createDataFrame(rows, "batch_id long, id string, job_id long, is_primary boolean")).collect()}
    assert got == {(2, "repeated-id"), (2, "several-jobs"), (2, "not-one-primary"), (3, "not-one-primary")}


def test_summaries_and_settings(spark):
    nodes = spark.createDataFrame([(1, 2, "network"), (1, 1, "data")], "page_id long, n_evidence long, kind string").withColumn("class", F.struct("kind"))
    regions = spark.createDataFrame([(1, "sandboxed"), (1, "shadow-open"), (2, "cross-origin")], "page_id long, status string")
    got = {r.page_id: (r.n_resources, r.n_evidence, r.n_network, r.n_frames, r.n_shadow_roots, r.n_unreadable) for r in evidence.page_summary(nodes, regions).collect()}
    assert got == {1: (2, 3, 1, 1, 1, 1), 2: (0, 0, 0, 1, 0, 1)}
    rows = [(1, 0, 6, 2, None), (2, 30001, 0, None, "a/b"), (3, 1, 12, 10, "ok.zip"), (4, 1, 1, 0, "bad.")]
    faults = {(r.job_id, r.fault) for r in jobs.settings_faults(spark.createDataFrame(rows, "job_id long, render_wait_ms int, concurrency int, max_retries int, file_name string")).collect()}
    assert faults == {(2, "render_wait_ms"), (2, "concurrency"), (2, "max_retries"), (2, "file_name"), (4, "file_name")}


def captured(spark):
    entries = spark.createDataFrame([(1, "index.html", b"<p>"), (1, "assets/a.png", b"yy"), (2, "index.html", b"x")], "job_id long, path string, data binary")
    rows = [
        (1, "saved", "https://h.example/?token=1", None, None, "index.html", "document", "text/html", 200, 3, None, None), (1, "saved", "https://h.example/a.png", "https://H.example/b.png", None, "assets/a.png", "image", None, 200, 2, None, None),
        (1, "failed", "https://h.example/z", None, None, None, "image", None, 404, None, None, "http-status"), (1, "skipped", "data:,x", None, None, None, "other", None, None, None, None, None),
        (2, "saved", "https://h.example/2", None, None, "index.html", "document", None, 200, 9, None, None),
    ]
    records = spark.createDataFrame(rows, "job_id long, state string, original_url string, final_url string, referrer_url string, path string, type string, mime_type string, http_status int, bytes long, sha256 string, error string")
    jobs_ = [(j, "https://h.example/", "https://h.example/", "page", "static", 0) for j in (1, 2, 3)]
    captures = spark.createDataFrame(jobs_, "job_id long, start_url string, final_url string, mode string, capture_profile string, pages_captured long").withColumn("captured_at", F.timestamp_seconds(F.lit(86400)))
    return captures, records, entries, spark.createDataFrame([], "job_id long, source_path string, value string"), spark.createDataFrame([(1, "https://h.example/z?sid=4")], "job_id long, url string")


def test_archives_hold_their_manifests(spark):
    given = captured(spark)
    first, again = ({(r.job_id, r.part): bytes(r.archive) for r in zip_archives.cells(packages.package(*x)).collect()} for x in (given, [d.repartition(3) for d in given]))
    assert first == again and sorted(first) == [(1, 0)]  # the bytes of job 2 are not what its record says; job 3 has no entries
    files = zipfile.ZipFile(io.BytesIO(first[1, 0]))
    assert files.namelist() == ["assets/a.png", "index.html", *sorted((packages.ARCHIVE, packages.FAILURES, packages.NOTE, packages.URLS, packages.REPORT, packages.RESOURCES))]
    said = {n: json.loads(files.read(n)) for n in (packages.ARCHIVE, packages.RESOURCES, packages.FAILURES, packages.URLS)}
    assert said[packages.ARCHIVE] == {
        "version": 1, "captured_at": "1970-01-02T00:00:00.000Z", "start_url": "https://h.example/", "final_url": "https://h.example/", "mode": "page", "capture_profile": "static", "pages": 1, "resources": 2,
        "failed_resources": 1, "online_dependencies": ["https://h.example/z?sid=REDACTED"],
    }
    kept = said[packages.RESOURCES]
    assert kept["total_bytes"] == 5 and [(r["path"], r["original_url"], r["bytes"], r["sha256"]) for r in kept["resources"]] == [
        ("assets/a.png", "https://h.example/a.png", 2, hashlib.sha256(b"yy").hexdigest()), ("index.html", "https://h.example/?token=REDACTED", 3, hashlib.sha256(b"<p>").hexdigest()),
    ]
    assert [f["error"] for f in said[packages.FAILURES]["failures"]] == ["http-status"] and [f["original_url"] for f in said[packages.FAILURES]["skipped"]] == ["data:REDACTED"]
    assert [(r["final_url"], r["path"]) for r in said[packages.URLS]["resources"]] == [("https://h.example/?token=REDACTED", "index.html"), ("https://h.example/b.png", "assets/a.png")]
    assert b"https://h.example/z" in files.read(packages.REPORT) and files.testzip() is None


def test_nothing_lies_in_the_way_of_manifests(spark):
    captures, records, entries, references, dependencies = captured(spark)
    bad = entries.unionByName(spark.createDataFrame([(3, packages.ARCHIVE, b"{}")], entries.schema))
    more = spark.createDataFrame([(3, "saved", "https://h.example/3", None, None, packages.ARCHIVE, "data", None, 200, 2, None, None)], records.schema)
    with pytest.raises(Exception, match="in the way"):
        packages.package(captures, records.unionByName(more), bad, references, dependencies).collect()
