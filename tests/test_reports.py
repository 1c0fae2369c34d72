import datetime
import zlib

import pytest
from pyspark.sql import functions as F

from weftarc.functions import text
from weftarc.operators import archives, reports, service_workers, store
from weftarc.sources.html import elements


def column(spark, values, make, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(make(F.col("v"))).collect()]


def test_texts(spark):
    assert column(spark, ["<a href='x'>&\"", None], text.escaped_html) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;", None]
    assert column(spark, ["a|b\nc*"], text.escaped_markdown) == ["a\\|b c\\*"]
    assert column(spark, [0, 1023, 1536, 5 << 20], text.byte_label, "long") == ["0 B", "1023 B", "1.5 KiB", "5.0 MiB"]
    assert column(spark, [None, "1w", "0w", "1.5x", "0x", "2e1x", "x"], text.is_descriptor) == [True, True, False, True, False, True, False]
    assert column(spark, ["aGk=", "aGk", "a Gk=", "", None], lambda c: F.decode(text.transfer_bytes(c), "UTF-8")) == ["hi", None, None, "", None]
    rows = spark.createDataFrame([("html", None, None), ("html", "-//W3C//DTD", None), ("html", 'a"b', "c"), ("html", "", "about:x")], "n string, p string, s string")
    assert [r[0] for r in rows.select(text.doctype(F.col("n"), F.col("p"), F.col("s"))).collect()] == ["<!DOCTYPE html>", '<!DOCTYPE html PUBLIC "-//W3C//DTD">', "<!DOCTYPE html PUBLIC 'a\"b' \"c\">", '<!DOCTYPE html SYSTEM "about:x">']
    named = rows.limit(1).select(text.archive_file_name(F.lit("my<site>.ZIP"), "page", F.lit("h"), F.lit("2024-01-03").cast("date")))
    assert named.first()[0] == "my_site_.zip"


def test_registrations():
    found = lambda s: (lambda r: ([s[c["start"] : c["stop"]] for c in r["calls"]], r["others"], r["broken"]))(service_workers.registrations(s))
    assert found("a();navigator.serviceWorker.register('/s)w.js', {scope: f(1)}).then(b)") == (["navigator.serviceWorker.register('/s)w.js', {scope: f(1)})"], 0, False)
    assert found("window . navigator?.['serviceWorker']\n.register?.(x)") == (["window . navigator?.['serviceWorker']\n.register?.(x)"], 0, False)
    assert found("a.navigator.serviceWorker.register(y); navigator.serviceWorkers.register(y); navigator.serviceWorker.registerAll(y)") == ([], 1, False)
    assert found("// navigator.serviceWorker.register(a)\n'navigator.serviceWorker.register(a)'") == ([], 0, False)
    assert found("const w = self.navigator.serviceWorker; w.register(a)") == ([], 1, False)
    assert found("navigator.serviceWorker.register(a") == ([], 0, True)
    assert service_workers.registrations(None) == {"calls": [], "others": 0, "broken": False}


def test_guarded_pages(spark):
    g, call, d = service_workers.GUARD, "navigator.serviceWorker.register(a)", service_workers.DENIED
    pages = [
        (1, f"<!doctype html><html><head><title>é</title><script>x;{call};y;{call}</script><script src=a.js>{call}</script></head></html>"),
        (2, f"<p>t</p><script type=text/plain>{call}</script><script type=module>f(navigator.serviceWorker)</script>"),
        (3, f"<html><script>{call}</script><head><script>navigator.serviceWorker.register(</script>"), (4, ""), (5, None), (6, "text"),
    ]
    given = spark.createDataFrame([(i, "https://a/", h, "extra") for i, h in pages], "page_id long, url string, html string, spans string")
    got = {r.page_id: r for r in service_workers.guarded(given).collect()}
    assert got[1].html == f"<!doctype html><html><head>{g}<title>é</title><script>x;{d};y;{d}</script><script src=a.js>{call}</script></head></html>"
    assert got[2].html == g + pages[1][1]
    assert got[3].html == f"<html>{g}<script>{d}</script><head><script>navigator.serviceWorker.register(</script>"
    assert [got[k].html for k in (4, 5, 6)] == [g, g, g + "text"]
    assert {k: tuple(r)[2:6] for k, r in got.items()} == {1: (2, 1, 0, 0), 2: (0, 0, 1, 0), 3: (1, 0, 0, 1), 4: (0, 0, 0, 0), 5: (0, 0, 0, 0), 6: (0, 0, 0, 0)}
    assert [got[k].limits[0][:8] for k in (1, 2, 3, 4)] == ["external", "dynamic-", "unparsea", "computed"]
    again = service_workers.guarded(spark.createDataFrame([(i, "https://a/", r.html) for i, r in got.items()], "page_id long, url string, html string"))
    assert {r.page_id: r.html for r in again.collect()} == {k: r.html for k, r in got.items()}
    rows = service_workers.scripts(elements(given)).orderBy("page_id", "element_no").collect()
    assert [(r.kind, r.status) for r in rows] == [
        ("inline-classic", "rewritten"), ("external", "runtime-guard-only"), ("non-javascript", "ignored"), ("inline-module", "runtime-guard-only"), ("inline-classic", "rewritten"), ("inline-classic", "parse-error"),
    ]


def test_change_reports(spark):
    rows = [(1, "b.html", "base-removal", 1, 0), (1, "a.html", "csp-policy-adjustment", 1, 0), (1, "a.html", "base-removal", 9, 0), (1, "a.html", "base-removal", 2, 0)]
    changes = spark.createDataFrame(rows, "job_id long, document_path string, kind string, element_no int, part int")
    got = [(r.document_path, r.kind, r.element_no) for r in reports.sequenced(changes).orderBy("sequence").collect()]
    assert got == [("a.html", "base-removal", 2), ("a.html", "base-removal", 9), ("a.html", "csp-policy-adjustment", 1), ("b.html", "base-removal", 1)]
    r = reports.change_counts(changes).first()
    assert (r.files_changed, r.total, r.n_base_removal, r.n_csp_policy_adjustment, r.n_css_source_rewrite) == (2, 4, 3, 1, 0)
    kept = spark.createDataFrame([(1, "unsupported", "data"), (1, "fragment", ""), (1, "rewritten", "https"), (1, "css-parse-error", None)], "job_id long, status string, scheme string")
    r = reports.retained_counts(kept).first()
    assert (r.n_data, r.n_fragment, r.n_css_parse_error, r.n_unsupported) == (1, 1, 1, 0)


def test_readable_report(spark):
    totals = spark.createDataFrame([(1, "resources", 2, 2048), (1, "failures", 1, 0), (2, "resources", 0, 0)], "job_id long, manifest string, n long, bytes long")
    failed = spark.createDataFrame([(1, 1, "http://h/a_b", "image", 3)], "job_id long, rank int, url string, type string, n_omitted long")
    got = {r.job_id: r.report for r in reports.readable(totals, failed).collect()}
    assert got[1] == "| manifest | n | bytes |\n|---|---|---|\n| failures | 1 | 0 B |\n| resources | 2 | 2.0 KiB |\n\n- http://h/a\\_b (image)\n- and 3 more\n"
    assert got[2].endswith("| resources | 0 | 0 B |\n")
    bad = failed.unionByName(spark.createDataFrame([(1, 2, "http://h/<b>&'", None, 3), (3, 1, "http://no-totals/", "image", 0)], failed.schema))
    got = {r.job_id: r.report for r in reports.readable_html(totals, bad).collect()}
    assert set(got) == {1, 2} and got[2].endswith("<tr><td>resources</td><td>0</td><td>0 B</td></tr></table><h2>Failures (0)</h2><p>none</p></body></html>")
    assert got[1].endswith("<h2>Failures (5)</h2><ul><li><code>http://h/a_b</code> (image)</li><li><code>http://h/&lt;b&gt;&amp;&#39;</code> ()</li></ul><p>and 3 more</p></body></html>")
    assert reports.readable_html(totals.limit(0), failed).count() == 0


def test_verified_archives(spark):
    crc = lambda b: zlib.crc32(b)
    entries = [(1, "a", b"x", crc(b"x")), (2, "a", b"x", 5), (3, "../a", b"x", crc(b"x")), (4, "A", b"x", crc(b"x")), (4, "a", b"x", crc(b"x")), (5, "a", b"x", crc(b"x")), (6, "b", b"", 0)]
    records = [(1, "a", 1, None), (5, "a", 1, "0" * 64), (6, "a", 1, None)]
    got = archives.verified(spark.createDataFrame(entries, "job_id long, path string, data binary, crc32 long"), spark.createDataFrame(records, "job_id long, path string, bytes long, sha256 string"))
    assert {r.job_id: (r.n_faults, r.first_fault) for r in got.collect()} == {1: (0, None), 2: (1, "crc"), 3: (1, "path"), 4: (2, "repeated-path"), 5: (1, "hash"), 6: (1, "no-entry")}


def test_store(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    jobs = spark.createDataFrame([(1, "completed", at(1)), (2, "fetching", at(1)), (3, "cancelled", at(9)), (4, "failed", at(1))], "id long, status string, updated_at timestamp")
    records = spark.createDataFrame([(k, "r") for k in (1, 2, 3, 4)], "job_id long, id string")
    left, kept = store.without_old(jobs, records, at(5))
    assert sorted(r.id for r in left.collect()) == [2, 3, 4] == sorted(r.job_id for r in kept.collect())
    left, kept = store.without_history(jobs, records)
    assert [r.id for r in left.collect()] == [2] == [r.job_id for r in kept.collect()]
    changed = store.updated_jobs(jobs, spark.createDataFrame([(2, "paused"), (4, "retrying")], "id long, status string"))
    assert {r.id: r.status for r in changed.collect()} == {1: "completed", 2: "paused", 3: "cancelled", 4: "retrying"}
    with pytest.raises(Exception, match="can not become"):
        store.updated_jobs(jobs, spark.createDataFrame([(1, "idle")], "id long, status string")).collect()
