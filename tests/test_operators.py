import datetime
import random

from weftarc.functions import media, names
from weftarc.functions.tables import written
from weftarc.operators import archives, evidence, fetch, jobs, paths
from weftarc.streaming.jobs import job_states
from pyspark.sql import functions as F


def test_portable_names(spark):
    cases = {
        "a<b>:c.txt": "a_b_c.txt", "  lead. . ": "lead", "CON.txt": "_CON.txt", "con": "_con", "com1.tar.gz": "_com1.tar.gz", "": "fallback", "...": "fallback", "é.png": "é.png",
        "x" * 300 + ".png": "x" * 236 + ".png", "é" * 200: "é" * 120, "a" * 250 + "." + "b" * 40: "a" * 240,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", names.portable_name(F.col("v"), "fallback").alias("n"))
    assert {r.v: r.n for r in df.collect()} == cases
    s = spark.createDataFrame([("a.tar.gz",), ("plain",), ("y" * 240,)], "v string").select(names.with_suffix(F.col("v"), F.lit("q-1")).alias("n"))
    assert [r.n for r in s.collect()] == ["a.tar--q-1.gz", "plain--q-1", "y" * 235 + "--q-1"]


def test_archive_paths_and_ways_between_them(spark):
    df = spark.createDataFrame([("a/b/c.html", "a/x.png"), ("index.html", "a/b"), ("a/b", "a/b"), ("a/b/c", "d/e")], "s string, t string")
    assert [r[0] for r in df.select(names.relative_path(F.col("s"), F.col("t"))).collect()] == ["../x.png", "a/b", "b", "../../d/e"]
    checked = spark.createDataFrame([("a/b",), ("/a",), ("a//b",), ("a/../b",), ("",), (None,), ("a\\b",)], "p string").select(names.is_archive_path(F.col("p")))
    assert [r[0] for r in checked.collect()] == [True, False, False, False, False, False, False]


def test_retry_after_and_lengths(spark):
    now = F.lit("1994-11-06 08:49:30").cast("timestamp")
    cases = [("120", 120000), (" 5 ", 5000), ("Sun, 06 Nov 1994 08:49:37 GMT", 7000), ("Sunday, 06-Nov-94 08:49:37 GMT", 7000), ("Sun Nov  6 08:49:37 1994", 7000), ("Sun, 06 Nov 1994 08:49:00 GMT", 0), ("x", None), ("-1", None), (None, None)]
    df = spark.createDataFrame(cases, "v string, ms long").select("ms", media.retry_after_ms(F.col("v"), now).alias("got"))
    assert all(r.ms == r.got for r in df.collect())


def test_path_collisions_need_as_many_rounds_as_it_takes(spark):
    rows = [("http://h.example/a/X.png", "image"), ("http://h.example/b/x.png", "image"), ("http://h.example/c/y.png", "image"), ("http://h.example/c/y.png#z", "image"), ("http://h.example/", "document"), ("ftp://h.example/q", "image"), (None, "image")]
    got = {r.url: r for r in paths.path_mappings(spark.createDataFrame(rows, "url string, resource_type string")).collect()}
    assert set(got) == {"http://h.example/a/X.png", "http://h.example/b/x.png", "http://h.example/c/y.png", "http://h.example/"}
    assert got["http://h.example/a/X.png"].file_name.startswith("X--c-") and got["http://h.example/b/x.png"].collision_hash is not None
    assert got["http://h.example/c/y.png"].n_aliases == 2 and got["http://h.example/c/y.png"].path == "assets/origins/http/dns-h.example/default/images/y.png"
    assert got["http://h.example/"].file_name == "index.html"
    shuffled = paths.path_mappings(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "url string, resource_type string").repartition(5))
    assert {r.url: r.path for r in shuffled.collect()} == {u: r.path for u, r in got.items()}


def test_graph_faults_are_found(spark):
    nodes = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 3, "b")], "page_id long, ordinal int, url string")
    edges = spark.createDataFrame([(1, "c", "dom-attribute", 1), (1, "a", "css-ast", 2), (1, "a", "css-ast", 2)], "page_id long, target_url string, channel string, source_ordinal int")
    assert {(r.fault, r.subject) for r in evidence.graph_faults(nodes, edges).collect()} == {("repeated-node", "b"), ("ordinals-not-dense", "3"), ("dangling-edge", "c"), ("repeated-edge", "a")}


def test_budget_lets_smaller_ones_in_after_a_refusal(spark):
    rows = [(1, 1, 60), (1, 2, 50), (1, 3, 40), (1, 4, 200), (1, 5, None), (2, 1, 100)]
    got = fetch.within_budget(spark.createDataFrame(rows, "job_id long, index long, bytes long"), 150, 100)
    assert sorted((r.job_id, r["index"], r.outcome) for r in got.collect()) == [(1, 1, "saved"), (1, 2, "total-limit"), (1, 3, "saved"), (1, 4, "file-limit"), (1, 5, "saved"), (2, 1, "saved")]


def test_retries(spark):
    schema = "resource_id long, attempt long, status int, timed_out boolean, thrown boolean, retry_after_ms long"
    rows = [(1, 1, 503, False, False, 2000), (1, 2, 200, False, False, None), (2, 1, None, True, False, None), (2, 2, None, True, False, None), (2, 3, None, True, False, None), (2, 4, 200, False, False, None), (3, 1, None, False, True, None), (4, 1, 404, False, False, None), (5, 1, 503, False, False, None)]
    got = {r.resource_id: (r.attempts, r.outcome, r.exhausted, r.timed_out, r.delay_ms) for r in fetch.retry_outcomes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (2, "succeeded", False, False, 2000), 2: (3, "failed", True, True, 1500), 3: (1, "failed", False, False, 0), 4: (1, "failed", False, False, 0), 5: (1, "pending", False, False, 500)}


def test_reconciliation_keeps_one_and_its_sources(spark):
    rows = [(1, "b", False, "saved", "http://h.example/x", None, ["dom"]), (1, "a", False, "saved", "http://h.example/y", "http://H.example/x#f", ["css"]), (1, "p", True, "saved", "http://h.example/x", None, ["dom"]), (1, "c", False, "saved", "bad url", None, ["dom"]), (2, "b", False, "saved", "http://h.example/x", None, ["dom"])]
    got = {(r.job_id, r.id): (r.state, r.error, r.sources) for r in fetch.reconciled(spark.createDataFrame(rows, "job_id long, id string, is_primary boolean, state string, original_url string, final_url string, sources array<string>")).collect()}
    assert got == {(1, "a"): ("saved", None, ["dom", "css"]), (1, "b"): ("failed", "duplicate-final-url", ["dom"]), (1, "p"): ("saved", None, ["dom"]), (1, "c"): ("failed", "final-url", ["dom"]), (2, "b"): ("saved", None, ["dom"])}


EVENTS = [(1, 1, "preparing"), (1, 2, "discovering"), (1, 3, "paused"), (1, 4, "fetching"), (1, 5, "discovering"), (1, 6, "fetching"), (2, 1, "fetching"), (2, 2, "preparing"), (2, 3, "failed"), (2, 4, "retrying"), (3, 1, None)]
EVENT = "job_id long, seq long, wanted string"


def test_job_states_in_a_batch(spark):
    got = {r.job_id: (r.status, r.resume_status, r.n_applied, r.n_rejected) for r in jobs.replay(spark.createDataFrame(EVENTS, EVENT)).collect()}
    assert got == {1: ("fetching", None, 5, 1), 2: ("retrying", None, 3, 1), 3: ("idle", None, 0, 1)}


def test_job_states_in_a_stream_are_those_of_the_batch(spark, tmp_path):
    for k, part in enumerate((EVENTS[:3] + EVENTS[6:8], EVENTS[3:6] + EVENTS[8:])):
        spark.createDataFrame(part, EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = job_states(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    last = {r.job_id: r.s for r in out.groupBy("job_id").agg(F.max_by("status", "seq").alias("s")).collect()}
    assert last == {1: "fetching", 2: "retrying", 3: "idle"} and out.count() == len(EVENTS)


def test_archives_are_the_same_bytes_and_come_back(spark):
    entries = spark.createDataFrame([(1, "b.txt", b"two"), (1, "a.txt", b"one"), (2, "c", b"")], "job_id long, path string, data binary")
    packed = written(archives.zipped(entries), "test-zip")
    again = {r.job_id: bytes(r.archive) for r in archives.zipped(entries.repartition(3)).collect()}
    assert {r.job_id: bytes(r.archive) for r in packed.collect()} == again
    assert sorted((r.job_id, r.path, bytes(r.data)) for r in archives.unzipped(packed).collect()) == [(1, "a.txt", b"one"), (1, "b.txt", b"two"), (2, "c", b"")]


def test_audit_kinds(spark):
    values = {"../a.png": "local-present", "../a%2Epng?x": "local-present", "b.png": "local-missing", "/a.png": "local-missing", "../../x": "local-missing", "#f": "fragment", "": "invalid", "//h/x": "external", "HTTPS://h/": "external", "data:,": "embedded", "about:blank": "embedded", "mailto:x": "unsupported", "moz-extension://x": "extension"}
    refs = spark.createDataFrame([(1, "d/index.html", v) for v in values], "job_id long, source_path string, value string")
    got = archives.audited(refs, spark.createDataFrame([(1, "a.png")], "job_id long, path string"))
    assert {r.value: r.kind for r in got.collect()} == values
    assert archives.audit_summary(got).first().passed is False


def test_history_counters_and_chunks(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(k, at + datetime.timedelta(days=k % 3)) for k in range(30)]
    assert [r.id for r in jobs.history(spark.createDataFrame(rows, "id long, updated_at timestamp"), 4).collect()] == [2, 5, 8, 11]
    now = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "id string, pages long, bytes long")
    new = spark.createDataFrame([("a", None, 9)], "id string, pages long, bytes long")
    assert sorted(map(tuple, jobs.merged_counters(now, new, ["pages", "bytes"]).collect())) == [("a", 1, 9), ("b", 3, 4)]
    cut = archives.chunks(spark.createDataFrame([(1, b"abcde"), (2, b"")], "file_id long, data binary"), 2).orderBy("file_id", "offset").collect()
    assert [(r.file_id, r.offset, bytes(r.data), r.is_last) for r in cut] == [(1, 0, b"ab", False), (1, 2, b"cd", False), (1, 4, b"e", True), (2, 0, b"", True)]


def test_a_new_name_can_meet_an_old_one(spark):
    rows = [("http://h.example/a/x.png", "image"), ("http://h.example/b/x.png", "image"), *[(f"http://h.example/only{k}.png", "image") for k in range(5)]]
    of = lambda rows: {(r.job_id, r.url): r for r in paths.path_mappings(spark.createDataFrame([(j, *r) for j in (1, None) for r in rows], "job_id long, url string, resource_type string"), ["job_id"]).collect()}
    first = of(rows)
    taken = first[1, "http://h.example/a/x.png"].file_name
    got = of([*rows, (f"http://h.example/{taken}", "image")])
    assert len({r.path.lower() for (j, _), r in got.items() if j == 1}) == 8 == len({r.path.lower() for (j, _), r in got.items() if j is None})
    digits = {u: len(r.collision_hash or "") for (j, u), r in got.items() if j == 1}
    assert digits == {**{u: 0 for u, _ in rows}, "http://h.example/a/x.png": paths.FIRST_DIGITS + paths.MORE_DIGITS, "http://h.example/b/x.png": paths.FIRST_DIGITS, f"http://h.example/{taken}": paths.FIRST_DIGITS}
    assert {k: r.path for k, r in first.items() if "only" in k[1]} == {k: r.path for k, r in got.items() if "only" in k[1]}
