"""Queries of checks, access, rewriting and packaging over inputs that are made from the driver's tables.

As in ``web_queries``, columns that no table has are derived from ids by expressions that Spark and DuckDB read alike.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from weftarc.functions import names, privacy, text
from weftarc.functions.tables import table, written
from weftarc.functions.urls import with_url
from weftarc.operators import archives, csp, discovery, evidence, fetch, jobs, offline_pages, packages, policy, reports, rewrite, service_workers, shapes, store, zip_archives
from weftarc.plans.web_queries import _RICH_HTML, _TARGETS, _derived, _evidence, _sql
from weftarc.sources.html import elements

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""
WITH t AS (SELECT {_sql(_TARGETS)}, page_id % 14 AS k FROM pages), p AS (
  SELECT page_id, k, CASE k WHEN 0 THEN regexp_extract(value, '^https?://[^/?#]*') || '/*' WHEN 6 THEN 'http://localhost/*' WHEN 7 THEN 'http://10.' || (page_id % 256) || '.0.1/*' WHEN 8 THEN 'http://example.com/*'
    WHEN 9 THEN 'http://127.0.0.1/*' WHEN 10 THEN 'http://[fe80::1]/*' WHEN 13 THEN 'https://example.org/*' END AS pattern FROM t
)
SELECT page_id, CASE WHEN k IN (1, 2, 3, 4, 5) THEN 'unsupported-protocol' WHEN k = 11 THEN 'missing-url' WHEN k = 12 THEN 'invalid-url'
  WHEN pattern IN ('https://example.org/*', 'http://localhost/*') THEN 'granted' ELSE 'not-granted' END AS status, pattern FROM p
""")
def flt_page_access(spark, sf_dir):
    """FLT-7: whether pages of many kinds may be read, and the permission that they need."""
    grants = spark.createDataFrame([("https://example.org/*",), ("http://localhost/*",)], "pattern string")
    return policy.page_access(_derived(table(spark, sf_dir, "pages"), _TARGETS).withColumnRenamed("value", "page_url"), grants)


_SCRIPTED = {
    "job_id": "o_custkey % 40",
    "id": "CAST(o_orderkey AS STRING)",
    "url": "CASE WHEN o_orderkey % 3 = 0 THEN 'https://www.google-analytics.com/x.js' ELSE 'https://h.example.com/x' END",
    "type": "CASE o_orderkey % 4 WHEN 0 THEN 'script' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' ELSE 'image' END",
}


@query(f"""
SELECT *, CASE WHEN (job_id % 2 = 0 AND type = 'script') OR (job_id % 3 = 0 AND type IN ('video', 'audio')) OR (job_id % 5 = 0 AND url LIKE '%google%') THEN 'skipped' ELSE 'queued' END AS state
FROM (SELECT {_sql(_SCRIPTED)} FROM orders)
""")
def flt_script_records(spark, sf_dir):
    """FLT-3: records that scripts led to, skipped by the job's settings alone (records derived from orders)."""
    found = _derived(table(spark, sf_dir, "orders"), _SCRIPTED)
    wanted = {"include_scripts": 2, "include_media": 3, "include_third_party": 5}
    settings = spark.range(40).select(F.col("id").alias("job_id"), F.lit("https://h.example.com/").alias("page_url"), *[(F.col("id") % n != 0).alias(k) for k, n in wanted.items()])
    return policy.script_records(found, settings)


@query("""
SELECT page_id AS text_id, '../assets/' || (page_id % 5) || '.png 1x,  /n/' || page_id || '.png 2x, /i/0.png 0w, ../assets/1.png' AS text, 2::BIGINT AS n_rewritten, 1::BIGINT AS n_unmapped FROM pages
""")
def rwr_srcset(spark, sf_dir):
    """RWR-4, FN-33: srcset values with their saved references replaced; layout, descriptors and bad candidates stay."""
    k = (F.col("page_id") % 5).cast("string")
    value = F.concat(F.lit("/i/"), k, F.lit(".png 1x,  /n/"), F.col("page_id").cast("string"), F.lit(".png 2x, /i/0.png 0w, /i/1.png"))
    texts = table(spark, sf_dir, "pages").select(F.lit(1).cast("long").alias("job_id"), F.col("page_id").alias("text_id"), F.lit("pages/p.html").alias("source_path"), F.lit("https://h.example.com/").alias("base_url"), value.alias("text"))
    return rewrite.rewrite_srcset(texts, rewrite.lookup(_saved(spark, "https://h.example.com/i/", ".png", "assets/"))).drop("job_id")


def _saved(spark, url: str, end: str, path: str):
    """Five saved resources of one job."""
    n = F.col("id").cast("string")
    return spark.range(5).select(F.lit(1).cast("long").alias("job_id"), F.concat(F.lit(url), n, F.lit(end)).alias("url"), F.lit(None).cast("array<string>").alias("aliases"), F.concat(F.lit(path), n, F.lit(end)).alias("path"))


@query("""
SELECT page_id AS text_id, 'import ''../lib/' || (page_id % 5) || '.js''; fetch("none.json"); // import ''./a/0.js''' AS text, 1::BIGINT AS n_rewritten, 1::BIGINT AS n_unmapped FROM pages
""")
def rwr_scripts(spark, sf_dir):
    """RWR-6: scripts with the modules that were saved; other references and comments stay."""
    text = F.concat(F.lit("import './a/"), (F.col("page_id") % 5).cast("string"), F.lit(".js'; fetch(\"none.json\"); // import './a/0.js'"))
    texts = table(spark, sf_dir, "pages").select(F.lit(1).cast("long").alias("job_id"), F.col("page_id").alias("text_id"), F.lit("js/main.js").alias("source_path"), F.lit("https://s.example.com/main.js").alias("base_url"), text.alias("text"))
    return rewrite.rewrite_javascript(texts, rewrite.lookup(_saved(spark, "https://s.example.com/a/", ".js", "lib/"))).drop("job_id")


@query("""
SELECT page_id AS text_id, 'const s = JSON.parse(''{"a/1.js":["./lib/' || (page_id % 5) || '.js","/a/' || (page_id % 7 + 5) || '.js","a/0.js"]}''), t = "../lib/' || (page_id % 5) || '.js", u = "a/0.js";' AS text,
  2::BIGINT AS n_rewritten, 1::BIGINT AS n_unmapped FROM pages
""")
def rwr_script_payloads(spark, sf_dir):
    """SRC-8, RWR-6: JSON in scripts; its keys stay, its values are ways from the page, other strings ways from the script."""
    n = lambda by, more: (F.col("page_id") % by + more).cast("string")
    text = F.concat(F.lit('const s = JSON.parse(\'{"a/1.js":["/a/'), n(5, 0), F.lit('.js","/a/'), n(7, 5), F.lit('.js","a/0.js"]}\'), t = "./a/'), n(5, 0), F.lit('.js", u = "a/0.js";'))
    texts = table(spark, sf_dir, "pages").select(F.lit(1).cast("long").alias("job_id"), F.col("page_id").alias("text_id"), F.lit("js/main.js").alias("source_path"), F.lit("https://s.example.com/main.js").alias("base_url"), text.alias("text"))
    return rewrite.rewrite_javascript(texts, rewrite.lookup(_saved(spark, "https://s.example.com/a/", ".js", "lib/"))).drop("job_id")


# a.png and s.css are saved; posters, svg images, frames, analytics and embedded pages are not; next links are no resources
@query("SELECT page_id, page_id % 3 + page_id % 4 AS n_rewritten, page_id % 3 + page_id % 5 + 2 * (page_id % 2) + page_id % 7 AS n_unmapped FROM pages")
def rwr_rich_pages(spark, sf_dir):
    """RWR-2, RWR-3: references of pages with resources, replaced where they were saved (pages derived from page ids)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_RICH_HTML).alias("html"), F.lit(1).cast("long").alias("job_id"), F.lit("index.html").alias("source_path"), F.lit("https://h.example.com/").alias("base_url"))
    saved = spark.createDataFrame([(1, "https://h.example.com/a.png", None, "assets/a.png"), (1, "https://h.example.com/s.css", None, "css/s.css")], "job_id long, url string, aliases array<string>, path string")
    return offline_pages.rewrite_html(elements(pages), pages, rewrite.lookup(saved)).select("page_id", "n_rewritten", "n_unmapped")


@query("""
SELECT page_id AS job_id, (fault IS NOT NULL)::BIGINT AS n_faults, fault AS first_fault FROM (
  SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'path' WHEN page_id % 5 = 0 THEN 'crc' WHEN page_id % 7 = 0 THEN 'length' WHEN page_id % 11 = 0 THEN 'hash' END AS fault FROM pages)
""")
def aud_verified_archives(spark, sf_dir):
    """AUD-4, FN-31: archives' entries against their records, with faults of every kind put in."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("job_id"), F.encode("html", "UTF-8").alias("data"))
    pages = pages.withColumn("path", F.concat(F.when(F.col("job_id") % 13 == 0, "/").otherwise(""), F.lit("pages/"), F.col("job_id").cast("string"), F.lit(".html")))
    off = lambda n: (F.col("job_id") % n == 0).cast("int")
    records = pages.select("job_id", "path", (F.octet_length("data") + off(7)).cast("long").alias("bytes"), F.when(F.col("job_id") % 11 == 0, F.sha2("path", 256)).otherwise(F.sha2("data", 256)).alias("sha256"))
    return archives.verified(pages.select("job_id", "path", "data", (F.crc32("data") + off(5)).alias("crc32")), records)


@query("SELECT page_id AS job_id, 'index.html' AS path, strlen(html) AS bytes FROM pages WHERE page_id % 4 <> 0 AND (page_id % 5 = 0 OR page_id % 3 <> 0)")
def snk_packaged_jobs(spark, sf_dir):
    """SNK-7, AUD-3, SORT-2: jobs whose entries agree with their records and pass the audit, packed and read back."""
    entries = table(spark, sf_dir, "pages").select(F.col("page_id").alias("job_id"), F.lit("index.html").alias("path"), F.encode("html", "UTF-8").alias("data"))
    records = entries.select("job_id", "path", (F.octet_length("data") + (F.col("job_id") % 4 == 0).cast("int")).cast("long").alias("bytes"), F.lit("saved").alias("state"))
    references = entries.filter("job_id % 5 != 0").select("job_id", F.col("path").alias("source_path"), F.when(F.col("job_id") % 3 == 0, "https://x.example.com/").otherwise("#top").alias("value"))
    return archives.unzipped(archives.packaged(records, entries, references)).select("job_id", "path", F.octet_length("data").cast("long").alias("bytes"))


_CAPTURED = {
    "job_id": "page_id % 17",
    "state": "CASE page_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'saved' END",
    "original_url": "concat('https://h.example.com/p', CAST(page_id AS STRING), '?token=1')",
    "final_url": "CASE WHEN page_id % 3 = 0 THEN concat('https://h.example.com/f', CAST(page_id AS STRING)) END",
    "referrer_url": "'https://h.example.com/'",
    "path": "CASE WHEN page_id % 5 > 1 THEN concat('pages/', CAST(page_id AS STRING), '.html') END",
    "type": "'document'",
    "mime_type": "'text/html'",
    "http_status": "CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END",
    "error": "CASE WHEN page_id % 5 = 0 THEN 'http-status' END",
}
# what is read back from the archives: a row for each line of each manifest, and for each other entry
@query(f"""
WITH r AS (SELECT {_sql(_CAPTURED)}, html, strlen(html) AS bytes, sha256(html) AS sha256, replace(original_url, '=1', '=REDACTED') AS shown FROM pages), t AS (
  SELECT job_id, count(*) FILTER (state = 'saved') AS saved, count(*) FILTER (state = 'failed') AS failed, coalesce(sum(bytes) FILTER (state = 'saved'), 0)::BIGINT AS total FROM r GROUP BY job_id
)
SELECT job_id, 'resources' AS manifest, path, shown AS url, bytes, sha256 FROM r WHERE state = 'saved'
UNION ALL SELECT job_id, CASE state WHEN 'failed' THEN 'failures' ELSE 'skipped' END, NULL, shown, bytes, NULL FROM r WHERE state <> 'saved'
UNION ALL SELECT job_id, 'original-urls', path, coalesce(final_url, shown), NULL, NULL FROM r WHERE state = 'saved'
UNION ALL SELECT job_id, 'total', NULL, NULL, total, NULL FROM t
UNION ALL SELECT job_id, 'archive', NULL, 'https://h.example.com/', saved * 1000 + failed, NULL FROM t
UNION ALL SELECT job_id, 'entry', path, NULL, bytes, sha256 FROM r WHERE state = 'saved'
UNION ALL SELECT job_id, 'entry', 'metadata/README.md', NULL, {len(packages.NOTE_TEXT)}, '{hashlib.sha256(packages.NOTE_TEXT.encode()).hexdigest()}' FROM t
""")
def snk_manifest_packages(spark, sf_dir):
    """SNK-7, SNK-1, SNK-3, SNK-5, SNK-6, SRC-5, SRC-6, AUD-3: archives with their manifests, written as pieces and read back by ranges (jobs derived from page ids)."""
    pages = table(spark, sf_dir, "pages")
    records = pages.selectExpr(*[f"{e} AS {c}" for c, e in _CAPTURED.items()], "CAST(octet_length(html) AS BIGINT) AS bytes", "CAST(NULL AS STRING) AS sha256")
    entries = pages.filter("page_id % 5 > 1").select((F.col("page_id") % 17).alias("job_id"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("data"))
    start = F.lit("https://h.example.com/")
    captures = records.select("job_id").distinct().select("job_id", F.timestamp_seconds(F.lit(0)).alias("captured_at"), start.alias("start_url"), start.alias("final_url"), F.lit("page").alias("mode"), F.lit("static").alias("capture_profile"), F.lit(1).cast("long").alias("pages_captured"))
    references = entries.select("job_id", F.col("path").alias("source_path"), F.lit("#top").alias("value"))
    pieces = packages.package(captures, records, entries, references, captures.select("job_id", F.col("start_url").alias("url")))
    found = written(zip_archives.entries_of(zip_archives.blocks_of_pieces(pieces)), "read-back")
    lines = "array<struct<path: string, original_url: string, final_url: string, bytes: long, sha256: string>>"
    shape = f"total_bytes long, resources {lines}, failures {lines}, skipped {lines}, start_url string, failed_resources long"
    name, content = F.regexp_extract("path", r"^metadata/([a-z-]+)\.json$", 1), F.from_json(F.decode("data", "UTF-8"), shape)
    read = found.select("job_id", name.alias("name"), F.when(name.isin("resources", "failures", "original-urls"), content).alias("m"), F.when(name == "archive", F.from_json(F.decode("data", "UTF-8"), "start_url string, resources long, failed_resources long")).alias("a"), "path", "data")
    row = lambda manifest, path, url, n, sha: F.struct(manifest.alias("manifest"), path.cast("string").alias("path"), url.cast("string").alias("url"), n.cast("long").alias("bytes"), sha.cast("string").alias("sha256"))
    none, m = F.lit(None), F.col("m")
    listed = lambda kind, of: F.transform(F.coalesce(of, F.array().cast(lines)), lambda r: row(F.lit(kind), r["path"], r["original_url"], r["bytes"], r["sha256"]))
    rows = (
        F.when(name == "resources", F.array_append(listed("resources", m["resources"]), row(F.lit("total"), none, none, m["total_bytes"], none)))
        .when(name == "failures", F.concat(listed("failures", m["failures"]), listed("skipped", m["skipped"])))
        .when(name == "original-urls", F.transform(m["resources"], lambda r: row(F.lit("original-urls"), r["path"], r["final_url"], none, none)))
        .when(name == "archive", F.array(row(F.lit("archive"), none, F.col("a.start_url"), F.col("a.resources") * 1000 + F.col("a.failed_resources"), none)))
        .when(F.col("path") != packages.REPORT, F.array(row(F.lit("entry"), F.col("path"), none, F.octet_length("data"), F.sha2("data", 256))))
    )
    return read.select("job_id", F.inline(rows))


# a fault put into every archive by its id, at places that do not depend on what is in it
_BROKEN = {
    1: ("several-disks", "overlay(archive placing unhex('0100') from octet_length(archive) - 17 for 2)"),
    2: ("zip64", "overlay(archive placing unhex('FFFF') from octet_length(archive) - 11 for 2)"),
    3: ("directory-place", "overlay(archive placing unhex('01000000') from octet_length(archive) - 9 for 4)"),
    4: ("headers-differ", "overlay(archive placing unhex('00000000') from 15 for 4)"),
    5: ("no-end-record", "substring(archive, 1, octet_length(archive) - 1)"),
    6: ("gap", "concat(substring(archive, 1, listed_at + 42), unhex('01000000'), substring(archive, listed_at + 47, octet_length(archive)))"),
    7: ("method", "concat(substring(archive, 1, listed_at + 10), unhex('0C00'), substring(archive, listed_at + 13, octet_length(archive)))"),
    8: ("flags", "concat(substring(archive, 1, listed_at + 8), unhex('0100'), substring(archive, listed_at + 11, octet_length(archive)))"),
    9: ("path", "concat(substring(archive, 1, listed_at + 46), unhex('FF'), substring(archive, listed_at + 48, octet_length(archive)))"),
    10: ("directory", "concat(substring(archive, 1, listed_at), unhex('00'), substring(archive, listed_at + 2, octet_length(archive)))"),
}


@query(f"""
WITH f AS (SELECT page_id AS job_id, CASE page_id % 12 {' '.join(f"WHEN {k} THEN '{n}'" for k, (n, _) in _BROKEN.items())} END AS fault, strlen(html) AS n FROM pages)
SELECT job_id, CASE WHEN fault IN ('several-disks', 'zip64', 'directory-place', 'no-end-record', 'directory', 'path') THEN NULL ELSE 'a.html' END AS path, fault, CASE WHEN fault IS NULL THEN n END AS bytes FROM f
UNION ALL SELECT job_id, 'b.txt', NULL, 3 FROM f WHERE fault IS NULL OR fault NOT IN ('several-disks', 'zip64', 'directory-place', 'no-end-record', 'directory')
""")
def src_broken_archives(spark, sf_dir):
    """SRC-6: archives of every page's text, broken in ten ways by page id, read by ranges: a row for each entry, or for an archive that cannot be read."""
    pages = table(spark, sf_dir, "pages")
    made = F.array(F.struct(F.lit("a.html").alias("path"), F.encode("html", "UTF-8").alias("data")), F.struct(F.lit("b.txt").alias("path"), F.lit(b"txt").alias("data")))
    whole = zip_archives.cells(zip_archives.pieces(pages.select(F.col("page_id").alias("job_id"), F.inline(made))))
    listed_at = whole.withColumn("listed_at", zip_archives.number_at(F.substring("archive", F.octet_length("archive") - 21, F.lit(22)), 16, 4).cast("int"))
    broken = "CASE job_id % 12 " + " ".join(f"WHEN {k} THEN {e}" for k, (_, e) in _BROKEN.items()) + " ELSE archive END"
    found = zip_archives.entries_of(zip_archives.blocks(listed_at.select("job_id", "part", F.expr(broken).alias("archive")), 4096), 4096)
    return found.select("job_id", "path", "fault", F.octet_length("data").cast("long").alias("bytes"))


_RELATIONS = ("prefetch", "DNS-Prefetch", "preconnect x", "x prerender", "modulepreload", "next", "canonical", "")


@query(f"""
SELECT page_id, CASE WHEN page_id % 8 >= 5 THEN regexp_replace(html, '<a href="(/[A-Za-z]+)">', '<link rel="' || ['next', 'canonical', ''][(page_id % 8 - 4)::INT] || '" href="\\1"><a href="\\1">', 'g') ELSE html END AS html FROM pages
""")
def flt_speculative_links(spark, sf_dir):
    """FLT-10: links that only fetch ahead are taken out of every page, others stay (links are put before the pages' own)."""
    relation = F.try_element_at(F.array(*map(F.lit, _RELATIONS)), (F.col("page_id") % 8 + 1).cast("int"))
    linked = F.regexp_replace("html", F.lit('<a href="(/[A-Za-z]+)">'), F.concat(F.lit('<link rel="'), relation, F.lit('" href="$1"><a href="$1">')))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", linked.alias("html"), F.lit(1).cast("long").alias("job_id"), F.lit("index.html").alias("source_path"), F.col("url").alias("base_url"))
    saved = rewrite.lookup(spark.createDataFrame([], "job_id long, url string, aliases array<string>, path string"))
    return offline_pages.rewrite_html(elements(pages), pages, saved).select("page_id", "html")


_KEPT_JOBS = {
    "id": "c_custkey",
    "status": "CASE c_custkey % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'failed' WHEN 3 THEN 'fetching' ELSE 'paused' END",
    "updated_at": "CAST(c_custkey % 100 AS BIGINT)",
}


@query(f"""
WITH j AS (SELECT {_sql(_KEPT_JOBS)} FROM customer), r AS (SELECT o_custkey AS job_id, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT j.*, coalesce(n, 0) AS n_records FROM j LEFT JOIN r ON j.id = r.job_id)
SELECT 'without-old' AS variant, id, status, n_records FROM b WHERE NOT (status IN ('completed', 'cancelled') AND updated_at < 40)
UNION ALL SELECT 'without-history', id, status, n_records FROM b WHERE status IN ('fetching', 'paused')
UNION ALL SELECT 'updated', id, CASE WHEN status = 'fetching' THEN 'rewriting' ELSE status END, n_records FROM b
""")
def sto_history(spark, sf_dir):
    """STO-2: jobs and their records without old ones, without history, and with changed states (jobs are the customers, records their orders)."""
    jobs_ = _derived(table(spark, sf_dir, "customer"), _KEPT_JOBS)
    records = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("id"))
    changed = store.updated_jobs(jobs_, jobs_.filter("status = 'fetching'").select("id", F.lit("rewriting").alias("status")))
    kept = {"without-old": store.without_old(jobs_, records, 40), "without-history": store.without_history(jobs_, records), "updated": (changed, records)}
    out = None
    for name, (left, of) in kept.items():
        n = of.groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("n_records"))
        rows = left.join(n, "id", "left").select(F.lit(name).alias("variant"), "id", "status", F.coalesce("n_records", F.lit(0)).alias("n_records"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""
WITH t AS (SELECT page_id AS text_id, page_id % 3 > 0 AS changed, 'p{background:url(/i/' || (page_id % 6) || '.png)} q{fill:url(/n' || page_id || '.svg)}' AS given FROM pages)
SELECT text_id, 'css/' || text_id || '.css' AS document_path, changed::INT AS total, CASE WHEN changed THEN 'css-source-rewrite' END AS kind, CASE WHEN changed THEN 'point-to-saved-resource' END AS reason, CASE WHEN changed THEN given END AS before,
  CASE WHEN changed THEN 'p{background:url("../assets/' || (text_id % 6) || '.png")} q{fill:url(/n' || text_id || '.svg)}' END AS after, CASE WHEN changed THEN 'css-ast-regeneration-reported-at-source-level' ELSE '' END AS limitations FROM t
""")
def agg_sheet_changes(spark, sf_dir):
    """SNK-10: the report of a style sheet's one change (sheets derived from page ids; two of six images are not saved)."""
    pages = table(spark, sf_dir, "pages")
    given = F.concat(F.lit("p{background:url(/i/"), (F.col("page_id") % 6).cast("string"), F.lit(".png)} q{fill:url(/n"), F.col("page_id").cast("string"), F.lit(".svg)}"))
    texts = pages.select(F.lit(1).cast("long").alias("job_id"), F.col("page_id").alias("text_id"), F.concat(F.lit("css/"), F.col("page_id").cast("string"), F.lit(".css")).alias("source_path"), F.lit("https://h.example.com/").alias("base_url"), given.alias("text"))
    images = spark.range(6).filter("id % 3 > 0").select(F.lit(1).cast("long").alias("job_id"), F.concat(F.lit("https://h.example.com/i/"), F.col("id").cast("string"), F.lit(".png")).alias("url"), F.lit(None).cast("array<string>").alias("aliases"), F.concat(F.lit("assets/"), F.col("id").cast("string"), F.lit(".png")).alias("path"))
    changes = reports.sheet_changes(texts, rewrite.rewrite_css(texts, rewrite.lookup(images)))
    return changes.drop("job_id").withColumn("limitations", F.array_join("limitations", ","))


# a manifest of each page, broken by its id: what is replaced, and the fault that this makes
_SHAPED = (
    ("", "", None, None), ('"version":1', '"version":2', "$.version", "out-of-range"), ('"count":2', '"count":3', "$.count", "differs"), ('"image"', '"font"', "$.resources[1].type", "not-a-choice"),
    ('"ordinal":2', '"ordinal":5', "$.resources[1].ordinal", "not-dense"), ('"a.png"', '"/a.png"', "$.resources[1].path", "not-of-the-pattern"), ('"count":2,', "", "$.count", "missing"),
    ('"count":2', '"count":2,"x":0', "$.x", "unknown-key"), ('"bytes":null', '"bytes":{}', "$.resources[1].bytes", "not-a-number"), ('{"version"', '[{"version"', "$", "not-json"), ('"cached":true', '"cached":1', "$.resources[1].cached", "not-a-flag"),
)


@query(f"""
SELECT page_id AS job_id, CASE page_id % {len(_SHAPED)} {' '.join(f"WHEN {k} THEN '{path}'" for k, (_, _, path, _) in enumerate(_SHAPED) if path)} END AS path,
  CASE page_id % {len(_SHAPED)} {' '.join(f"WHEN {k} THEN '{fault}'" for k, (_, _, path, fault) in enumerate(_SHAPED) if path)} END AS fault FROM pages WHERE page_id % {len(_SHAPED)} > 0
UNION ALL SELECT page_id, '$.total_bytes', 'differs' FROM pages WHERE page_id % 7 = 3 AND page_id % {len(_SHAPED)} <> 9
""")
def flt_shape_faults(spark, sf_dir):
    """FLT-11: manifests of every page held against their shape: keys, types, choices, patterns, dense numbers, and sums worked out again."""
    pages = table(spark, sf_dir, "pages").withColumn("n", F.octet_length("html"))
    said = F.col("n") + (F.col("page_id") % 7 == 3).cast("int")
    document = F.concat(
        F.lit('{"version":1,"count":2,"total_bytes":'), said.cast("string"), F.lit(',"resources":[{"ordinal":1,"path":"pages/'), F.col("page_id").cast("string"), F.lit('.html","type":"document","bytes":'), F.col("n").cast("string"),
        F.lit('},{"ordinal":2,"path":"a.png","type":"image","bytes":null,"cached":true}]}'),
    )
    old, new = (F.try_element_at(F.array(*[F.lit(x[k]) for x in _SHAPED]), (F.col("page_id") % len(_SHAPED) + 1).cast("int")) for k in (0, 1))
    document = F.replace(document, old, new)
    return shapes.shape_faults(pages.select(F.col("page_id").alias("job_id"), document.alias("document")), shapes.MANIFEST, "document")


_PLANNED = {
    "job_id": "o_custkey",
    "id": "CAST(o_orderkey AS STRING)",
    "is_primary": "o_orderkey % 10 = 0",
    "state": "CASE WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'saved' END",
    "type": "'image'",
    "original_url": "concat('https://h.example.com/r', CAST(o_orderkey AS STRING))",
    "final_url": "CASE WHEN o_orderkey % 3 = 0 THEN concat('https://H.example.com:443/f', CAST(o_orderkey AS STRING), '#x') END",
}


@query(f"""
SELECT job_id, id, CASE WHEN final_url IS NULL THEN original_url ELSE 'https://h.example.com/f' || id END AS url, type, 'assets/' || id AS path,
  CASE WHEN final_url IS NULL THEN '' ELSE final_url || ' ' || original_url END AS aliases
FROM (SELECT {_sql(_PLANNED)} FROM orders) WHERE state = 'saved' AND NOT is_primary
""")
def pth_runtime_plan(spark, sf_dir):
    """PTH-3, DED-6: saved secondary resources with their archive paths and the other URLs that lead to them."""
    records = _derived(table(spark, sf_dir, "orders"), _PLANNED)
    url = F.when(F.col("final_url").isNull(), F.col("original_url")).otherwise(F.concat(F.lit("https://h.example.com/f"), "id"))
    mappings = records.select("job_id", url.alias("url"), F.col("type").alias("resource_type"), F.concat(F.lit("assets/"), "id").alias("path"))
    return archives.runtime_plan(records, mappings).withColumn("aliases", F.array_join("aliases", " "))


_CHECKS = {
    "page_id": "page_id",
    "path": "CASE page_id % 6 WHEN 0 THEN 'a/b.html' WHEN 1 THEN '/a' WHEN 2 THEN 'a//b' WHEN 3 THEN 'a/../b' WHEN 4 THEN concat('p', CAST(page_id AS STRING)) ELSE '' END",
    "descriptor": "CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '10w' WHEN 2 THEN '0w' WHEN 3 THEN '1.5x' WHEN 4 THEN '-1x' WHEN 5 THEN '0x' ELSE 'wide' END",
    "public_id": "CASE WHEN page_id % 3 = 0 THEN '-//W3C//DTD HTML 4.01//EN' ELSE '' END",
    "system_id": "CASE page_id % 4 WHEN 0 THEN 'http://h/a.dtd' WHEN 1 THEN 'say \"x\"' ELSE '' END",
}


@query(f"""
WITH c AS (SELECT {_sql(_CHECKS)} FROM pages), q AS (SELECT *, CASE page_id % 4 WHEN 0 THEN '"http://h/a.dtd"' WHEN 1 THEN '''say "x"''' END AS quoted FROM c)
SELECT page_id, page_id % 6 IN (0, 4) AS good_path, page_id % 7 IN (0, 1, 3) AS good_descriptor,
  '<!DOCTYPE html' || CASE WHEN public_id <> '' THEN ' PUBLIC "' || public_id || '"' || coalesce(' ' || quoted, '') ELSE coalesce(' SYSTEM ' || quoted, '') END || '>' AS doctype FROM q
""")
def fn_text_checks(spark, sf_dir):
    """FN-31, FN-33, FN-35: archive paths, srcset descriptors and doctypes of many forms."""
    c = _derived(table(spark, sf_dir, "pages"), _CHECKS)
    return c.select("page_id", names.is_archive_path(F.col("path")).alias("good_path"), text.is_descriptor(F.col("descriptor")).alias("good_descriptor"), text.doctype(F.lit("html"), F.col("public_id"), F.col("system_id")).alias("doctype"))


_RETAINED = {
    "job_id": "l_orderkey % 50",
    "status": "CASE l_partkey % 6 WHEN 0 THEN 'fragment' WHEN 1 THEN 'invalid' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'css-parse-error' ELSE 'rewritten' END",
    "scheme": "CASE l_suppkey % 4 WHEN 0 THEN 'data' WHEN 1 THEN 'blob' ELSE 'https' END",
}


@query(f"""
WITH r AS (SELECT job_id, CASE WHEN scheme <> 'https' THEN scheme WHEN status <> 'rewritten' THEN status END AS kind FROM (SELECT {_sql(_RETAINED)} FROM lineitem))
SELECT job_id, {", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS n_{k.replace('-', '_')}" for k in reports.RETAINED)} FROM r GROUP BY job_id
""")
def agg_retained_references(spark, sf_dir):
    """AGG-7: references that stay as they are, by kind (references derived from lineitem)."""
    return reports.retained_counts(_derived(table(spark, sf_dir, "lineitem"), _RETAINED))


@query("SELECT page_id, 8::BIGINT AS n_resources, 9::BIGINT AS n_evidence, 7::BIGINT AS n_network, 1::BIGINT AS n_data, 0::BIGINT AS n_blob, 0::BIGINT AS n_unsupported, page_id % 2 AS n_frames, 0::BIGINT AS n_shadow_roots, page_id % 2 AS n_unreadable FROM pages")
def agg_page_summaries(spark, sf_dir):
    """AGG-14: resources, evidence and regions of every page (derived from page ids)."""
    nodes = evidence.nodes(written(_evidence(spark, sf_dir), "evidence"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_RICH_HTML).alias("html"))
    return evidence.page_summary(nodes, discovery.regions(elements(pages)))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'https://f.example.com/' || o_orderkey ELSE 'https://o.example.com/' END AS final_url,
  CASE WHEN o_orderkey % 2 = 0 THEN 200 + o_orderkey % 5 ELSE 0 END::INT AS http_status, CASE WHEN o_orderkey % 4 = 0 THEN 'image/png' ELSE 'text/plain' END AS mime_type FROM orders
""")
def fet_response_metadata(spark, sf_dir):
    """FET-8: what responses said, put on records; a media type only where there is one (derived from orders)."""
    orders = table(spark, sf_dir, "orders")
    records = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("https://o.example.com/").alias("final_url"), F.lit(0).alias("http_status"), F.lit("text/plain").alias("mime_type"))
    said = orders.filter("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("https://f.example.com/"), F.col("o_orderkey").cast("string")).alias("final_url"),
        (200 + F.col("o_orderkey") % 5).cast("int").alias("http_status"), F.when(F.col("o_orderkey") % 4 == 0, "image/png").alias("mime_type"),
    )
    return fetch.with_metadata(records, said)


_BATCHED = {"batch_id": "l_orderkey", "id": "CAST(l_linenumber % 6 AS STRING)", "job_id": "CASE WHEN l_orderkey % 5 = 0 THEN l_linenumber % 2 ELSE 1 END", "is_primary": "l_linenumber = 1 OR (l_orderkey % 3 = 0 AND l_linenumber = 2)"}


@query(f"""
WITH s AS (SELECT batch_id, count(*) AS n, count(DISTINCT id) AS ids, count(DISTINCT job_id) AS jobs, count(CASE WHEN is_primary THEN 1 END) AS primaries FROM (SELECT {_sql(_BATCHED)} FROM lineitem) GROUP BY batch_id)
SELECT batch_id, 'repeated-id' AS fault FROM s WHERE ids < n UNION ALL SELECT batch_id, 'several-jobs' FROM s WHERE jobs <> 1 UNION ALL SELECT batch_id, 'not-one-primary' FROM s WHERE primaries <> 1
""")
def fet_batch_faults(spark, sf_dir):
    """FET-10: batches that must not start (batches derived from lineitem)."""
    return fetch.batch_faults(_derived(table(spark, sf_dir, "lineitem"), _BATCHED))


_SETTINGS = {
    "job_id": "o_orderkey",
    "render_wait_ms": "CASE o_orderkey % 5 WHEN 0 THEN 30001 WHEN 1 THEN NULL ELSE o_orderkey % 30000 END",
    "concurrency": "o_orderkey % 14",
    "max_retries": "o_custkey % 12",
    "file_name": "CASE o_orderkey % 4 WHEN 0 THEN 'a/b' WHEN 1 THEN 'ends.' WHEN 2 THEN '  ' ELSE 'good.zip' END",
}


@query(f"""
WITH s AS (SELECT {_sql(_SETTINGS)} FROM orders)
SELECT job_id, 'render_wait_ms' AS fault FROM s WHERE render_wait_ms IS NULL OR render_wait_ms > 30000 UNION ALL SELECT job_id, 'concurrency' FROM s WHERE concurrency NOT BETWEEN 1 AND 12
UNION ALL SELECT job_id, 'max_retries' FROM s WHERE max_retries > 10 UNION ALL SELECT job_id, 'file_name' FROM s WHERE file_name IN ('a/b', 'ends.')
""")
def flt_settings_faults(spark, sf_dir):
    """FLT-12: settings of captures that cannot be used (settings derived from orders)."""
    return jobs.settings_faults(_derived(table(spark, sf_dir, "orders"), _SETTINGS))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 1 END AS saved, CASE WHEN o_orderkey % 6 = 0 THEN 7 ELSE 2 END::BIGINT AS failed FROM orders")
def agg_job_counters(spark, sf_dir):
    """AGG-13: counters of jobs with their updates, the last that is not null of each (derived from orders)."""
    orders = table(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey").cast("string"))
    now = orders.select("id", F.lit(1).cast("long").alias("saved"), F.lit(2).cast("long").alias("failed"))
    new = orders.filter("o_orderkey % 2 = 0").select("id", F.col("o_custkey").cast("long").alias("saved"), F.when(F.col("o_orderkey") % 3 == 0, 7).cast("long").alias("failed"))
    return jobs.merged_counters(now, new, ["saved", "failed"])


_POLICY = """CASE page_id % 5 WHEN 0 THEN 'default-src ''none''; img-src *' WHEN 1 THEN 'script-src ''self'' ''sha256-G''' WHEN 2 THEN '' WHEN 3 THEN 'IMG-SRC ''NONE''; img-src ''self''' ELSE 'style-src x; sandbox' END"""
_POLICY_HTML = f"""concat('<html><head><meta http-equiv="Content-Security-Policy" content="', {_POLICY}, '"></head><body>', repeat('<meta http-equiv=content-security-policy content=x>', CAST(page_id % 2 AS INT)), '</body></html>')"""


@query(f"""
WITH p AS (SELECT page_id, page_id % 5 AS k, {_POLICY} AS policy FROM pages)
SELECT page_id, 3::INT AS element_no, CASE k WHEN 0 THEN 'adjusted' WHEN 3 THEN 'adjusted' WHEN 2 THEN 'empty-policy' ELSE 'unchanged' END AS status,
  CASE k WHEN 0 THEN 'default-src ''sha256-G'' ''self''; img-src * ''self''' WHEN 3 THEN 'img-src ''self''; img-src ''self''' ELSE policy END AS adjusted_policy,
  CASE k WHEN 0 THEN 'allow-service-worker-guard,allow-local-font;allow-local-image' WHEN 3 THEN 'allow-local-image' ELSE '' END AS reasons, k = 3 AS has_repeated, k = 4 AS has_unsupported FROM p
UNION ALL SELECT page_id, 5, 'outside-head', 'x', '', false, false FROM pages WHERE page_id % 2 = 1
""")
def rwr_csp_policies(spark, sf_dir):
    """RWR-8: policies of pages with what an offline copy needs (pages derived from page ids)."""
    found = elements(table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_POLICY_HTML).alias("html")))
    needed = csp.meta_policies(found).withColumn("types", F.array(*map(F.lit, ("script", "image", "font"))))
    reasons = F.array_join(F.transform("changes", lambda c: F.array_join(c["reasons"], ",")), ";")
    return csp.adjusted(needed, guard="'sha256-G'").select("page_id", "element_no", "status", "adjusted_policy", reasons.alias("reasons"), "has_repeated", "has_unsupported")


@query("""
SELECT page_id, 1 + page_id % 2 AS policies_found, (page_id % 5 IN (0, 3))::BIGINT AS policies_adjusted, 'http-header-policies-not-available-in-html-snapshot,meta-policy-applies-only-after-its-document-position'
  || CASE WHEN page_id % 2 = 1 THEN ',outside-head-meta-is-not-enforced' ELSE '' END || CASE page_id % 5 WHEN 3 THEN ',duplicate-directives-preserved-first-wins' WHEN 4 THEN ',meta-unsupported-directives-preserved' ELSE '' END AS limitations FROM pages
""")
def agg_csp_reports(spark, sf_dir):
    """RWR-8: what is said of every page's policies (pages derived from page ids)."""
    found = elements(table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_POLICY_HTML).alias("html")))
    needed = csp.meta_policies(found).withColumn("types", F.array(*map(F.lit, ("script", "image", "font"))))
    return csp.page_reports(csp.adjusted(needed, guard="'sha256-G'")).withColumn("limitations", F.array_join("limitations", ","))


_FROZEN = [("<script>gtag(1)</script>", '<script type="application/x-disabled-script">gtag(1)</script>'), ('<script src="https://cdn.SEGMENT.com/x.js" type="module"></script>', '<script src="https://cdn.SEGMENT.com/x.js" type="application/x-disabled-script"></script>')]


@query(f"""
SELECT page_id, '<html><body><script src="app.js"></script>' || repeat('{_FROZEN[0][1]}', (page_id % 3)::INT) || repeat('{_FROZEN[1][1]}', (page_id % 2)::INT) || '<script type="application/json">hotjar</script></body></html>' AS html FROM pages
""")
def rwr_tracking_scripts(spark, sf_dir):
    """RWR-11, FLT-9: only scripts that track are made inert (pages derived from page ids)."""
    parts = ["'<html><body><script src=\"app.js\"></script>'", f"repeat('{_FROZEN[0][0]}', CAST(page_id % 3 AS INT))", f"repeat('{_FROZEN[1][0]}', CAST(page_id % 2 AS INT))", "'<script type=\"application/json\">hotjar</script></body></html>'"]
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(f"concat({', '.join(parts)})").alias("html"), F.lit(1).cast("long").alias("job_id"), F.lit("index.html").alias("source_path"), F.col("url").alias("base_url"))
    saved = rewrite.lookup(spark.createDataFrame([], "job_id long, url string, aliases array<string>, path string"))
    return offline_pages.rewrite_html(elements(pages), pages, saved, freeze_tracking=True).select("page_id", "html")


@query(f"""
WITH r AS (SELECT o_custkey % 50 AS job_id, o_orderkey AS id, o_orderstatus = 'O' AS saved, 'https://h.example.com/?a=' || o_orderkey || '&<b>' AS url FROM orders),
t AS (SELECT job_id, count(CASE WHEN saved THEN 1 END) AS n, count(CASE WHEN NOT saved THEN 1 END) AS nf FROM r GROUP BY job_id),
f AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY url, id) AS k FROM r WHERE NOT saved),
l AS (SELECT job_id, string_agg('<li><code>' || replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</code> (image)</li>', '' ORDER BY k) AS lines FROM f WHERE k <= 5 GROUP BY job_id)
SELECT t.job_id, '{reports.REPORT_HEAD.replace("'", "''")}' || '<tr><td>failures</td><td>' || nf || '</td><td>0 B</td></tr><tr><td>resources</td><td>' || n || '</td><td>0 B</td></tr></table><h2>Failures (' || nf || ')</h2>'
  || CASE WHEN nf > 0 THEN '<ul>' || lines || '</ul>' ELSE '<p>none</p>' END || CASE WHEN nf > 5 THEN '<p>and ' || (nf - 5) || ' more</p>' ELSE '' END || '</body></html>' AS report
FROM t LEFT JOIN l USING (job_id)
""")
def snk_readable_reports(spark, sf_dir):
    """SNK-8, FN-34, RES-1: a page for each job with its totals and first five failures (jobs derived from orders; no sizes)."""
    url = F.concat(F.lit("https://h.example.com/?a="), F.col("o_orderkey").cast("string"), F.lit("&<b>"))
    state = F.when(F.col("o_orderstatus") == "O", "saved").otherwise("failed")
    records = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("job_id"), F.col("o_orderkey").alias("id"), state.alias("state"), F.lit(False).alias("is_primary_visual"), url.alias("url"), F.lit("image").alias("type"))
    counted = lambda name, state: F.struct(F.lit(name).alias("manifest"), F.count_if(F.col("state") == state).alias("n"))
    totals = records.groupBy("job_id").agg(F.array(counted("resources", "saved"), counted("failures", "failed")).alias("t")).select("job_id", F.inline("t")).withColumn("bytes", F.lit(0).cast("long"))
    return reports.readable_html(totals, jobs.failures(records, most=5))


# scripts of a derived page, each repeated by page_id: as given, as it is afterwards
_WORKERS = (
    ("<script>a();navigator.serviceWorker.register(f(1)).then(b)</script>", f"<script>a();{service_workers.DENIED}.then(b)</script>", 3),
    ("<script type=module>const w = navigator.serviceWorker;</script>", "<script type=module>const w = navigator.serviceWorker;</script>", 2),
    ("<script src=w.js></script>", "<script src=w.js></script>", 4),
    ("<script>navigator.serviceWorker.register(</script>", "<script>navigator.serviceWorker.register(</script>", 5),
)


def _worker_page(which: int, guard: str) -> str:
    return f"concat('<html><head>{guard}<title>t</title>', {', '.join(f'repeat({chr(39)}{w[which]}{chr(39)}, CAST(page_id % {w[2]} AS INT))' for w in _WORKERS)}, '</head></html>')"


@query(f"""
SELECT page_id, {_worker_page(1, service_workers.GUARD)} AS html, page_id % 3 AS n_rewritten, page_id % 4 AS n_external, page_id % 2 AS n_others, page_id % 5 AS n_broken,
  1 + (page_id % 4 > 0)::BIGINT + (page_id % 2 > 0)::BIGINT + (page_id % 5 > 0)::BIGINT AS n_limits FROM pages
""")
def rwr_service_workers(spark, sf_dir):
    """RWR-10: calls that register service workers replaced, a guard in each page (pages derived from page ids)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_worker_page(0, "")).alias("html"))
    return service_workers.guarded(pages).withColumn("n_limits", F.size("limits").cast("long")).drop("limits")


# elements of _RICH_HTML by what they refer to, see there
@query("""
WITH c AS (SELECT page_id, page_id % 2 AS p2, page_id % 3 AS p3, page_id % 4 AS p4, page_id % 5 AS p5, page_id % 6 AS p6, page_id % 7 AS p7 FROM pages)
SELECT page_id AS job_id, 3 * p3 + p4 + p5 + 2 * p2 + p7 + p6 AS n_html_attribute, 2 * p4 AS n_srcset, 2 + p5 AS n_inline_css, 1::BIGINT AS n_stylesheet_css, p2 AS n_navigation,
  2 * p2 + p7 AS n_external, p6 AS n_extension, 1 + p3 AS n_fragment, 2 + 2 * p3 + 3 * p4 + 2 * p5 AS n_local_missing FROM c
""")
def aud_archive_references(spark, sf_dir):
    """EXT-10, AUD-1: references read from the pages and style sheets of archives, and what they are (archives derived from page ids)."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("job_id"), F.expr(f"concat({_RICH_HTML}, repeat('<a href=\"z.html\">t</a>', CAST(page_id % 2 AS INT)))").alias("html"))
    made = lambda path, text: pages.select("job_id", F.lit(path).alias("path"), F.encode(text, "UTF-8").alias("data"))
    entries = made("index.html", F.col("html")).unionByName(made("assets/css/s.css", F.lit("a{background:url(x.png)}"))).unionByName(made("assets/a.bin", F.lit("url(x.png)")))
    judged = archives.audited(archives.archive_references(entries), entries)
    counted = lambda column, names: [F.count_if(F.col(column) == n).alias("n_" + n.replace("-", "_")) for n in names]
    kinds = [F.count_if((F.col("kind") == n) & (F.col("channel") != "navigation")).alias("n_" + n.replace("-", "_")) for n in ("external", "extension", "fragment", "local-missing")]
    return judged.groupBy("job_id").agg(*counted("channel", ("html-attribute", "srcset", "inline-css", "stylesheet-css", "navigation")), *kinds)


_TERMINAL = {
    "job_id": "o_custkey % 40",
    "id": "CAST(o_orderkey AS STRING)",
    "state": "CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' WHEN 2 THEN 'queued' ELSE 'saved' END",
    "type": "'image'",
    "original_url": "CASE WHEN o_orderkey % 5 IN (0, 1) AND o_orderkey % 3 = 0 THEN 'data:x,y' ELSE concat('https://h.example.com/r', CAST(o_orderkey AS STRING), '?sid=1&q=a%20b&code#f') END",
    "final_url": "CASE WHEN o_orderkey % 4 = 0 THEN concat('https://H.example.com:443/f', CAST(o_orderkey AS STRING)) END",
    "referrer_url": "'https://h.example.com/?x=%zz'",
    "path": "CASE WHEN o_orderkey % 5 > 2 OR o_orderkey % 5 = 1 AND o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN '/bad' WHEN o_orderkey % 13 = 0 THEN 'pages/p.html' ELSE concat('assets/', CAST(o_orderkey AS STRING)) END END",
    "mime_type": "CASE WHEN o_orderkey % 2 = 0 THEN 'image/png' END",
    "http_status": "CASE WHEN o_orderkey % 17 = 0 THEN 404 ELSE 200 END",
    "bytes": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_custkey END",
    "sha256": "CAST(NULL AS STRING)",
    "error": "CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 <> 1 THEN 'network-error' END",
}


@query(f"""
WITH r AS (SELECT {_sql(_TERMINAL)}, o_orderkey FROM orders WHERE o_orderkey % 5 <> 2), u AS (
  SELECT *, CASE WHEN original_url = 'data:x,y' THEN 'data:REDACTED' ELSE 'https://h.example.com/r' || id || '?sid=REDACTED&q=a+b&code=REDACTED' END AS shown, CASE WHEN final_url IS NOT NULL THEN 'https://h.example.com/f' || id END AS ended FROM r
)
SELECT job_id, CASE state WHEN 'saved' THEN 'resources' WHEN 'failed' THEN 'failures' ELSE 'skipped' END AS manifest, shown AS original_url, CASE WHEN state = 'saved' THEN coalesce(ended, shown) ELSE ended END AS final_url,
  'https://h.example.com/?x=%25zz' AS referrer_url, CASE WHEN state = 'saved' THEN path END AS path, type, mime_type, http_status, bytes, sha256, error FROM u
""")
def snk_manifest_entries(spark, sf_dir):
    """SNK-1, FN-19, FN-20: the entries of every job's manifests, without secrets (records derived from orders)."""
    return archives.in_order(archives.manifest_entries(_derived(table(spark, sf_dir, "orders"), _TERMINAL)))


@query(f"""
WITH r AS (SELECT {_sql(_TERMINAL)}, o_orderkey FROM orders), s AS (
  SELECT *, count(*) OVER (PARTITION BY job_id, lower(path), state = 'saved') AS same FROM r
)
SELECT * FROM (SELECT job_id, id, CASE WHEN state = 'queued' THEN 'state'
  WHEN state = 'saved' THEN CASE WHEN error IS NOT NULL THEN 'error' WHEN bytes IS NULL THEN 'bytes' WHEN http_status <> 200 THEN 'status' WHEN path = '/bad' THEN 'path' WHEN path = 'pages/p.html' THEN 'page-path' WHEN same > 1 THEN 'repeated-path'
    WHEN o_orderkey % 23 = 0 THEN 'no-mapping' END
  WHEN path IS NOT NULL THEN 'unsaved-path' WHEN state = 'failed' AND error IS NULL THEN 'no-error' END AS fault FROM s) WHERE fault IS NOT NULL
UNION ALL SELECT 1000, NULL, 'unused-mapping'
""")
def flt_record_faults(spark, sf_dir):
    """SNK-1, SNK-5, FLT-11: records that cannot go into manifests, and mappings that no record has (records derived from orders)."""
    records = _derived(table(spark, sf_dir, "orders"), _TERMINAL)
    mappings = records.filter("state = 'saved' AND path LIKE 'assets/%' AND CAST(id AS BIGINT) % 23 != 0").select("job_id", "path")
    return archives.record_faults(records, mappings.unionByName(spark.createDataFrame([(1000, "assets/x")], "job_id long, path string")))


@query(f"""
WITH r AS (SELECT {_sql(_TERMINAL)} FROM orders), t AS (SELECT job_id, count(CASE WHEN state = 'saved' THEN 1 END) AS resources, count(CASE WHEN state = 'failed' THEN 1 END) AS failed_resources FROM r GROUP BY job_id)
SELECT range AS job_id, '2024-01-03T00:00:10.500Z' AS captured_at, 'https://h.example.com/?token=REDACTED#REDACTED' AS start_url, 'https://h.example.com/#part' AS final_url, 'single-page' AS mode, 'static' AS capture_profile,
  greatest(range % 3, 1) AS pages, coalesce(resources, 0) AS resources, coalesce(failed_resources, 0) AS failed_resources, CASE WHEN range % 2 = 0 THEN 'https://a.example.com/ https://b.example.com/' ELSE '' END AS online_dependencies
FROM range(40) LEFT JOIN t ON t.job_id = range
""")
def snk_archive_manifests(spark, sf_dir):
    """SNK-3, DED-8: the manifest of every job's archive (jobs of orders' customers)."""
    fixed = {"start_url": "https://h.example.com/?token=a#x?jwt=1", "final_url": "https://h.example.com/#part", "mode": "single-page", "capture_profile": "static"}
    jobs_of = spark.range(40).select(F.col("id").alias("job_id"), F.expr("timestamp_millis(1704240010500)").alias("captured_at"), *[F.lit(v).alias(k) for k, v in fixed.items()], (F.col("id") % 3).alias("pages_captured"))
    needed = jobs_of.filter("job_id % 2 = 0").select("job_id", F.explode(F.array(*map(F.lit, ("https://b.example.com/#x", "https://a.example.com", "https://A.example.com:443/")))).alias("url"))
    made = archives.archive_manifests(jobs_of, _derived(table(spark, sf_dir, "orders"), _TERMINAL), needed)
    return made.withColumn("online_dependencies", F.array_join("online_dependencies", " "))


@query(f"""
WITH r AS (SELECT {_sql(_TERMINAL)} FROM orders), t AS (SELECT job_id, count(CASE WHEN state = 'failed' THEN 1 END) AS n FROM r GROUP BY job_id)
SELECT range AS job_id, CASE range % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'cancelled' END AS status, range % 8 = 0 AS archive_available, CASE WHEN range % 8 = 0 THEN 3 END::BIGINT AS archive_bytes,
  coalesce(n, 0) AS n_failures, greatest(coalesce(n, 0) - 5, 0) AS n_omitted FROM range(40) LEFT JOIN t ON t.job_id = range WHERE range % 4 < 3
""")
def res_job_results(spark, sf_dir):
    """RES-1: the result of every ended job (jobs of orders' customers)."""
    k = F.col("id") % 4
    jobs_of = spark.range(40).select(F.col("id").alias("job_id"), F.when(k == 0, "completed").when(k == 1, "failed").when(k == 2, "cancelled").otherwise("fetching").alias("status"))
    packed = spark.range(0, 40, 2).select(F.col("id").alias("job_id"), F.when(F.col("id") % 8 == 4, F.lit(b"")).otherwise(F.lit(b"zip")).alias("archive"))
    return jobs.results(jobs_of, _derived(table(spark, sf_dir, "orders"), _TERMINAL), packed, most=5)


_SHOWN = {"page_id": "page_id", "value": "CASE page_id % 4 WHEN 0 THEN 'https://h.example.com/a?pwd=1#x=1' WHEN 1 THEN 'data:text/plain,secret' WHEN 2 THEN 'not a url' ELSE 'https://h.example.com/#sig=1&b' END"}


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://h.example.com/a?pwd=REDACTED#x=1' WHEN 1 THEN 'data:[redacted]' WHEN 2 THEN '[invalid URL]' ELSE 'https://h.example.com/#REDACTED' END AS shown FROM pages")
def fn_result_urls(spark, sf_dir):
    """FN-21: URLs as results of jobs show them."""
    rows = with_url(_derived(table(spark, sf_dir, "pages"), _SHOWN), "value", "u")
    return rows.select("page_id", privacy.result_url(F.col("u")).alias("shown"))
