"""Manifests, archive entries, offline audits, and archives as ZIP files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftarc.functions.names import is_archive_path
from weftarc.functions.privacy import diagnostic_url, redacted_url
from weftarc.functions.urls import with_url
from weftarc.operators import zip_archives
from weftarc.operators.discovery import SVG_TAGS, resource_attributes
from weftarc.sources.html import attribute, elements
from weftarc.sources.text_scans import css_references, srcset_candidates

CHUNK_BYTES = 192 * 1024
#: Bytes of the entries of one ZIP file that is a single value.
PART_BYTES = 64 << 20
AUDIT_KINDS = ("local-present", "local-missing", "external", "extension", "embedded", "fragment", "unsupported", "invalid")
BLOCKING = ("local-missing", "external", "extension", "unsupported", "invalid")
#: What a manifest says of a record besides its URLs.
KEPT = ("path", "type", "mime_type", "http_status", "bytes", "sha256", "error")


def manifest_rows(records: DataFrame) -> DataFrame:
    """job_id, manifest (resources, failures or skipped), n, bytes: terminal records by the manifest that they go to, with totals."""
    manifest = F.when(F.col("state") == "saved", "resources").when(F.col("state") == "failed", "failures").when(F.col("state") == "skipped", "skipped")
    rows = records.withColumn("manifest", manifest).filter("manifest is not null")
    return rows.groupBy("job_id", "manifest").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("manifest") == "resources", F.coalesce("bytes", F.lit(0))).otherwise(0)).alias("bytes"))


def manifest_entries(records: DataFrame) -> DataFrame:
    """job_id, manifest (resources, failures or skipped), the URLs without secrets and the columns KEPT of terminal records.

    Of a saved record final_url is where it ended, else it may be null; only saved ones have path and sha256. URLs that
    are no network URLs are null in the resources and shown by their scheme in the others. ``in_order`` sorts them.
    """
    manifest = F.when(F.col("state") == "saved", "resources").when(F.col("state") == "failed", "failures").when(F.col("state") == "skipped", "skipped")
    rows = records.withColumn("manifest", manifest).filter("manifest is not null")
    saved = F.col("manifest") == "resources"
    rows = rows.withColumn("ended", F.when(saved, F.coalesce("final_url", "original_url")).otherwise(F.col("final_url")))
    rows = with_url(with_url(with_url(rows, "original_url", "__o"), "ended", "__f"), "referrer_url", "__r")
    shown = lambda u: F.when(saved, redacted_url(F.col(u))).otherwise(F.when(F.col(u).isNotNull(), diagnostic_url(F.col(u))))
    kept = [F.when(saved, F.col(c)).alias(c) if c in ("path", "sha256") else F.col(c) for c in KEPT]
    return rows.select("job_id", "manifest", shown("__o").alias("original_url"), shown("__f").alias("final_url"), redacted_url(F.col("__r")).alias("referrer_url"), *kept)


def in_order(entries: DataFrame) -> DataFrame:
    """``manifest_entries`` as manifests are written: saved ones by path, type and URL, others by URL, type and final URL."""
    saved = F.col("manifest") == "resources"
    final = F.coalesce("final_url", F.lit(""))
    return entries.orderBy("job_id", "manifest", F.when(saved, F.col("path")).otherwise(F.col("original_url")), "type", F.when(saved, F.col("original_url")).otherwise(final))


def record_faults(records: DataFrame, mappings: DataFrame) -> DataFrame:
    """job_id, id, fault: the first reason for which a record cannot go into a manifest; mappings (job_id, path) without a record have no id.

    Faults: state, repeated-id, error (of a saved record), bytes, status, path, page-path (of another type), repeated-path, url,
    no-mapping; unsaved-path and no-error of records that are not saved; unused-mapping.
    """
    saved = F.coalesce(F.col("state") == "saved", F.lit(False))
    # records without a path of their own share no key, so that none is in very many rows
    key = F.when(saved & F.col("path").isNotNull(), F.lower("path")).otherwise(F.concat(F.lit("\0"), F.col("id").cast("string")))
    mapped = mappings.select("job_id", "path", F.lit(True).alias("__mapped")).distinct()
    rows = records.withColumn("__key", key).withColumn("__same_path", saved & (F.count(F.lit(1)).over(Window.partitionBy("job_id", "__key")) > 1))
    rows = rows.withColumn("__same_id", F.count(F.lit(1)).over(Window.partitionBy("job_id", "id")) > 1).join(mapped, ["job_id", "path"], "left")
    rows = with_url(with_url(rows, "original_url", "__o"), "final_url", "__f")
    page = (F.col("path") == "index.html") | F.col("path").startswith("pages/")
    bad_url = redacted_url(F.col("__o")).isNull() | (F.col("final_url").isNotNull() & redacted_url(F.col("__f")).isNull())
    of_saved = (
        F.when(F.col("error").isNotNull(), "error").when(F.col("bytes").isNull() | (F.col("bytes") < 0), "bytes").when(~F.coalesce(F.col("http_status"), F.lit(200)).between(200, 299), "status")
        .when(~is_archive_path(F.col("path")) | ~(page | F.col("path").startswith("assets/")), "path").when(page & (F.col("type") != "document"), "page-path")
        .when(F.col("__same_path"), "repeated-path").when(bad_url, "url").when(~page & F.col("__mapped").isNull(), "no-mapping")
    )
    of_others = F.when(F.col("path").isNotNull() | F.col("sha256").isNotNull(), "unsaved-path").when((F.col("state") == "failed") & F.col("error").isNull(), "no-error")
    fault = F.when(~F.coalesce(F.col("state").isin("saved", "failed", "skipped"), F.lit(False)), "state").when(F.col("__same_id"), "repeated-id").when(saved, of_saved).otherwise(of_others)
    unused = mappings.join(records.filter(saved), ["job_id", "path"], "left_anti").select("job_id", F.lit(None).cast(records.schema["id"].dataType).alias("id"), F.lit("unused-mapping").alias("fault"))
    return rows.select("job_id", "id", fault.alias("fault")).filter("fault is not null").unionByName(unused)


def archive_manifests(jobs: DataFrame, records: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One row for each job: captured_at, start_url, final_url, mode, capture_profile, pages, resources, failed_resources, online_dependencies.

    ``jobs``: job_id, captured_at (timestamp, written in UTC), start_url, final_url, mode, capture_profile, pages_captured.
    The URLs keep their fragments without secrets. An archive has at least one page.
    """
    totals = records.groupBy("job_id").agg(F.count_if(F.col("state") == "saved").alias("resources"), F.count_if(F.col("state") == "failed").alias("failed_resources"))
    rows = with_url(with_url(jobs, "start_url", "__s"), "final_url", "__f").join(totals, "job_id", "left").join(online_dependencies(dependencies), "job_id", "left")
    at = F.date_format(F.to_utc_timestamp("captured_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.select(
        "job_id", at.alias("captured_at"), redacted_url(F.col("__s"), keep_fragment=True).alias("start_url"), redacted_url(F.col("__f"), keep_fragment=True).alias("final_url"), "mode", "capture_profile",
        F.greatest(F.lit(1).cast("long"), "pages_captured").alias("pages"), F.coalesce("resources", F.lit(0).cast("long")).alias("resources"), F.coalesce("failed_resources", F.lit(0).cast("long")).alias("failed_resources"),
        F.coalesce("dependencies", F.array().cast("array<string>")).alias("online_dependencies"),
    )


def original_urls(records: DataFrame) -> DataFrame:
    """job_id, original_url, final_url, path: each way once, numbered in the order of its columns."""
    once = records.filter("state = 'saved'").select("job_id", "original_url", F.coalesce("final_url", F.lit("")).alias("final_url"), "path").distinct()
    return once.withColumn("position", F.row_number().over(Window.partitionBy("job_id").orderBy("original_url", "final_url", "path")))


def with_hashes(records: DataFrame, entries: DataFrame) -> DataFrame:
    """job_id, path, bytes, sha256, fault: saved records against the bytes of their entries (job_id, path, data)."""
    listed = records.filter("state = 'saved'").select("job_id", "path", F.col("bytes").alias("said"))
    both = listed.join(entries.select("job_id", "path", "data"), ["job_id", "path"], "full")
    size = F.octet_length("data").cast("long")
    fault = F.when(F.col("data").isNull(), "no-entry").when(F.col("said").isNull(), "not-listed").when(size != F.col("said"), "other-length")
    return both.select("job_id", "path", size.alias("bytes"), F.when(fault.isNull(), F.sha2("data", 256)).alias("sha256"), fault.alias("fault"))


def entry_counts(entries: DataFrame) -> DataFrame:
    """job_id, area, n of archive entries: documents, stylesheets, assets, metadata, screenshots, other."""
    path = F.col("path")
    area = (
        F.when(path.startswith("metadata/"), "metadata").when(path.startswith("screenshots/"), "screenshots").when(path.rlike(r"(?i)\.x?html?$"), "documents")
        .when(path.rlike(r"(?i)\.css$"), "stylesheets").when(path.startswith("assets/"), "assets").otherwise("other")
    )
    return entries.groupBy("job_id", area.alias("area")).agg(F.count(F.lit(1)).alias("n"))


def _joined_path(source: Column, target: Column) -> Column:
    """An archive path seen from the folder of another; null where it leads out of the archive."""
    parts = F.split(F.concat(F.regexp_replace(source, "[^/]*$", ""), target), "/")
    empty = F.array().cast("array<string>")
    zero = F.struct(empty.alias("kept"), F.lit(True).alias("inside"))

    def step(acc: Column, p: Column) -> Column:
        up, here = p == "..", p.isin(".", "")
        kept = F.when(up, F.slice(acc["kept"], F.lit(1), F.greatest(F.size(acc["kept"]) - 1, F.lit(0)))).when(here, acc["kept"]).otherwise(F.array_append(acc["kept"], p))
        return F.struct(kept.alias("kept"), (acc["inside"] & ~(up & (F.size(acc["kept"]) == 0))).alias("inside"))

    return F.aggregate(parts, zero, step, lambda a: F.when(a["inside"], F.array_join(a["kept"], "/")))


def archive_references(entries: DataFrame) -> DataFrame:
    """job_id, source_path, channel, value of the references in archived pages and style sheets (entries: job_id, path, data).

    Channels: html-attribute, srcset, inline-css, stylesheet-css, and navigation (where links and forms lead, which is
    no reference: leave it out of an audit). Repeated references stay. Bytes that are no UTF-8 are replaced.
    """
    path = F.col("path")
    texts = entries.select("job_id", "path", F.make_valid_utf8(F.col("data").cast("string")).alias("html"))
    pages = texts.filter((path == "index.html") | path.rlike(r"^pages/[\s\S]*\.[hH][tT][mM][lL]?\z"))
    found = elements(pages.select(F.struct("job_id", "path").alias("page_id"), F.concat(F.lit("https://archive.invalid/"), path).alias("url"), "html"))
    may, tag = resource_attributes(), F.col("tag")
    texts_of = {a: F.when(may[a], attribute(a)) for a in may}
    in_svg = F.col("in_svg") & tag.isin(*SVG_TAGS)
    single = [texts_of[a] for a in ("src", "href", "poster")] + [F.when(in_svg, attribute(a)) for a in ("href", "xlink:href")]
    found = found.withColumn("__sets", srcset_candidates(F.concat_ws(", ", texts_of["srcset"], texts_of["imagesrcset"])))
    found = found.withColumn("__style", css_references(F.when(tag == "style", F.col("text")))).withColumn("__own", css_references(attribute("style")))
    leads = [F.when(tag.isin("a", "area"), attribute("href")), F.when(tag == "form", attribute("action"))]
    named = lambda channel, values: F.transform(values, lambda v: F.struct(F.lit(channel).alias("channel"), v.alias("value")))
    urls = lambda c: F.transform(c, lambda r: r["raw_url"])
    every = F.concat(
        F.filter(named("html-attribute", F.array(*single)), lambda r: F.trim(r["value"]) != ""), named("srcset", urls("__sets")), named("inline-css", urls("__style")), named("inline-css", urls("__own")),
        F.filter(named("navigation", F.array(*leads)), lambda r: r["value"].isNotNull()),
    )
    of_pages = found.select("page_id.job_id", F.col("page_id.path").alias("source_path"), F.inline(every))
    sheets = texts.filter(path.startswith("assets/") & (F.contains(path, F.lit("/css/")) | path.rlike(r"\.[cC][sS][sS]\z")))
    of_sheets = sheets.select("job_id", F.col("path").alias("source_path"), F.inline(named("stylesheet-css", urls(css_references("html")))))
    return of_pages.unionByName(of_sheets)


def audited(references: DataFrame, entries: DataFrame) -> DataFrame:
    """``references`` (job_id, source_path, value) with kind, one of AUDIT_KINDS; ``entries``: job_id, path."""
    v = F.trim(F.coalesce("value", F.lit("")))
    scheme = F.lower(F.regexp_extract(v, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    local = F.regexp_replace(v, "[?#].*$", "")
    rows = references.withColumn("__v", v).withColumn("__scheme", scheme).withColumn("__path", F.when((scheme == "") & ~v.startswith("/"), _joined_path(F.col("source_path"), F.try_url_decode(F.replace(local, F.lit("+"), F.lit("%2B"))))))
    there = entries.select("job_id", F.col("path").alias("__path")).distinct().withColumn("__there", F.lit(True))
    found = rows.join(there, ["job_id", "__path"], "left")
    s, x = F.col("__scheme"), F.col("__v")
    kind = (
        F.when(x == "", "invalid").when(x.startswith("#"), "fragment").when(s.isin("http", "https") | x.startswith("//"), "external")
        .when(s.endswith("-extension"), "extension").when((s == "data") | (F.lower(x) == "about:blank"), "embedded").when(s != "", "unsupported")
        .when(F.col("__there"), "local-present").otherwise("local-missing")
    )
    return found.select(*[F.col(c) for c in references.columns], kind.alias("kind"))


def audit_summary(judged: DataFrame) -> DataFrame:
    """job_id, a count for each of AUDIT_KINDS, n_external_urls (different ones) and passed."""
    counts = [F.count_if(F.col("kind") == k).alias("n_" + k.replace("-", "_")) for k in AUDIT_KINDS]
    external = F.countDistinct(F.when(F.col("kind") == "external", F.trim("value")))
    return judged.groupBy("job_id").agg(*counts, external.alias("n_external_urls"), (F.count_if(F.col("kind").isin(*BLOCKING)) == 0).alias("passed"))


def uncaptured(references: DataFrame, saved: DataFrame, outcomes: DataFrame) -> DataFrame:
    """job_id, url, n, channels, reason of references (job_id, channel, value) to network URLs without a saved resource.

    ``saved``: job_id, url. ``outcomes``: job_id, url, state. The reason is failed, else skipped, else missing.
    """
    # a value is parsed once, however often it is referred to
    once = references.groupBy("job_id", "channel", "value").agg(F.count(F.lit(1)).alias("n"))
    known = with_url(once, "value", "u").filter(F.col("u.scheme").isin("http", "https")).withColumn("url", F.col("u.href"))
    missing = known.join(saved.select("job_id", "url").distinct(), ["job_id", "url"], "left_anti")
    summed = missing.groupBy("job_id", "url").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))
    states = outcomes.groupBy("job_id", "url").agg(F.bool_or(F.col("state") == "failed").alias("failed"), F.bool_or(F.col("state") == "skipped").alias("skipped"))
    reason = F.when(F.col("failed"), "failed").when(F.col("skipped"), "skipped").otherwise("missing")
    return summed.join(states, ["job_id", "url"], "left").select("job_id", "url", "n", "channels", reason.alias("reason"))


# Channels in the order of their sources, and states of records.
CHANNELS = ("html-attribute", "css-ast", "srcset")
STATES = ("discovered", "queued", "fetching", "saved", "failed", "skipped")
#: Sources of a missing resource that its row names.
MOST_SOURCES = 20


def outcomes(records: DataFrame) -> DataFrame:
    """job_id, url, states, error_codes: what became of each URL, under its first address and the one it led to (both of each record)."""
    each = records.select("job_id", "state", "error", F.explode(F.array_distinct(F.array("original_url", "final_url"))).alias("given"))
    known = with_url(each.distinct(), "given", "u").filter(F.col("u.scheme").isin("http", "https"))
    return known.groupBy("job_id", F.col("u.href").alias("url")).agg(F.collect_set("state").alias("states"), F.array_sort(F.collect_set("error")).alias("error_codes"))


def dependencies(references: DataFrame, records: DataFrame, most: int = MOST_SOURCES) -> DataFrame:
    """job_id, url, reason, n, channels, states, error_codes, sources of network URLs that are referred to and have no saved resource.

    ``references``: job_id, channel (one of CHANNELS), source_path, element_no, part, name (an attribute, property or descriptor) and value (an
    absolute URL). ``records``: job_id, original_url, final_url, state, error. n counts all references; sources are the first ``most`` of
    them by channel, document, element and part. States and channels are in their fixed orders; of repeated references each counts.
    """
    said = outcomes(records)
    # a value is parsed once, however often it is referred to
    known = with_url(references.select("job_id", "value").distinct(), "value", "u").filter(F.col("u.scheme").isin("http", "https")).withColumn("url", F.col("u.href"))
    gone = said.filter(F.array_contains("states", "saved")).select("job_id", "url")
    missing = references.join(known.join(gone, ["job_id", "url"], "left_anti").select("job_id", "value", "url"), ["job_id", "value"])
    rank = F.array_position(F.array(*map(F.lit, CHANNELS)), F.col("channel"))
    source = F.struct(rank.alias("rank"), "source_path", F.coalesce("element_no", F.lit(0)).alias("element_no"), "part", F.coalesce("name", F.lit("")).alias("name"), "value", "channel")
    rows = missing.select("job_id", "url", "channel", source.alias("s"))
    summed = rows.groupBy("job_id", "url", "channel").agg(F.count(F.lit(1)).alias("n")).groupBy("job_id", "url").agg(F.sum("n").alias("n"), F.collect_set("channel").alias("found"))
    # Spark keeps the first few of each URL before it shuffles
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("job_id", "url").orderBy("s"))).filter(F.col("k") <= most)
    listed = first.groupBy("job_id", "url").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.struct(s["channel"], s["source_path"], s["element_no"], s["part"], s["name"], s["value"])).alias("sources"))
    joined = summed.join(listed, ["job_id", "url"]).join(said, ["job_id", "url"], "left")
    none = F.array().cast("array<string>")
    has = lambda state: F.array_contains(F.coalesce("states", none), state)
    ordered = lambda names, column: F.filter(F.array(*map(F.lit, names)), lambda x: F.array_contains(F.coalesce(column, none), x))
    return joined.select(
        "job_id", "url", F.when(has("failed"), "download-failed").when(has("skipped"), "resource-skipped").otherwise("missing-mapping").alias("reason"), "n",
        ordered(CHANNELS, "found").alias("channels"), ordered(STATES, "states").alias("states"), F.coalesce("error_codes", none).alias("error_codes"), "sources",
    )


def chunks(files: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """file_id, offset, data, is_last of files (file_id, data) cut for transfer; an empty file is one empty chunk."""
    n = F.octet_length("data")
    offsets = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    return files.select("file_id", "data", F.explode(offsets).alias("offset")).select(
        "file_id", "offset", F.substring("data", F.col("offset") + 1, F.lit(size)).alias("data"), (F.col("offset") + size >= F.octet_length("data")).alias("is_last")
    )


def zipped(entries: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """job_id, part, archive (binary) of entries (job_id, path, data): sorted, with fixed times, so equal entries give equal bytes.

    A job of more than ``part_bytes`` has as many archives as it needs, its paths dealt over them by a hash, so that
    no cell holds more; the archives of a job together have all its entries. ``zip_archives.pieces`` has no such bound.
    """
    return zip_archives.cells(zip_archives.pieces(entries, part_bytes))


def unzipped(archives: DataFrame) -> DataFrame:
    """job_id, path, data, crc32 of archives (job_id, part, archive); an archive that is not sound is an error."""
    found = zip_archives.entries_of(zip_archives.blocks(archives))
    wrong = F.raise_error(F.concat(F.lit("archive "), F.col("job_id").cast("string"), F.lit(": "), F.col("fault"), F.lit(" "), F.coalesce("path", F.lit(""))))
    return found.select("job_id", F.when(F.col("fault").isNotNull(), wrong).otherwise(F.col("path")).alias("path"), "data", "crc32")


def verified(entries: DataFrame, records: DataFrame) -> DataFrame:
    """job_id, n_faults and first_fault of archives: entries (job_id, path, data, crc32) against saved records (job_id, path, bytes, sha256).

    Faults: path (not a good archive path), repeated-path, crc, no-entry, length, hash.
    """
    good = is_archive_path(F.col("path"))
    n_same = F.count(F.lit(1)).over(Window.partitionBy("job_id", F.lower("path")))
    own = entries.withColumn("fault", F.when(~good, "path").when(n_same > 1, "repeated-path").when(F.crc32("data") != F.col("crc32"), "crc"))
    listed = records.select("job_id", "path", F.col("bytes").alias("said"), F.col("sha256").alias("hash"), F.lit(True).alias("listed"))
    both = own.join(listed, ["job_id", "path"], "full")
    size = F.octet_length("data").cast("long")
    fault = F.coalesce("fault", F.when(F.col("listed") & F.col("data").isNull(), "no-entry").when(F.col("listed") & (size != F.col("said")), "length").when(F.col("listed") & F.col("hash").isNotNull() & (F.sha2("data", 256) != F.col("hash")), "hash"))
    return both.withColumn("fault", fault).groupBy("job_id").agg(F.count("fault").alias("n_faults"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("path"))).alias("first_fault"))


def runtime_plan(records: DataFrame, mappings: DataFrame) -> DataFrame:
    """Saved secondary ``records`` (job_id, id, is_primary, state, type, original_url, final_url) with the path of ``mappings``.

    ``mappings``: job_id, url, resource_type, path. aliases are the other URLs that lead to a record. A record
    without a path is an error.
    """
    taken = records.filter((F.col("state") == "saved") & ~F.col("is_primary")).withColumn("ended", F.coalesce("final_url", "original_url"))
    known = with_url(taken, "ended", "u").withColumn("url", F.col("u.href"))
    joined = known.join(mappings.select("job_id", "url", F.col("resource_type").alias("type"), "path"), ["job_id", "url", "type"], "left")
    path = F.when(F.col("path").isNull(), F.raise_error(F.concat(F.lit("no path for "), F.col("id")))).otherwise(F.col("path"))
    aliases = F.array_sort(F.array_distinct(F.filter(F.array("original_url", "final_url"), lambda a: a.isNotNull() & (a != F.col("url")))))
    return joined.select("job_id", "id", "url", "type", path.alias("path"), aliases.alias("aliases"))


def online_dependencies(dependencies: DataFrame) -> DataFrame:
    """job_id, dependencies: the different network URLs (job_id, url) that an archive still needs, redacted and sorted."""
    rows = with_url(dependencies, "url", "u").withColumn("shown", redacted_url(F.col("u"))).filter("shown is not null")
    return rows.groupBy("job_id").agg(F.array_sort(F.collect_set("shown")).alias("dependencies"))


def gated(summaries: DataFrame) -> DataFrame:
    """``summaries`` of audits; reading an archive that has not passed is an error."""
    failed = F.raise_error(F.concat(F.lit("archive-integrity-failed: "), F.col("job_id").cast("string")))
    return summaries.withColumn("passed", F.when(F.col("passed"), True).otherwise(failed))


def sound_jobs(records: DataFrame, entries: DataFrame, references: DataFrame) -> DataFrame:
    """job_id of jobs whose entries agree with their records and whose offline audit passes."""
    bad = with_hashes(records, entries).filter("fault is not null").select("job_id")
    passed = audit_summary(audited(references, entries)).filter("passed").select("job_id")
    unreferenced = entries.select("job_id").distinct().join(references.select("job_id").distinct(), "job_id", "left_anti")
    return passed.unionByName(unreferenced).join(bad, "job_id", "left_anti")


def packaged(records: DataFrame, entries: DataFrame, references: DataFrame) -> DataFrame:
    """job_id, part, archive of jobs that are sound, their entries alone; other jobs have no row. ``packages.package`` adds manifests."""
    return zipped(entries.join(sound_jobs(records, entries, references), "job_id", "left_semi"))
