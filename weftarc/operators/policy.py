"""Which elements and resources a capture leaves out, and the records that it starts with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftarc.functions.privacy import is_sensitive
from weftarc.functions.urls import origin, permission_pattern, with_url
from weftarc.operators.evidence import third_party_policy
from weftarc.sources.html import attribute

# Words in the URLs of elements that measure or take payments (not the list for third parties).
TRACKING = "analytics?|tracking|tracker|telemetry|beacon|collect|pixel|doubleclick|tagmanager|gtm"
PAYMENT = "payment|payments|checkout|billing|stripe|paypal|adyen|braintree"
# Attributes with URLs, reasons, link relations and script types.
URL_ATTRIBUTES = ("src", "href", "data", "action", "formaction", "poster")
REASONS = ("extension-injection", "tracking-runtime", "payment-runtime", "nonportable-iframe")
SPECULATIVE = ("dns-prefetch", "preconnect", "prefetch", "prerender", "modulepreload")
SCRIPT_TYPES = ("", "text/javascript", "application/javascript", "text/ecmascript", "application/ecmascript", "module")
# What marks a script as one that measures, asks for consent or takes payments, in its URL or its text.
SCRIPT_SIGNALS = (
    "googletagmanager", "google-analytics", "gtag(", "mixpanel", "mxpnl", "clarity.ms", "hotjar", "connect.facebook.net",
    "fbevents", "segment.com", "cdn.segment", "cookieyes", "cookiebot", "onetrust", "js.stripe.com",
)


def _signal(url: Column, words: str) -> Column:
    return url.rlike(f"(?i)(?:^|[./?&=_-])(?:{words})(?:[./?&=_-]|$)")


def runtime_elements(found: DataFrame) -> DataFrame:
    """``found`` elements with ``reason`` (one of REASONS) where a capture removes them; the first reason that holds."""
    urls = with_url_list(found)
    tag = F.col("tag")
    extension = F.exists("__urls", lambda u: u.rlike("^(chrome|moz)-extension:")) | (tag.isin("script", "style") & F.coalesce(F.col("text"), F.lit("")).rlike("(chrome|moz)-extension:"))
    reason = (
        F.when(extension, REASONS[0])
        .when(tag.isin("script", "iframe", "img", "embed", "object") & F.exists("__urls", lambda u: _signal(u, TRACKING)), REASONS[1])
        .when(tag.isin("script", "iframe", "embed", "object") & F.exists("__urls", lambda u: _signal(u, PAYMENT)), REASONS[2])
        .when((tag == "iframe") & attribute("srcdoc").isNull(), REASONS[3])
    )
    return urls.withColumn("reason", reason).drop("__urls")


def with_url_list(found: DataFrame) -> DataFrame:
    """Adds __urls: what the element's URL attributes resolve to."""
    based = found
    for k in URL_ATTRIBUTES:
        based = with_url(based.withColumn("__v", attribute(k)), "__v", f"__{k}", "base_url")
    listed = F.filter(F.array(*[F.col(f"__{k}.href") for k in URL_ATTRIBUTES]), lambda u: u.isNotNull())
    return based.withColumn("__urls", listed).drop("__v", *[f"__{k}" for k in URL_ATTRIBUTES])


def cleanup_counts(found: DataFrame) -> DataFrame:
    """page_id, removed and a count for each of REASONS, zeros included."""
    counts = [F.count_if(F.col("reason") == r).alias("n_" + r.replace("-", "_")) for r in REASONS]
    return runtime_elements(found).groupBy("page_id").agg(F.count("reason").alias("removed"), *counts)


def kept_attributes(attrs: Column, tag: Column) -> Column:
    """Attributes of a kept element without form values and secrets."""
    field = is_sensitive(attrs["id"]) | is_sensitive(attrs["name"]) | is_sensitive(attrs["autocomplete"])
    meta = (tag == "meta") & (is_sensitive(attrs["name"]) | is_sensitive(attrs["property"]) | is_sensitive(attrs["http-equiv"]))
    value = tag.isin("input", "textarea", "select", "output", "button")
    return F.map_filter(
        attrs,
        lambda k, _: ~is_sensitive(k)
        & ~(value & (k == "value")) & ~((tag == "input") & (k == "checked")) & ~((tag == "option") & (k == "selected"))
        & ~(field & k.isin("value", "checked", "selected")) & ~(meta & (k == "content")),
    )


def is_executable_script(tag: Column, attrs: Column) -> Column:
    kind = F.lower(F.trim(F.split_part(F.coalesce(attrs["type"], F.lit("")), F.lit(";"), F.lit(1))))
    return (tag == "script") & kind.isin(*SCRIPT_TYPES)


def is_tracking_script(tag: Column, attrs: Column, text: Column) -> Column:
    """Whether a script that runs bears one of SCRIPT_SIGNALS."""
    source = F.lower(F.concat_ws("\n", attrs["src"], text))
    return is_executable_script(tag, attrs) & F.exists(F.array(*map(F.lit, SCRIPT_SIGNALS)), lambda s: F.contains(source, s))


def is_speculative_link(tag: Column, attrs: Column) -> Column:
    return (tag == "link") & F.arrays_overlap(F.split(F.lower(F.trim(F.coalesce(attrs["rel"], F.lit("")))), r"\s+"), F.array(*map(F.lit, SPECULATIVE)))


def queued_records(nodes: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, id, url, type, state of a job's document and of its page's resources.

    ``nodes``: page_id, ordinal, url, resource_type, kind, only_beacons. ``jobs``: job_id, page_id, page_url,
    include_scripts, include_media, include_third_party. Skipped: what is no network URL, scripts or media that
    are not wanted, what third-party policy excludes, third parties that are not wanted.
    """
    rows = with_url(with_url(nodes.join(jobs, "page_id"), "url", "u"), "page_url", "p")
    kind = F.col("resource_type")
    unwanted = (~F.col("include_scripts") & (kind == "script")) | (~F.col("include_media") & kind.isin("video", "audio"))
    policy = third_party_policy(F.col("url"), kind, F.col("only_beacons"))["policy"]
    foreign = origin(F.col("u")) != origin(F.col("p"))
    skipped = (F.col("kind") != "network") | unwanted | (policy != "archive-critical") | (foreign & ~F.col("include_third_party"))
    others = rows.select(
        "job_id", F.concat_ws(":", F.col("job_id").cast("string"), F.lit("resource"), F.col("ordinal").cast("string")).alias("id"), "url", kind.alias("type"),
        F.when(F.coalesce(skipped, F.lit(True)), "skipped").otherwise("queued").alias("state"),
    )
    documents = jobs.select("job_id", F.concat(F.col("job_id").cast("string"), F.lit(":document")).alias("id"), F.col("page_url").alias("url"), F.lit("document").alias("type"), F.lit("queued").alias("state"))
    return documents.unionByName(others)


def script_records(found: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, id, url, type, state of records that scripts led to: skipped only by what the job's settings leave out.

    ``found``: job_id, id, url, type. ``jobs`` as for ``queued_records``. Third-party policy is not asked here: what a script
    loads on its own is taken as it is.
    """
    rows = with_url(with_url(found.join(jobs.select("job_id", "page_url", "include_scripts", "include_media", "include_third_party"), "job_id"), "url", "u"), "page_url", "p")
    unwanted = (~F.col("include_scripts") & (F.col("type") == "script")) | (~F.col("include_media") & F.col("type").isin("video", "audio"))
    foreign = F.coalesce(origin(F.col("u")) != origin(F.col("p")), F.lit(True))
    skipped = unwanted | (foreign & ~F.col("include_third_party"))
    return rows.select("job_id", "id", "url", "type", F.when(F.coalesce(skipped, F.lit(True)), "skipped").otherwise("queued").alias("state"))


def page_access(pages: DataFrame, grants: DataFrame) -> DataFrame:
    """page_id, status, pattern of pages (page_id, page_url): missing-url, invalid-url, unsupported-protocol, granted or not-granted.

    ``grants``: pattern. A pattern has no port, so it stands for every port of its host.
    """
    rows = with_url(pages, "page_url", "u")
    bad = F.when(F.trim(F.coalesce("page_url", F.lit(""))) == "", "missing-url").when(F.col("u").isNull(), "invalid-url").when(~F.col("u.scheme").isin("http", "https"), "unsupported-protocol")
    rows = rows.withColumn("bad", bad).withColumn("pattern", F.when(bad.isNull(), permission_pattern(F.col("u"))))
    known = grants.select("pattern").distinct().withColumn("granted", F.lit(True))
    return rows.join(known, "pattern", "left").select("page_id", F.coalesce("bad", F.when(F.col("granted"), "granted").otherwise("not-granted")).alias("status"), "pattern")
