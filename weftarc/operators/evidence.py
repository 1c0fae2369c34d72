"""Evidence of resources merged by URL, its graph, inferred types, and third-party summaries.

Evidence rows: page_id, page_url, channel, source_ordinal, value, and what the channel knows: tag, attribute,
css_kind, css_property, css_source_type, initiator (null where it does not apply). Order is that of channels,
then of ordinals. Groups are by page and URL, so they are as small as a page's references to one thing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftarc.functions.media import extension_of, media_of_extension, type_of_extension, type_of_media
from weftarc.functions.tables import written
from weftarc.functions.urls import network_target, origin, permission_pattern, url_class, with_url

CHANNELS = ("dom-attribute", "svg-attribute", "css-ast", "performance")
# CSS properties that show images, and the types that a page cannot be without.
_IMAGE_PROPERTIES = (
    "background", "background-image", "border-image", "border-image-source", "content", "cursor", "filter",
    "list-style", "list-style-image", "mask", "mask-image", "shape-outside",
)
CRITICAL_TYPES = ("stylesheet", "image", "font", "script", "video", "audio", "data", "model", "texture", "wasm")
# Words in URLs of measuring and of paying services.
TRACKING_WORDS = "analytics?|tracking|tracker|telemetry|beacon|collect|pixel|doubleclick|googletagmanager|google-analytics|clarity|hotjar|segment|amplitude|mixpanel"
PAYMENT_WORDS = "payments?|checkout|billing|stripe|paypal|adyen|braintree|klarna"


def _has_word(text: Column, words: str) -> Column:
    return text.rlike(f"(?i)(?:^|[./_?&=-])(?:{words})(?:[./_?&=-]|$)")


def normalised(evidence: DataFrame) -> DataFrame:
    """Evidence with u (the parsed URL), url and channel_rank; what has no normal form is left out."""
    rank = F.array_position(F.array(*map(F.lit, CHANNELS)), F.col("channel"))
    return with_url(evidence, "value", "u").filter("u is not null").withColumn("url", F.col("u.href")).withColumn("channel_rank", rank)


def merged(rows: DataFrame) -> DataFrame:
    """page_id, ordinal (dense, by first evidence), url, n_evidence, channels (in order): one row for each page and URL of ``normalised`` rows."""
    once = rows.groupBy("page_id", "url").agg(
        F.min(F.struct("channel_rank", "source_ordinal")).alias("first"),
        F.countDistinct("channel_rank", "source_ordinal").alias("n_evidence"),
        F.array_sort(F.collect_set("channel_rank")).alias("ranks"),
    )
    names = F.array(*map(F.lit, CHANNELS))
    order = Window.partitionBy("page_id").orderBy("first", "url")
    return once.select("page_id", F.row_number().over(order).alias("ordinal"), "url", "n_evidence", F.transform("ranks", lambda r: F.element_at(names, r.cast("int"))).alias("channels"))


def dom_type() -> Column:
    """The type that an element's place tells; of svg attributes, script or image."""
    tag = F.col("tag")
    dom = (
        F.when(tag == "script", "script")
        .when(tag.isin("img", "input") | (F.col("attribute") == "poster"), "image")
        .when(tag == "video", "video").when(tag == "audio", "audio").when(tag.isin("frame", "iframe"), "document").when(tag == "track", "data")
    )
    return F.when(F.col("channel") == "svg-attribute", F.when(tag == "script", "script").otherwise("image")).when(F.col("channel") == "dom-attribute", dom)


def css_type() -> Column:
    shown = F.lower(F.col("css_property")).isin(*_IMAGE_PROPERTIES) | (F.col("css_source_type") == "svg-presentation-attribute")
    return F.when(F.col("channel") == "css-ast", F.when(F.col("css_kind") == "import", "stylesheet").when(F.col("css_kind") == "font-face", "font").when(shown, "image"))


def initiator_type() -> Column:
    i = F.col("initiator")
    known = F.when(i == "script", "script").when(i.isin("img", "image", "input"), "image").when(i.isin("video", "audio"), i).when(i.isin("frame", "iframe", "navigation"), "document").when(i == "track", "data")
    return F.when(F.col("channel") == "performance", known)


def _hint(priority: int, rank: Column, ordinal: Column, source: str, kind: Column, mime: Column, confidence: str, detail: Column) -> Column:
    return F.struct(
        F.lit(-priority).alias("rank"), rank.cast("int").alias("channel_rank"), ordinal.cast("long").alias("source_ordinal"),
        F.lit(source).alias("source"), kind.alias("resource_type"), mime.cast("string").alias("mime"), F.lit(confidence).alias("confidence"), detail.alias("detail"),
    )


def inferred(rows: DataFrame) -> DataFrame:
    """page_id, url, resource_type, type_source, type_confidence, mime, mime_source, has_conflict, n_hints of ``normalised`` rows.

    Hints rank: a declared data URL type, an element's or style's place, the timing initiator, a data URL's
    default, the file extension; of equal rank the earlier. The first with a type decides it; the media type is
    the first that goes with it.
    """
    none, here, no = F.lit(None).cast("string"), (F.col("channel_rank"), F.col("source_ordinal")), (F.lit(99), F.lit(0))
    header = F.lower(F.trim(F.split_part(F.regexp_extract("u.path", "(?s)^([^,]*),", 1), F.lit(";"), F.lit(1))))
    declared = header.rlike(r"^[a-z0-9!#$&^_.+\-]+/[a-z0-9!#$&^_.+\-]+$")
    is_data = (F.col("u.scheme") == "data") & F.contains(F.col("u.path"), F.lit(","))
    ext = extension_of(F.col("u"))
    hints = F.array(
        F.when(is_data & declared, _hint(500, *no, "data-url-header", type_of_media(header), header, "high", F.lit("data:declared-media-type"))),
        F.when(is_data & (header == ""), _hint(250, *no, "data-url-header", type_of_media(F.lit("text/plain")), F.lit("text/plain"), "medium", F.lit("data:default-media-type"))),
        F.when(dom_type().isNotNull(), _hint(400, *here, "dom-context", dom_type(), none, "high", F.concat(F.lit("dom:"), F.col("channel")))),
        F.when(css_type().isNotNull(), _hint(400, *here, "css-context", css_type(), none, "high", F.concat(F.lit("css:"), F.col("css_kind")))),
        F.when(initiator_type().isNotNull(), _hint(300, *here, "performance-initiator", initiator_type(), none, "medium", F.concat(F.lit("performance:"), F.col("initiator")))),
        F.when(ext.isNotNull(), _hint(100, *no, "url-extension", type_of_extension(ext), media_of_extension(ext), "low", F.concat(F.lit("extension:."), ext))),
    )
    each = rows.select("page_id", "url", F.explode_outer(F.filter(hints, lambda h: h.isNotNull())).alias("h"))
    # equal hints count once, at their first place
    key = [F.col(f"h.{k}").alias(k) for k in ("rank", "source", "resource_type", "mime", "confidence", "detail")]
    once = each.groupBy("page_id", "url", *key).agg(F.min(F.struct("h.channel_rank", "h.source_ordinal")).alias("at"))
    hint = F.struct("rank", "at", "source", "resource_type", "mime", "confidence", "detail")
    of = once.groupBy("page_id", "url").agg(F.array_sort(F.collect_list(F.when(F.col("source").isNotNull(), hint))).alias("hints"))
    typed = F.get(F.filter("hints", lambda h: h["resource_type"].isNotNull()), F.lit(0))
    of = of.withColumn("typed", typed).withColumn("resource_type", F.coalesce("typed.resource_type", F.lit("other")))
    goes = lambda h: h["mime"].isNotNull() & ((F.col("resource_type") == "other") | h["resource_type"].isNull() | (h["resource_type"] == F.col("resource_type")))
    of = of.withColumn("timed", F.get(F.filter("hints", goes), F.lit(0)))
    conflict = F.size(F.array_distinct(F.filter(F.transform("hints", lambda h: h["resource_type"]), lambda t: t.isNotNull()))) > 1
    return of.select(
        "page_id", "url", "resource_type", F.col("typed.source").alias("type_source"), F.coalesce("typed.confidence", F.lit("unknown")).alias("type_confidence"),
        F.col("timed.mime").alias("mime"), F.col("timed.source").alias("mime_source"), conflict.alias("has_conflict"), F.size("hints").alias("n_hints"),
    )


def nodes(rows: DataFrame) -> DataFrame:
    """Resources of pages: ``merged`` with ``inferred`` and the URL's class."""
    known = with_url(merged(rows).join(inferred(rows), ["page_id", "url"]), "url", "u")
    return known.withColumn("class", url_class(F.col("u")))


def edges(rows: DataFrame) -> DataFrame:
    """source_url, target_url, channel, source_ordinal: one for each piece of evidence; timing has the page as its source."""
    return rows.select("page_id", F.col("page_url").alias("source_url"), F.col("url").alias("target_url"), "channel", "source_ordinal").distinct()


def graph_faults(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """page_id, fault, subject of what a graph must not have: repeated nodes, gaps in ordinals, dangling and repeated edges."""
    fault = lambda df, name, subject: df.select("page_id", F.lit(name).alias("fault"), F.col(subject).cast("string").alias("subject"))
    twice = node_rows.groupBy("page_id", "url").count().filter("count > 1")
    gaps = node_rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.countDistinct("ordinal").alias("different")).filter("low != 1 or high != n or different != n")
    dangling = edge_rows.join(node_rows.select("page_id", F.col("url").alias("target_url")), ["page_id", "target_url"], "left_anti")
    again = edge_rows.groupBy("page_id", "target_url", "channel", "source_ordinal").count().filter("count > 1")
    return fault(twice, "repeated-node", "url").unionByName(fault(gaps, "ordinals-not-dense", "n")).unionByName(fault(dangling, "dangling-edge", "target_url")).unionByName(fault(again, "repeated-edge", "target_url"))


def third_party_policy(url: Column, kind: Column, only_beacons: Column) -> Column:
    """struct<policy, reason>: what of a third party belongs in an archive; the first rule that fits."""
    reason = (
        F.when(kind == "document", "iframe-document").when(_has_word(url, TRACKING_WORDS), "tracking-runtime").when(_has_word(url, PAYMENT_WORDS), "payment-runtime")
        .when(only_beacons, "tracking-runtime").when(kind.isin(*CRITICAL_TYPES), "critical-resource-type").otherwise("unsupported-runtime-type")
    )
    return F.struct(F.when(reason == "critical-resource-type", "archive-critical").otherwise("runtime-excluded").alias("policy"), reason.alias("reason"))


def third_party(rows: DataFrame, grants: DataFrame | None = None) -> DataFrame:
    """A row for each page and permission pattern of its public network resources of other origins.

    page_id, pattern, n_origins, n_resources, provenance (evidence of them), n_critical, n_excluded, resource_types and
    reasons (sorted), default_selected, granted (in ``grants`` (pattern)).
    """
    rows = written(rows, "third-party-evidence")  # read twice: for the types and for the sums
    beacons = F.bool_and(F.coalesce((F.col("channel") == "performance") & F.col("initiator").isin("beacon", "ping"), F.lit(False)))
    in_degree = rows.groupBy("page_id", "url").agg(F.first("page_url").alias("page_url"), F.first("u").alias("u"), F.countDistinct("channel_rank", "source_ordinal").alias("provenance"), beacons.alias("only_beacons"))
    known = with_url(inferred(rows).select("page_id", "url", "resource_type").join(in_degree, ["page_id", "url"]), "page_url", "p")
    target = network_target(F.col("url"), F.col("u"))
    other = known.filter((target["status"] == "eligible") & (origin(F.col("u")) != origin(F.col("p"))))
    judged = other.withColumn("policy", third_party_policy(F.col("url"), F.col("resource_type"), F.col("only_beacons"))).withColumn("pattern", permission_pattern(F.col("u")))
    critical = F.col("policy.policy") == "archive-critical"
    summed = judged.groupBy("page_id", "pattern").agg(
        F.countDistinct(origin(F.col("u"))).alias("n_origins"), F.count(F.lit(1)).alias("n_resources"), F.sum("provenance").alias("provenance"),
        F.count_if(critical).alias("n_critical"), F.count_if(~critical).alias("n_excluded"),
        F.array_join(F.array_sort(F.collect_set("resource_type")), ",").alias("resource_types"), F.array_join(F.array_sort(F.collect_set("policy.reason")), ",").alias("reasons"),
    )
    summed = summed.withColumn("default_selected", F.col("n_critical") > 0)
    if grants is None:
        return summed.withColumn("granted", F.lit(False))
    return summed.join(grants.select("pattern").distinct().withColumn("granted", F.lit(True)), "pattern", "left").withColumn("granted", F.coalesce("granted", F.lit(False)))


def page_summary(node_rows: DataFrame, region_rows: DataFrame) -> DataFrame:
    """page_id, resources and evidence, resources by kind, and regions by whether they can be read, zeros included.

    ``node_rows`` as ``nodes`` gives them; ``region_rows``: page_id, status.
    """
    kinds = ("network", "data", "blob", "unsupported")
    resources = node_rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_resources"), F.sum("n_evidence").alias("n_evidence"), *[F.count_if(F.col("class.kind") == k).alias(f"n_{k}") for k in kinds])
    shadow = F.col("status").startswith("shadow-")
    found = region_rows.groupBy("page_id").agg(F.count_if(~shadow).alias("n_frames"), F.count_if(shadow).alias("n_shadow_roots"), F.count_if(F.col("status").isin("sandboxed", "cross-origin", "shadow-closed")).alias("n_unreadable"))
    both = resources.join(found, "page_id", "full")
    return both.select("page_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in both.columns if c != "page_id"])
