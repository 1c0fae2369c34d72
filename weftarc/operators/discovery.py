"""Resource candidates of pages, from the rows of ``sources.html.elements``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftarc.functions.tables import written
from weftarc.functions.urls import origin, with_url
from weftarc.sources.html import attribute, elements
from weftarc.sources.text_scans import css_references, javascript_references, srcset_candidates

# Where pages refer to resources.
SRC_TAGS = ("audio", "embed", "frame", "iframe", "img", "script", "source", "track", "video")
LINK_RELATIONS = ("apple-touch-icon", "icon", "manifest", "mask-icon", "modulepreload", "preload", "stylesheet")
ATTRIBUTES = ("src", "href", "srcset", "imagesrcset", "poster")
SVG_TAGS = ("clippath", "feimage", "filter", "image", "lineargradient", "mask", "mpath", "pattern", "radialgradient", "script", "textpath", "use")
SVG_STYLES = ("clip-path", "cursor", "fill", "filter", "marker", "marker-end", "marker-mid", "marker-start", "mask", "stroke")


def resource_attributes() -> dict[str, Column]:
    """Of each of ATTRIBUTES, whether it refers to a resource on the element of a row."""
    tag, rel = F.col("tag"), F.split(F.lower(F.trim(F.coalesce(attribute("rel"), F.lit("")))), r"\s+")
    link = (tag == "link") & F.arrays_overlap(rel, F.array(*map(F.lit, LINK_RELATIONS)))
    image_input = (tag == "input") & (F.lower(F.coalesce(attribute("type"), F.lit(""))) == "image")
    return {"src": tag.isin(*SRC_TAGS) | image_input, "href": link, "srcset": tag.isin("img", "source"), "imagesrcset": link, "poster": tag == "video"}


def dom_candidates(found: DataFrame) -> DataFrame:
    """page_id, element_no, tag, attribute, descriptor, raw_url, resolved_url in document order (ordinal from 1).

    Blank references and those that do not resolve are left out; repeated ones stay.
    """
    eligible = resource_attributes()
    read = F.array(*[F.when(eligible[a] & attribute(a).isNotNull(), F.struct(F.lit(k).alias("rank"), F.lit(a).alias("name"), attribute(a).alias("value"))) for k, a in enumerate(ATTRIBUTES)])
    attrs = found.select("page_id", "base_url", "element_no", "tag", F.explode(F.filter(read, lambda a: a.isNotNull())).alias("a")).select("*", "a.*")
    sets = F.col("name").isin("srcset", "imagesrcset")
    one = F.array(F.struct(F.col("value").alias("raw_url"), F.lit(None).cast("string").alias("descriptor"), F.lit(0).alias("start"), F.length("value").alias("stop")))
    split = attrs.withColumn("listed", srcset_candidates(F.when(sets, F.col("value")))).withColumn("parts", F.when(sets, F.col("listed")).otherwise(one))
    each = split.select("page_id", "base_url", "element_no", "tag", "rank", "name", F.posexplode("parts").alias("part", "c")).select("*", "c.raw_url", "c.descriptor")
    resolved = with_url(each.filter(F.trim("raw_url") != ""), "raw_url", "u", "base_url").filter("u is not null")
    order = Window.partitionBy("page_id").orderBy("element_no", "rank", "part")
    return resolved.select("page_id", F.row_number().over(order).alias("ordinal"), "element_no", "tag", F.col("name").alias("attribute"), "descriptor", "raw_url", F.col("u.href").alias("resolved_url"))


def css_sources(found: DataFrame) -> DataFrame:
    """page_id, base_url, ordinal, source_type, tag, attribute, css_text: style attributes, SVG presentation attributes, style elements."""
    made = lambda k, kind, name, text: F.when(F.trim(text) != "", F.struct(F.lit(k).alias("rank"), F.lit(kind).alias("source_type"), F.lit(name).alias("attribute"), text.alias("css_text")))
    styled = [made(k + 1, "svg-presentation-attribute", a, F.when(F.col("in_svg") & F.contains(F.lower(attribute(a)), F.lit("url(")), F.concat(F.lit(f"{a}: "), attribute(a)))) for k, a in enumerate(SVG_STYLES)]
    read = F.array(made(0, "style-attribute", "style", attribute("style")), *styled, made(99, "style-element", None, F.when(F.col("tag") == "style", F.col("text"))))
    rows = found.select("page_id", "base_url", "element_no", "tag", F.explode(F.filter(read, lambda a: a.isNotNull())).alias("s")).select("*", "s.*")
    order = Window.partitionBy("page_id").orderBy("element_no", "rank")
    return rows.select("page_id", "base_url", F.row_number().over(order).alias("ordinal"), "source_type", "tag", "attribute", "css_text")


def css_candidates(sources: DataFrame) -> DataFrame:
    """page_id, ordinal, source_ordinal, kind, property, format, raw_url, resolved_url of the references of ``css_sources``."""
    parts = sources.select("page_id", "base_url", F.col("ordinal").alias("source_ordinal"), "source_type", F.posexplode(css_references("css_text")).alias("part", "c")).select("*", "c.*")
    resolved = with_url(parts.filter((F.trim("raw_url") != "") & ~F.col("raw_url").startswith("#")), "raw_url", "u", "base_url").filter("u is not null")
    order = Window.partitionBy("page_id").orderBy("source_ordinal", "part")
    return resolved.select("page_id", F.row_number().over(order).alias("ordinal"), "source_ordinal", "source_type", "kind", "property", "format", "raw_url", F.col("u.href").alias("resolved_url"))


def svg_candidates(found: DataFrame) -> DataFrame:
    """page_id, ordinal, tag, attribute, raw_url, resolved_url of href and xlink:href inside svg; own fragments are left out."""
    read = F.array(*[F.when(attribute(a).isNotNull(), F.struct(F.lit(k).alias("rank"), F.lit(a).alias("attribute"), F.trim(attribute(a)).alias("raw_url"))) for k, a in enumerate(("href", "xlink:href"))])
    rows = found.filter(F.col("in_svg") & F.col("tag").isin(*SVG_TAGS))
    rows = rows.select("page_id", "base_url", "element_no", "tag", F.explode(F.filter(read, lambda a: a.isNotNull())).alias("s")).select("*", "s.*")
    resolved = with_url(rows.filter((F.col("raw_url") != "") & ~F.col("raw_url").startswith("#")), "raw_url", "u", "base_url").filter("u is not null")
    order = Window.partitionBy("page_id").orderBy("element_no", "rank")
    return resolved.select("page_id", F.row_number().over(order).alias("ordinal"), "tag", "attribute", "raw_url", F.col("u.href").alias("resolved_url"))


def script_references(found: DataFrame) -> DataFrame:
    """page_id, ordinal, kind, raw_url, resolved_url of inline scripts; of a URL that comes again on a page, the first."""
    scripts = found.filter((F.col("tag") == "script") & (F.trim("text") != ""))
    rows = scripts.select("page_id", "base_url", "element_no", F.posexplode(javascript_references("text")).alias("part", "r")).select("*", "r.*")
    resolved = with_url(rows, "raw_url", "u", "base_url").filter(F.col("u.scheme").isin("http", "https")).withColumn("resolved_url", F.col("u.href"))
    first = resolved.groupBy("page_id", "resolved_url").agg(F.min(F.struct("element_no", "part", "kind", "raw_url")).alias("f")).select("page_id", "resolved_url", "f.*")
    order = Window.partitionBy("page_id").orderBy("element_no", "part")
    return first.select("page_id", F.row_number().over(order).alias("ordinal"), "kind", "raw_url", "resolved_url")


def regions(found: DataFrame) -> DataFrame:
    """page_id, ordinal, resolved_url, status of frames: sandboxed, cross-origin or same-origin-candidate; shadow roots by their templates."""
    rows = found.filter(F.col("tag").isin("iframe", "frame") | attribute("shadowrootmode").isNotNull())
    rows = with_url(with_url(rows.withColumn("src", F.coalesce(attribute("src"), F.lit("about:blank"))), "src", "u", "base_url"), "url", "p")
    sandboxed = attribute("sandbox").isNotNull() & ~F.array_contains(F.split(F.lower(attribute("sandbox")), r"\s+"), "allow-same-origin")
    status = (
        F.when(attribute("shadowrootmode").isNotNull(), F.concat(F.lit("shadow-"), F.lower(attribute("shadowrootmode"))))
        .when(sandboxed, "sandboxed")
        .when(attribute("srcdoc").isNotNull() | (F.col("u.scheme") == "about"), "same-origin-candidate")
        .when(origin(F.col("u")) == origin(F.col("p")), "same-origin-candidate")
        .otherwise("cross-origin")
    )
    order = Window.partitionBy("page_id").orderBy("element_no")
    return rows.select("page_id", F.row_number().over(order).alias("ordinal"), "tag", F.col("u.href").alias("resolved_url"), status.alias("status"))


#: Frames in frames that are gone into; a page that goes on deeper has a region with the reason too-deep there.
MOST_LEVELS = 16


def page_regions(pages: DataFrame) -> DataFrame:
    """page_id, ordinal, depth, kind (iframe or shadow-root), access, reason, source_origin of the regions of ``pages`` (page_id, url, html).

    Level by level: what is in a frame's srcdoc is a page of the next level, while open shadow roots of one document are gone into at once, as
    the tree has them. depth counts both. What is in a frame that cannot be read has that frame's reason; other frames are sandboxed, cross-origin,
    same-origin, or unavailable (a data URL or none that is valid). Regions are numbered by depth, then by place. Closed shadow roots show nothing.
    """
    level = pages.select("page_id", "url", "html", F.lit(0).alias("base_depth"), F.array().cast("array<int>").alias("way"), F.lit(None).cast("string").alias("inherited"))
    found: DataFrame | None = None
    for n in range(MOST_LEVELS + 1):
        rows = level.select(F.struct("page_id", "way", "base_depth", "inherited").alias("page_id"), "url", "html")
        seen = elements(rows, templates=True).filter("shadow_depth >= 0").select("page_id.*", "url", "element_no", "tag", "attrs", "in_svg", (F.col("page_id.base_depth") + F.col("shadow_depth")).alias("depth"), "shadow_depth", "template_no", "parent_no")
        root = (F.col("tag") == "template") & (F.lower(attribute("shadowrootmode")) == "open")
        first = F.row_number().over(Window.partitionBy("page_id", "way", "parent_no", root).orderBy("element_no")) == 1
        seen = seen.filter(((F.col("tag") == "iframe") & ~F.col("in_svg")) | root).withColumn("is_first", first).filter((F.col("tag") == "iframe") | F.col("is_first"))
        src = F.coalesce(attribute("src"), F.lit(""))
        seen = with_url(with_url(seen.withColumn("src", F.when(attribute("srcdoc").isNotNull() | (F.trim(src) == ""), F.col("url")).otherwise(src)), "src", "u", "url"), "url", "p")
        sandboxed = attribute("sandbox").isNotNull() & ~F.array_contains(F.split(F.lower(attribute("sandbox")), r"\s+"), "allow-same-origin")
        own = (
            F.when(F.col("tag") == "template", "open-shadow-root").when(sandboxed, "sandboxed").when(F.lit(n == MOST_LEVELS) & attribute("srcdoc").isNotNull(), "too-deep").when(origin(F.col("u")) == origin(F.col("p")), "same-origin")
            .when(origin(F.col("u")).isNotNull(), "cross-origin").otherwise("unavailable")
        )
        reason = F.coalesce("inherited", own)
        seen = seen.withColumn("reason", reason).withColumn("at", F.array_append("way", F.col("element_no")))
        seen = written(seen.select("page_id", "url", "at", "depth", F.when(F.col("tag") == "iframe", "iframe").otherwise("shadow-root").alias("kind"), "reason", F.when(F.col("tag") == "iframe", origin(F.col("u"))).alias("source_origin"), attribute("srcdoc").alias("srcdoc")), "regions")
        found = seen if found is None else found.unionByName(seen)
        closed = F.col("reason").isin("sandboxed", "cross-origin", "unavailable")
        level = seen.filter("kind = 'iframe' and srcdoc is not null").select("page_id", "url", F.col("srcdoc").alias("html"), (F.col("depth") + 1).alias("base_depth"), F.col("at").alias("way"), F.when(closed, F.col("reason")).alias("inherited"))
        if level.isEmpty():
            break
    readable = F.col("reason").isin("same-origin", "open-shadow-root")
    order = Window.partitionBy("page_id").orderBy("depth", "at")
    return found.select("page_id", F.row_number().over(order).cast("long").alias("ordinal"), "depth", "kind", F.when(readable, "accessible").otherwise("inaccessible").alias("access"), "reason", "source_origin")


def navigation_links(found: DataFrame) -> DataFrame:
    """page_id, ordinal, raw_url, resolved_url of a[href] and area[href]: where a page leads, never resources of it."""
    rows = found.filter(F.col("tag").isin("a", "area") & attribute("href").isNotNull()).withColumn("raw_url", attribute("href"))
    resolved = with_url(rows, "raw_url", "u", "base_url").filter("u is not null")
    order = Window.partitionBy("page_id").orderBy("element_no")
    return resolved.select("page_id", F.row_number().over(order).alias("ordinal"), "raw_url", F.col("u.href").alias("resolved_url"))
