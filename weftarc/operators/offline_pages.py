"""Pages as they go into an archive: one rewrite of each, from the spans of all that changes in it.

What can hold references is laid out as slots: attributes, srcset values, style and presentation attributes, and the texts of style
elements and scripts. All references of all slots meet the saved resources in one join. Then spans are merged from the inside out: those
in a slot make its new value (a replaced call outranks the references inside it), a slot's value goes into its start tag or, if
it is a text, stands for itself, and what is left of the page's spans, with the guard and the policy at the head's beginning, is applied
once. Start tags with changed attributes are written anew, all other characters stay.

Edge cases: null and empty pages are empty. Elements without a tag of their own in the page are not touched, nor is what is in a template. Without a head
tag, guard and policy stand before the first element that is not html. A page without elements in ``found`` stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftarc.operators.csp import POLICY_HEADERS
from weftarc.operators.discovery import SVG_STYLES, SVG_TAGS, resource_attributes
from weftarc.operators.policy import is_executable_script, is_speculative_link, is_tracking_script, kept_attributes
from weftarc.operators.rewrite import NEUTRAL, SPANS, applied, dotted, good_descriptor, resolved, spliced
from weftarc.operators.service_workers import DENIED, GUARD, registrations_of, script_kind
from weftarc.sources.text_scans import css_references, javascript_references, srcset_candidates

TEXT_SLOT = "#text"
DIRECT, SETS, STYLES, SCRIPTS = "direct", "srcset", "css", "script"
KINDS = (DIRECT, SETS, STYLES, SCRIPTS)
INERT_TYPE = "application/x-disabled-script"


def _escaped(v: Column) -> Column:
    return F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))


def start_tag(tag: Column, attrs: Column, closed: Column) -> Column:
    """A start tag written anew."""
    parts = F.transform(F.map_entries(attrs), lambda e: F.when(e["value"] == "", F.concat(F.lit(" "), e["key"])).otherwise(F.concat(F.lit(" "), e["key"], F.lit('="'), _escaped(e["value"]), F.lit('"'))))
    return F.concat(F.lit("<"), tag, F.array_join(parts, ""), F.when(closed, "/>").otherwise(">"))


def _slots(frozen: Column) -> Column:
    """What of an element can hold references: array of struct<slot, kind, value, lead>; a value begins with ``lead`` characters that are not in the slot."""
    tag, attrs, may = F.col("tag"), F.col("attrs"), resource_attributes()
    svg = F.col("in_svg") & tag.isin(*SVG_TAGS)

    def slot(name: str, kind: str, value: Column, lead: str = "") -> Column:
        whole = F.concat(F.lit(lead), value) if lead else value
        return F.when(F.trim(value) != "", F.struct(F.lit(name).alias("slot"), F.lit(kind).alias("kind"), whole.alias("value"), F.lit(len(lead)).alias("lead")))

    own = ~F.trim(attrs["href"]).startswith("#") & ~is_speculative_link(tag, attrs)
    slots = [slot("src", DIRECT, F.when(may["src"], attrs["src"])), slot("poster", DIRECT, F.when(may["poster"], attrs["poster"]))]
    slots += [slot("href", DIRECT, F.when(own & (may["href"] | svg), attrs["href"])), slot("xlink:href", DIRECT, F.when(svg & ~F.trim(attrs["xlink:href"]).startswith("#"), attrs["xlink:href"]))]
    slots += [slot(a, SETS, F.when(may[a], attrs[a])) for a in ("srcset", "imagesrcset")]
    slots += [slot("style", STYLES, attrs["style"])] + [slot(a, STYLES, F.when(F.col("in_svg") & F.contains(F.lower(attrs[a]), F.lit("url(")), attrs[a]), f"{a}: ") for a in SVG_STYLES]
    slots += [slot(TEXT_SLOT, STYLES, F.when(tag == "style", F.col("text"))), slot(TEXT_SLOT, SCRIPTS, F.when((tag == "script") & script_kind(attrs).startswith("inline") & ~frozen, F.col("text")))]
    return F.filter(F.array(*slots), lambda s: s.isNotNull())


def _references(slots: DataFrame) -> DataFrame:
    """``slots`` with the references in each: raw_url, start and stop in the slot."""
    kind, value = F.col("kind"), F.col("value")
    read = slots.withColumn("__sets", srcset_candidates(F.when(kind == SETS, value))).withColumn("__css", css_references(F.when(kind == STYLES, value))).withColumn("__js", javascript_references(F.when(kind == SCRIPTS, value)))
    one = lambda r: F.struct(r["raw_url"], r["start"].alias("start"), r["stop"].alias("stop"))
    listed = (
        F.when(kind == SETS, F.transform(F.filter("__sets", lambda c: good_descriptor(c["descriptor"])), one)).when(kind == STYLES, F.transform("__css", one)).when(kind == SCRIPTS, F.transform("__js", one))
        .otherwise(F.array(F.struct(value.alias("raw_url"), F.lit(0).alias("start"), F.length(value).alias("stop"))))
    )
    rows = read.withColumn("r", F.explode(listed)).drop("__sets", "__css", "__js")
    return rows.withColumn("raw_url", F.col("r.raw_url")).withColumn("start", F.col("r.start") - F.col("lead")).withColumn("stop", F.col("r.stop") - F.col("lead")).drop("r")


def _spans(new: Column) -> Column:
    row = F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), new.alias("new"))
    return F.array_sort(F.collect_list(F.when(new.isNotNull(), row)))


def rewrite_html(
    found: DataFrame, pages: DataFrame, saved: DataFrame, policy: str | None = None, freeze_scripts: bool = False, neutralise: bool = False, freeze_tracking: bool = False, guard: bool = False
) -> DataFrame:
    """page_id, html, n_rewritten, n_unmapped, n_srcset, n_css, n_script of pages (page_id, job_id, source_path, base_url, html) with their elements.

    References to ``saved`` resources become ways in the archive: n_rewritten of direct ones (n_unmapped: of others that have no resource), n_srcset, n_css
    and n_script of those inside values and texts. Removed: base elements, speculative links, CSP metas, secrets, form values, and integrity and
    crossorigin where a reference changed. ``policy``, a new CSP, and ``guard``, a script that denies service workers, come first in
    the head; with ``guard`` calls that register one are replaced. ``freeze_scripts`` makes executable scripts inert, ``freeze_tracking``
    only those that track. ``neutralise``: direct references without a resource are removed, others load nothing.
    """
    found = found.drop("base_url").filter("start is not null")  # the pages' own base is taken
    info = pages.select("page_id", "job_id", "source_path", "base_url")
    tag, attrs = F.col("tag"), F.col("attrs")
    frozen = is_executable_script(tag, attrs) if freeze_scripts else is_tracking_script(tag, attrs, F.col("text")) if freeze_tracking else F.lit(False)
    slots = found.select("page_id", "element_no", F.inline(_slots(frozen)))
    done = resolved(_references(slots.join(info, "page_id")), saved, neutralise)
    kind, way = F.col("kind"), F.col("replacement")
    changed = (F.col("status") == "rewritten") | (F.lit(neutralise) & (kind != SCRIPTS))
    new = F.when(changed & way.isNotNull(), F.when(kind == STYLES, F.concat(F.lit('url("'), way, F.lit('")'))).when(kind == SCRIPTS, dotted(way)).otherwise(way))
    rewritten = F.col("status") == "rewritten"
    counts = [F.count_if(rewritten & (kind == k)).alias(n) for k, n in zip(KINDS, ("n_rewritten", "n_srcset", "n_css", "n_script"), strict=True)]
    per_slot = done.groupBy("page_id", "element_no", "slot").agg(_spans(new).alias("spans"), F.first("kind").alias("kind"), *counts, F.count_if((F.col("status") == "unmapped") & (kind == DIRECT)).alias("n_unmapped"))
    summed = ("n_rewritten", "n_unmapped", "n_srcset", "n_css", "n_script")
    per_element = per_slot.groupBy("page_id", "element_no").agg(
        F.map_from_entries(F.collect_list(F.when(F.size("spans") > 0, F.struct("slot", "spans")))).alias("changes"), *[F.sum(n).alias(n) for n in summed],
        F.bool_or((F.size("spans") > 0) & (kind == DIRECT)).alias("direct"), F.bool_or((F.size("spans") > 0) & (kind == SETS)).alias("sets"),
    )
    rows = found.join(per_element, ["page_id", "element_no"], "left").withColumn("changes", F.coalesce("changes", F.create_map().cast(f"map<string, {SPANS}>")))
    value = lambda k, v: F.when(F.map_contains_key("changes", k), applied(v, F.try_element_at("changes", k))).otherwise(v)
    merged = F.transform_values(kept_attributes(attrs, tag), value)
    if neutralise:
        merged = F.map_filter(merged, lambda k, v: ~(k.isin("src", "href", "poster", "xlink:href") & (v == NEUTRAL)))
    merged = F.map_filter(merged, lambda k, _: ~((F.coalesce("direct", F.lit(False)) & k.isin("integrity", "crossorigin")) | (F.coalesce("sets", F.lit(False)) & (k == "crossorigin"))))
    if freeze_scripts or freeze_tracking:
        inert = F.map_concat(F.map_filter(merged, lambda k, _: k != "type"), F.create_map(F.lit("type"), F.lit(INERT_TYPE)))
        merged = F.when(frozen, inert).otherwise(merged)
    csp = (tag == "meta") & F.lower(F.trim(F.coalesce(attrs["http-equiv"], F.lit("")))).isin(*POLICY_HEADERS)
    gone = (tag == "base") | is_speculative_link(tag, attrs) | csp
    # the spans of a text: replaced calls and references
    inner = F.coalesce(F.try_element_at("changes", F.lit(TEXT_SLOT)), F.array().cast(SPANS))
    if guard:
        rows = rows.withColumn("__calls", registrations_of(F.when((tag == "script") & script_kind(attrs).startswith("inline") & ~frozen, F.col("text")))["calls"])
        calls = F.transform("__calls", lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.lit(DENIED).alias("new")))
        inner = F.concat(F.coalesce(calls, F.array().cast(SPANS)), inner)
    rows = rows.withColumn("__inner", inner).withColumn("__text", spliced(F.when(F.size("__inner") > 0, F.col("text")), "__inner")).withColumn("__merged", merged)
    in_text, merged = F.col("__text"), F.col("__merged")
    in_text = F.when(F.col("in_svg"), F.replace(F.replace(in_text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))).otherwise(in_text)
    in_tag = F.when(gone, "").when(F.map_entries(merged) != F.map_entries(attrs), start_tag(tag, merged, F.col("closed")))
    span = lambda start, stop, text: F.when(text.isNotNull(), F.struct(start.alias("start"), stop.alias("stop"), text.alias("new")))
    own = F.filter(F.array(span(F.col("start"), F.col("stop"), in_tag), span(F.col("text_start"), F.col("text_stop"), in_text)), lambda s: s.isNotNull())
    per_page = rows.withColumn("own", own).groupBy("page_id").agg(
        F.flatten(F.collect_list("own")).alias("spans"), F.min(F.when(tag == "head", F.col("stop"))).alias("head"), F.min(F.when(~tag.isin("html", "head"), F.col("start"))).alias("first"), *[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in summed]
    )
    joined = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).join(per_page, "page_id", "left")
    spans = F.coalesce("spans", F.array().cast(SPANS))
    install = (GUARD if guard else "") + ("" if policy is None else f'<meta http-equiv="Content-Security-Policy" content="{_quoted(policy)}">')
    if install:
        at = F.coalesce("head", "first")
        spans = F.when(at.isNull(), spans).otherwise(F.concat(spans, F.array(F.struct(at.alias("start"), at.alias("stop"), F.lit(install).alias("new")))))
    return joined.select("page_id", spliced("html", spans).alias("html"), *[F.coalesce(n, F.lit(0)).alias(n) for n in summed])


def _quoted(value: str) -> str:
    return value.replace("&", "&amp;").replace('"', "&quot;")
