"""Pages as elements: the tree of each page's HTML as rows; all else is done on them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from weftarc.functions.batches import each, handed_on
from weftarc.functions.urls import with_url
from weftarc.sources.html_tree import nodes

_NUMBERS = ("start", "stop", "parent_no", "template_no", "depth", "text_start", "text_stop", "shadow_depth")
_KIND = pa.list_(pa.struct([("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("in_svg", pa.bool_()), *[(n, pa.int32()) for n in _NUMBERS], ("closed", pa.bool_())]))


def _nodes(html: str | None) -> list[dict]:
    return nodes(html) if html else []


@F.arrow_udf(from_arrow_type(_KIND))
def elements_of(html: pa.Array) -> pa.Array:
    return each(_nodes, _KIND, html)


@F.arrow_udf(from_arrow_type(_KIND))
def elements_in_turn(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``elements_of``, handed on in pieces: elements take several times the memory of their page."""
    return handed_on(_nodes, _KIND, ((html,) for html in batches))


# Else Spark would scan a page twice: once for its base, once for its elements.
elements_of, elements_in_turn = elements_of.asNondeterministic(), elements_in_turn.asNondeterministic()


def elements(pages: DataFrame, templates: bool = False) -> DataFrame:
    """page_id, url, base_url, element_no (from 1, in the order of the tree), tag, attrs, text, in_svg, start and stop (of the start tag, in
    characters), parent_no (0: the document), template_no, depth, text_start and text_stop (where ``text`` stands), closed (a tag that ends with />),
    shadow_depth (open shadow roots around; -1 in a template that is none).

    A row for each element of ``pages`` (page_id, url, html). Elements without a tag in the page have no start: html, head, body and
    tbody where they are left out, and what comes again after a formatting element was closed across others. What is in a template
    is no part of the document; with ``templates`` it comes too, and template_no says in which. text is that of title,
    style and script. base_url: of the first usable base element, else the page's URL; every element carries it, so that
    nothing has to be joined or scanned again for it. A null or empty page has no elements.
    """
    scanned = pages.select("page_id", "url", elements_in_turn("html").alias("found"))
    based = F.filter("found", lambda e: (e["tag"] == "base") & (e["template_no"] == 0) & e["attrs"]["href"].isNotNull())
    scanned = with_url(scanned.withColumn("href", F.get(based, F.lit(0))["attrs"]["href"]), "href", "b", "url").withColumn("base_url", F.coalesce("b.href", "url"))
    rows = scanned.select("page_id", "url", "base_url", F.posexplode("found").alias("at", "e")).select("page_id", "url", "base_url", (F.col("at") + 1).alias("element_no"), "e.*")
    return rows if templates else rows.filter("template_no = 0")


def metadata(found: DataFrame) -> DataFrame:
    """page_id, title (white space collapsed; empty without one) and base_url of every page with an element."""
    title = F.when((F.col("tag") == "title") & ~F.col("in_svg"), F.struct("element_no", "text"))
    once = found.groupBy("page_id").agg(F.first("base_url").alias("base_url"), F.min(title).alias("title"))
    clean = F.trim(F.regexp_replace(F.coalesce(F.col("title.text"), F.lit("")), r"[ \t\n\f\r]+", " "))
    return once.select("page_id", clean.alias("title"), "base_url")


def attribute(name: str) -> Column:
    return F.col("attrs")[name]
