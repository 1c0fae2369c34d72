"""References of texts replaced by archive paths: references join saved resources, spans are cut and filled.

A reference row says where in a text it stands; the texts themselves are only touched at the end, where all of
a text's spans are applied at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftarc.functions.batches import handed_on
from weftarc.functions.names import relative_path
from weftarc.functions.urls import with_url
from weftarc.sources.text_scans import css_references, javascript_references, srcset_candidates

NEUTRAL = "data:,"
SPANS = "array<struct<start: int, stop: int, new: string>>"


def lookup(mappings: DataFrame) -> DataFrame:
    """job_id, url, path of saved resources under their own URL and their aliases (array ``aliases``).

    A URL with two different paths is an error.
    """
    every = with_url(mappings.select("job_id", "path", F.explode(F.array_union(F.array("url"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("given")), "given", "u").filter("u is not null")
    once = every.groupBy("job_id", F.col("u.href").alias("url")).agg(F.min("path").alias("path"), F.max("path").alias("last"))
    clash = F.raise_error(F.concat(F.lit("two paths for "), F.col("url")))
    return once.select("job_id", "url", F.when(F.col("path") == F.col("last"), F.col("path")).otherwise(clash).alias("path"))


def encoded_segments(path: Column) -> Column:
    """A path with everything but letters, digits and -_.!~*'() of its segments as %XX."""
    one = lambda c: F.when(c.rlike(r"^[A-Za-z0-9\-_.!~*'()/]$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
    return F.array_join(F.transform(F.split(path, ""), one), "")


def resolved(references: DataFrame, saved: DataFrame, neutralise: bool = False) -> DataFrame:
    """``references`` (job_id, source_path, base_url, raw_url and any others) with resolved_url, status and replacement.

    Status: rewritten, unmapped, fragment, unsupported (no network URL) or invalid. The replacement is the way
    from the source's folder with the reference's fragment; with ``neutralise`` unmapped ones get an empty data URL.
    """
    raw = F.trim(F.coalesce("raw_url", F.lit("")))
    known = with_url(references.withColumn("__raw", raw), "__raw", "__u", "base_url").withColumn("resolved_url", F.col("__u.href"))
    found = known.join(saved.select("job_id", F.col("url").alias("resolved_url"), F.col("path").alias("__path")), ["job_id", "resolved_url"], "left")
    network = F.col("__u.scheme").isin("http", "https")
    status = (
        F.when(raw.startswith("#"), "fragment").when((raw == "") | F.col("__u.scheme").isNull(), "invalid").when(~network, "unsupported")
        .when(F.col("__path").isNotNull(), "rewritten").otherwise("unmapped")
    )
    local = F.concat(encoded_segments(relative_path(F.col("source_path"), F.col("__path"))), F.col("__u.fragment"))
    neutral = F.when(status.isin("unmapped", "unsupported") & ~raw.startswith("data:"), NEUTRAL) if neutralise else F.lit(None).cast("string")
    return found.withColumn("status", status).withColumn("replacement", F.when(status == "rewritten", local).otherwise(neutral)).drop("__raw", "__u", "__path")


def outermost(spans: Column) -> Column:
    """Of sorted spans those that do not begin inside an earlier one; of two that begin together the longer, which comes last, stays."""
    none = F.filter(spans, lambda s: F.lit(False))

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        inside = (F.size(kept) > 0) & (s["start"] < last["stop"])
        wider = (F.size(kept) > 0) & (s["start"] == last["start"]) & (s["stop"] > last["stop"]) & (last["stop"] > last["start"])
        return F.when(wider, F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), s)).when(inside, kept).otherwise(F.array_append(kept, s))

    return F.aggregate(spans, none, step)


def applied(text: Column, spans: Column) -> Column:
    """``text`` with each of the sorted, separate spans replaced by its new text."""
    before = F.transform(
        spans,
        lambda s, k: F.concat(F.substring(text, F.when(k > 0, F.get(spans, k - 1)["stop"]).otherwise(0) + 1, s["start"] - F.when(k > 0, F.get(spans, k - 1)["stop"]).otherwise(0)), s["new"]),
    )
    last = F.element_at(spans, -1)["stop"]
    return F.when(F.size(spans) > 0, F.concat(F.array_join(before, ""), F.substring(text, last + 1, F.length(text)))).otherwise(text)


def merged_text(text: str | None, spans: list[dict] | None) -> str | None:
    """``text`` with the outermost of ``spans``, in any order, replaced by their new texts; goes through the text once."""
    if text is None or not spans:
        return text
    kept: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["stop"], s["new"])):
        last = kept[-1] if kept else None
        if last and s["start"] == last["start"] and s["stop"] > last["stop"] > last["start"]:
            kept[-1] = s
        elif not last or s["start"] >= last["stop"]:
            kept.append(s)
    parts, at = [], 0
    for s in kept:
        parts += (text[at : s["start"]], s["new"])
        at = s["stop"]
    return "".join(parts) + text[at:]


@F.arrow_udf(T.StringType())
def spliced(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """``applied`` of ``outermost`` (text, spans), for texts of many spans: columns would go through a text, and merge its spans, once for each span."""
    return handed_on(merged_text, pa.string(), batches)


def _spans() -> Column:
    row = F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.col("new"))
    return F.array_sort(F.collect_list(F.when(F.col("new").isNotNull(), row))).alias("spans")


def _rewritten(texts: DataFrame, references: DataFrame, saved: DataFrame, new: Column, neutralise: bool) -> DataFrame:
    done = resolved(references, saved, neutralise).withColumn("new", F.when(F.col("replacement").isNotNull(), new))
    per_text = done.groupBy("job_id", "text_id").agg(_spans(), F.count_if(F.col("status") == "rewritten").alias("n_rewritten"), F.count_if(F.col("status") == "unmapped").alias("n_unmapped"))
    joined = texts.join(per_text, ["job_id", "text_id"], "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
    return joined.select("job_id", "text_id", spliced("text", "spans").alias("text"), F.coalesce("n_rewritten", F.lit(0)).alias("n_rewritten"), F.coalesce("n_unmapped", F.lit(0)).alias("n_unmapped"))


TEXT = ("job_id", "text_id", "source_path", "base_url")


def rewrite_css(texts: DataFrame, saved: DataFrame, neutralise: bool = False) -> DataFrame:
    """job_id, text_id, text, n_rewritten, n_unmapped of style sheets (job_id, text_id, source_path, base_url, text)."""
    refs = texts.select(*TEXT, F.explode(css_references("text")).alias("r")).select(*TEXT, "r.*")
    return _rewritten(texts, refs, saved, F.concat(F.lit('url("'), F.col("replacement"), F.lit('")')), neutralise)


def good_descriptor(d: Column) -> Column:
    return d.isNull() | d.rlike(r"^0*[1-9][0-9]*w$") | d.rlike(r"^(?=.*[1-9])[0-9]*\.?[0-9]+x$")


def rewrite_srcset(texts: DataFrame, saved: DataFrame, neutralise: bool = False) -> DataFrame:
    """The same of srcset values; layout and descriptors stay. Candidates with a bad descriptor are not touched."""
    refs = texts.select(*TEXT, F.explode(srcset_candidates("text")).alias("r")).select(*TEXT, "r.*")
    return _rewritten(texts, refs.filter(good_descriptor(F.col("descriptor"))), saved, F.col("replacement"), neutralise)


def dotted(way: Column) -> Column:
    """A relative way as scripts have it; a quote in it is written as %27, as it may stand between such."""
    way = F.replace(way, F.lit("'"), F.lit("%27"))
    return F.when(way.rlike(r"^\.\.?/"), way).otherwise(F.concat(F.lit("./"), way))


def rewrite_javascript(texts: DataFrame, saved: DataFrame, document_path: str = "index.html") -> DataFrame:
    """The same of scripts: only references to saved resources, each as a way that begins with a dot.

    What embedded JSON refers to is taken from the page that runs the script, ``document_path``.
    """
    refs = texts.select(*TEXT, F.explode(javascript_references("text")).alias("r")).select(*TEXT, "r.*")
    refs = refs.withColumn("source_path", F.when(F.col("kind") == "json", F.lit(document_path)).otherwise(F.col("source_path")))
    return _rewritten(texts, refs, saved, dotted(F.col("replacement")), False)
