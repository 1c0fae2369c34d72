"""Content security policies of pages: what an offline copy needs is put into them, with a report of every change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftarc.sources.html import attribute

# The two kinds of policies in meta elements, and directives that mean nothing there.
POLICY_HEADERS = ("content-security-policy", "content-security-policy-report-only")
NOT_IN_META = ("frame-ancestors", "report-uri", "sandbox")
# Resource types in their order, the directives that rule each (the first that is there counts), and what a change is for.
NEEDS = {
    "document": (("frame-src", "child-src", "default-src"), "allow-local-document"),
    "stylesheet": (("style-src-elem", "style-src", "default-src"), "allow-local-stylesheet"),
    "image": (("img-src", "default-src"), "allow-local-image"),
    "font": (("font-src", "default-src"), "allow-local-font"),
    "script": (("script-src-elem", "script-src", "default-src"), "allow-local-script"),
    "video": (("media-src", "default-src"), "allow-local-media"),
    "audio": (("media-src", "default-src"), "allow-local-media"),
    "wasm": (("connect-src", "default-src"), "allow-local-wasm"),
    "manifest": (("manifest-src", "default-src"), "allow-local-manifest"),
    "model": (("connect-src", "default-src"), "allow-local-model"),
    "texture": (("img-src", "default-src"), "allow-local-image"),
    "data": (("connect-src", "default-src"), "allow-local-data"),
    "other": (("connect-src", "default-src"), "allow-local-other"),
}
GUARD_REASON = "allow-service-worker-guard"
# Elements that do not end a page's head.
HEAD = ("html", "head", "title", "base", "basefont", "bgsound", "link", "meta", "style", "script", "noscript", "noframes", "template")


def meta_policies(found: DataFrame) -> DataFrame:
    """page_id, element_no, http_equiv, policy, in_head of the policies among ``found`` elements; the head ends where the first other element begins."""
    name = F.lower(F.trim(F.coalesce(attribute("http-equiv"), F.lit(""))))
    metas = found.filter((F.col("tag") == "meta") & name.isin(*POLICY_HEADERS)).select("page_id", "element_no", name.alias("http_equiv"), F.coalesce(attribute("content"), F.lit("")).alias("policy"))
    body = found.filter(~F.col("tag").isin(*HEAD)).groupBy("page_id").agg(F.min("element_no").alias("__body"))
    return metas.join(body, "page_id", "left").select(*metas.columns, (F.col("__body").isNull() | (F.col("element_no") < F.col("__body"))).alias("in_head"))


def _needs(guard: str | None) -> Column:
    """What the row's ``types`` ask of its directives ``__names``: struct<at, source, reason>, the guard's hash first."""

    def need(chain: tuple[str, ...], source: str, reason: str) -> Column:
        at = F.coalesce(*[F.nullif(F.array_position("__names", F.lit(n)), F.lit(0).cast("long")) for n in chain])
        return F.struct(at.alias("at"), F.lit(source).alias("source"), F.lit(reason).alias("reason"))

    asked = [F.when(F.array_contains("types", t), need(chain, "'self'", reason)) for t, (chain, reason) in NEEDS.items()]
    if guard is not None:
        asked.insert(0, need(NEEDS["script"][0], guard, GUARD_REASON))
    return F.filter(F.array(*asked), lambda n: n.isNotNull() & n["at"].isNotNull())


def _changed(d: Column, k: Column) -> Column:
    """Directive ``d`` at place ``k`` with what it needs: name, new sources, and what was added, removed and why."""
    own = F.filter("__needs", lambda n: n["at"] == k + 1)
    given = F.transform(d["sources"], lambda s: F.lower(s))
    missing = F.filter(own, lambda n: ~F.array_contains(given, F.lower(n["source"])))
    added = F.array_distinct(F.transform(missing, lambda n: n["source"]))
    none = F.filter(d["sources"], lambda s: F.lower(s) == "'none'")
    # a need is a reason where it is the first to add its source, or the first of all and takes 'none' away
    firsts = F.transform(added, lambda a: F.get(F.filter(missing, lambda n: n["source"] == a), F.lit(0))["reason"])
    first = F.when(F.size(none) > 0, F.slice(F.transform(own, lambda n: n["reason"]), F.lit(1), F.lit(1))).otherwise(F.array().cast("array<string>"))
    touched = (F.size(own) > 0) & ((F.size(added) > 0) | (F.size(none) > 0))
    sources = F.when(touched, F.concat(F.filter(d["sources"], lambda s: F.lower(s) != "'none'"), added)).otherwise(d["sources"])
    return F.struct(d["name"].alias("directive"), sources.alias("sources"), added.alias("added"), F.slice(none, F.lit(1), F.lit(1)).alias("removed"), F.array_distinct(F.concat(first, firsts)).alias("reasons"), touched.alias("touched"))


def adjusted(policies: DataFrame, guard: str | None = None) -> DataFrame:
    """``policies`` (of ``meta_policies``, with an array ``types`` of the resource types that are needed) and what becomes of them.

    Adds status (adjusted, unchanged, empty-policy, outside-head, report-only-unsupported), adjusted_policy, changes (directive,
    added, removed, reasons), has_repeated and has_unsupported directives. Of directives that are given twice the first counts.
    ``guard`` is the hash source of a script that must run. A null policy is an empty one, null types are none.
    """
    words = F.transform(F.split(F.coalesce("policy", F.lit("")), ";"), lambda d: F.filter(F.split(d, r"\s+"), lambda w: w != ""))
    parsed = F.transform(F.filter(words, lambda w: F.size(w) > 0), lambda w: F.struct(F.lower(w[0]).alias("name"), F.slice(w, F.lit(2), F.size(w)).alias("sources")))
    status = F.when(F.col("http_equiv") == POLICY_HEADERS[1], "report-only-unsupported").when(~F.col("in_head"), "outside-head").when(F.trim(F.coalesce("policy", F.lit(""))) == "", "empty-policy")
    rows = policies.withColumn("__parsed", parsed).withColumn("__names", F.transform("__parsed", lambda d: d["name"])).withColumn("__needs", _needs(guard)).withColumn("__status", status)
    rows = rows.withColumn("__all", F.transform("__parsed", _changed)).withColumn("__touched", F.filter("__all", lambda c: c["touched"]))
    rows = rows.withColumn("status", F.coalesce("__status", F.when(F.size("__touched") > 0, "adjusted").otherwise("unchanged")))
    text = F.array_join(F.transform("__all", lambda c: F.array_join(F.concat(F.array(c["directive"]), c["sources"]), " ")), "; ")
    changes = F.transform("__touched", lambda c: F.struct(c["directive"], c["added"], c["removed"], c["reasons"]))
    judged = F.col("__status").isNull()
    return rows.select(
        *policies.columns, "status", F.when(F.col("status") == "adjusted", text).otherwise(F.coalesce("policy", F.lit(""))).alias("adjusted_policy"),
        F.when(judged, changes).otherwise(F.slice(changes, F.lit(1), F.lit(0))).alias("changes"),
        (judged & (F.size(F.array_distinct("__names")) < F.size("__names"))).alias("has_repeated"), (judged & F.arrays_overlap("__names", F.array(*map(F.lit, NOT_IN_META)))).alias("has_unsupported"),
    )


def page_reports(judged: DataFrame) -> DataFrame:
    """page_id, policies_found, policies_adjusted, limitations of every page with a policy."""
    # What the report says that it cannot do.
    always = ("http-header-policies-not-available-in-html-snapshot", "meta-policy-applies-only-after-its-document-position")
    sometimes = {
        "report-only-meta-is-not-supported-by-browsers": F.bool_or(F.col("status") == "report-only-unsupported"), "outside-head-meta-is-not-enforced": F.bool_or(F.col("status") == "outside-head"),
        "duplicate-directives-preserved-first-wins": F.bool_or("has_repeated"), "meta-unsupported-directives-preserved": F.bool_or("has_unsupported"),
    }
    listed = F.array(*map(F.lit, always), *[F.when(holds, text) for text, holds in sometimes.items()])
    return judged.groupBy("page_id").agg(F.count(F.lit(1)).alias("policies_found"), F.count_if(F.col("status") == "adjusted").alias("policies_adjusted"), F.array_compact(listed).alias("limitations"))
