"""Service workers kept out of archived pages: direct calls to register one are replaced, a guard denies all others.

Scripts are read by their tokens, not as a syntax tree. What is called by another name, the guard denies when the page runs.

Edge cases: null and empty pages stay as they are but for the guard. A page that has a guard gets a new one in
its place. A script in which brackets do not fit, or something does not end, stays as it is (parse-error). Without a head the
guard stands before the first element that is neither html nor head.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftarc.functions.batches import each
from weftarc.operators.policy import SCRIPT_TYPES
from weftarc.operators.rewrite import SPANS, applied
from weftarc.sources.html import elements
from weftarc.sources.script_tokens import Token, tokens

MARK = "data-archive-service-workers"
DENY = "__denyServiceWorker__"
GUARD = (
    f'<script {MARK}="denied">(()=>{{'
    'const deny=()=>Promise.reject(new DOMException("No service worker is registered in an archive.","SecurityError"));'
    f'Object.defineProperty(globalThis,"{DENY}",{{value:deny}});'
    'if(typeof ServiceWorkerContainer==="function")Object.defineProperty(ServiceWorkerContainer.prototype,"register",{value:deny})'
    "})()</script>"
)
#: A replaced call.
DENIED = f"globalThis.{DENY}()"
_OLD_GUARD = rf"(?is)<script\b[^>]*\b{MARK}\b[^>]*>.*?</script\s*>"


# What only the guard stops, for external scripts, for other names of service workers, for scripts that do not parse.
LIMITS = ("external-script-runtime-guard-only", "dynamic-or-aliased-call-runtime-guard-only", "unparseable-inline-script-runtime-guard-only")


_GLOBALS = frozenset(("window", "self", "globalThis"))


def _member(found: list[Token], k: int, name: str) -> int | None:
    """The token after a member called ``name`` that begins with token ``k``: .name, ?.name, ["name"] or ?.["name"]."""
    text = [t.text for t in found[k : k + 4]] + [""] * 4
    if text[0] in (".", "?.") and text[1] == name:
        return k + 2
    at = 1 if text[0] == "?." else 0
    if text[at] == "[" and text[at + 1] in (f'"{name}"', f"'{name}'") and text[at + 2] == "]":
        return k + at + 3
    return None


def _call_end(found: list[Token], k: int) -> int:
    """The token after the parenthesis that closes the one before token ``k``."""
    depth = 1
    while depth:
        depth += found[k].text in ("(", "[", "{") and found[k].kind == "mark"
        depth -= found[k].text in (")", "]", "}") and found[k].kind == "mark"
        k += 1
    return k


def registrations(text: str | None) -> dict:
    """Calls that register a service worker (start, stop), how often service workers are named otherwise, and whether the script's tokens do not fit."""
    found = tokens(text or "")
    if found is None:
        return {"calls": [], "others": 0, "broken": True}
    calls, others, k = [], 0, 0
    while k < len(found):
        begin, t = k, found[k]
        k += 1
        if t.kind != "name" or (begin and found[begin - 1].text in (".", "?.")):
            continue
        at = begin + 1 if t.text == "navigator" else _member(found, begin + 1, "navigator") if t.text in _GLOBALS else None
        at = at and _member(found, at, "serviceWorker")
        if not at:
            continue
        called = _member(found, at, "register")
        if called and called < len(found) and found[called].text == "?.":
            called += 1
        if called and called < len(found) and found[called].text == "(":
            k = _call_end(found, called + 1)
            calls.append({"start": t.start, "stop": found[k - 1].stop})
        else:
            others, k = others + 1, at
    return {"calls": calls, "others": others, "broken": False}


_FOUND = pa.struct([("calls", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("others", pa.int32()), ("broken", pa.bool_())])


@F.arrow_udf(T.StructType([T.StructField("calls", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))), T.StructField("others", T.IntegerType()), T.StructField("broken", T.BooleanType())]))
def registrations_of(text: pa.Array) -> pa.Array:
    return each(registrations, _FOUND, text)


def script_kind(attrs: Column) -> Column:
    kind = F.lower(F.trim(F.coalesce(attrs["type"], F.lit(""))))
    return F.when(~kind.isin(*SCRIPT_TYPES), "non-javascript").when(attrs["src"].isNotNull(), "external").when(kind == "module", "inline-module").otherwise("inline-classic")


def judged(found: DataFrame) -> DataFrame:
    """Elements with kind, status, calls (spans in the text) and n_others; nulls but for scripts.

    Status: rewritten, runtime-guard-only (external, or service workers named otherwise), no-registration, parse-error, ignored.
    """
    rows = found.withColumn("kind", F.when(F.col("tag") == "script", script_kind(F.col("attrs"))))
    rows = rows.withColumn("__r", registrations_of(F.when(F.col("kind").startswith("inline"), F.col("text"))))
    status = (
        F.when(F.col("kind") == "non-javascript", "ignored").when(F.col("kind") == "external", "runtime-guard-only").when(F.col("__r.broken"), "parse-error")
        .when(F.size("__r.calls") > 0, "rewritten").when(F.col("__r.others") > 0, "runtime-guard-only").when(F.col("kind").isNotNull(), "no-registration")
    )
    return rows.withColumn("status", status).withColumn("calls", F.col("__r.calls")).withColumn("n_others", F.col("__r.others").cast("long")).drop("__r")


def scripts(found: DataFrame) -> DataFrame:
    """page_id, element_no, kind, status, n_calls, n_others of the scripts among elements."""
    return judged(found.filter(F.col("tag") == "script")).select("page_id", "element_no", "kind", "status", F.size("calls").cast("long").alias("n_calls"), "n_others")


def guarded(pages: DataFrame) -> DataFrame:
    """page_id, html, n_rewritten, n_external, n_others, n_broken, limits of ``pages`` (page_id, url, html), each page_id once.

    The guard comes after the html and head tags that a page begins with, so it runs before every other script.
    """
    clean = pages.select("page_id", "url", F.regexp_replace(F.coalesce("html", F.lit("")), _OLD_GUARD, "").alias("html"))
    outer = F.col("tag").isin("html", "head")
    moved = F.transform("calls", lambda c: F.struct((c["start"] + F.col("stop")).alias("start"), (c["stop"] + F.col("stop")).alias("stop"), F.lit(DENIED).alias("new")))
    counts = ("n_rewritten", "n_external", "n_others", "n_broken")
    seen = judged(elements(clean)).groupBy("page_id").agg(
        F.min(F.when(~outer, F.col("start"))).alias("first"), F.collect_list(F.when(outer, F.col("stop"))).alias("heads"), F.flatten(F.collect_list(moved)).alias("spans"),
        F.sum(F.size("calls")).alias("n_rewritten"), F.count_if(F.col("kind") == "external").alias("n_external"), F.sum("n_others").alias("n_others"), F.count_if(F.col("status") == "parse-error").alias("n_broken"),
    )
    # the leading tags' ends are those that are not behind the first other element
    leading = F.array_max(F.filter("heads", lambda x: F.col("first").isNull() | (x <= F.col("first"))))
    at = F.coalesce(leading, "first", F.lit(0)).cast("int")
    guard = F.array(F.struct(at.alias("start"), at.alias("stop"), F.lit(GUARD).alias("new"))).cast(SPANS)
    spans = F.array_sort(F.concat(guard, F.coalesce("spans", F.array().cast(SPANS))))
    limits = [F.when(F.col(k) > 0, name) for k, name in zip(counts[1:], LIMITS, strict=True)]
    return clean.join(seen, "page_id", "left").select(
        "page_id", applied(F.col("html"), spans).alias("html"), *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in counts],
        F.array_compact(F.array(*limits, F.lit("computed-aliases-not-statically-resolved"))).alias("limits"),
    )
