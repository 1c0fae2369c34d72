"""What an archive changed and what it lacks, as rows, and as a report to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftarc.functions.text import byte_label, escaped_html, escaped_markdown

# Kinds of changes in the order in which a document's report lists them.
CHANGE_KINDS = (
    "base-removal", "html-reference-rewrite", "srcset-reference-rewrite", "css-source-rewrite", "uncaptured-resource-neutralization", "service-worker-call-rewrite",
    "offline-script-disable", "speculative-link-removal", "service-worker-guard-insertion", "csp-policy-adjustment",
)
RETAINED = ("data", "blob", "unsupported", "fragment", "invalid", "css-parse-error")
REPORT_HEAD = (
    '<!doctype html><html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="default-src \'none\'"><title>Archive report</title></head>'
    "<body><h1>Archive report</h1><table><tr><th>manifest</th><th>n</th><th>bytes</th></tr>"
)


def sequenced(changes: DataFrame) -> DataFrame:
    """``changes`` (job_id, document_path, kind, element_no, part) with sequence, dense from 1 in each archive: by document, kind, place."""
    rank = F.array_position(F.array(*map(F.lit, CHANGE_KINDS)), F.col("kind"))
    return changes.withColumn("sequence", F.row_number().over(Window.partitionBy("job_id").orderBy("document_path", rank, "element_no", "part")))


def change_counts(changes: DataFrame) -> DataFrame:
    """job_id, files_changed, total and a count for each kind, zeros included."""
    counts = [F.count_if(F.col("kind") == k).alias("n_" + k.replace("-", "_")) for k in CHANGE_KINDS]
    return changes.groupBy("job_id").agg(F.countDistinct("document_path").alias("files_changed"), F.count(F.lit(1)).alias("total"), *counts)


def sheet_changes(texts: DataFrame, rewritten: DataFrame, neutralised: bool = False) -> DataFrame:
    """job_id, text_id, document_path, total, kind, reason, before, after, limitations of style sheets: the one change of each, if there is one.

    ``texts``: as given to ``rewrite.rewrite_css``; ``rewritten``: what it gave, ``neutralised`` if it took references away. Sheets without a change
    have nulls and no limitations.
    """
    both = texts.select("job_id", "text_id", F.col("source_path").alias("document_path"), F.col("text").alias("given")).join(rewritten, ["job_id", "text_id"])
    changed = ~F.col("given").eqNullSafe(F.col("text"))
    away = F.lit(neutralised) & (F.col("n_unmapped") > 0)
    said = lambda c: F.when(changed, c)
    return both.select(
        "job_id", "text_id", "document_path", changed.cast("int").alias("total"), said(F.when(away, "uncaptured-resource-neutralization").otherwise("css-source-rewrite")).alias("kind"),
        said(F.when(away, "prevent-offline-network-request").otherwise("point-to-saved-resource")).alias("reason"), said(F.col("given")).alias("before"), said(F.col("text")).alias("after"),
        F.when(changed, F.array(F.lit("css-ast-regeneration-reported-at-source-level"))).otherwise(F.array().cast("array<string>")).alias("limitations"),
    )


def retained_counts(references: DataFrame) -> DataFrame:
    """job_id and a count for each of RETAINED of references (job_id, status, scheme) that stay as they are."""
    status, scheme = F.col("status"), F.col("scheme")
    kind = F.when(scheme.isin("data", "blob"), scheme).when(status.isin(*RETAINED), status)
    rows = references.withColumn("kind", kind)
    return rows.groupBy("job_id").agg(*[F.count_if(F.col("kind") == k).alias("n_" + k.replace("-", "_")) for k in RETAINED])


def _listed(totals: DataFrame, failed: DataFrame, row: Column, line: Column) -> DataFrame:
    """job_id, rows, lines (in the order of rank) and n_omitted of every job in ``totals``."""
    head = totals.groupBy("job_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    tail = failed.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"), F.max("n_omitted").alias("n_omitted"))
    lines = F.coalesce(F.transform("lines", lambda x: x["line"]), F.array().cast("array<string>"))
    return head.join(tail, "job_id", "left").select("job_id", "rows", lines.alias("lines"), F.coalesce("n_omitted", F.lit(0)).alias("n_omitted"))


def readable(totals: DataFrame, failed: DataFrame) -> DataFrame:
    """job_id, report: Markdown of totals (job_id, manifest, n, bytes) and failures (job_id, rank, url, type, n_omitted)."""
    row = F.concat(F.lit("| "), F.col("manifest"), F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), byte_label(F.col("bytes")), F.lit(" |"))
    line = F.concat(F.lit("- "), escaped_markdown(F.col("url")), F.lit(" ("), F.col("type"), F.lit(")"))
    body = F.concat(
        F.lit("| manifest | n | bytes |\n|---|---|---|\n"), F.array_join("rows", "\n"),
        F.when(F.size("lines") > 0, F.concat(F.lit("\n\n"), F.array_join("lines", "\n"))).otherwise(""),
        F.when(F.col("n_omitted") > 0, F.concat(F.lit("\n- and "), F.col("n_omitted").cast("string"), F.lit(" more"))).otherwise(""), F.lit("\n"),
    )
    return _listed(totals, failed, row, line).select("job_id", body.alias("report"))


def readable_html(totals: DataFrame, failed: DataFrame) -> DataFrame:
    """job_id, report: the same as a page that loads and runs nothing; null URLs and types are left empty."""
    shown = lambda k: escaped_html(F.coalesce(F.col(k).cast("string"), F.lit("")))
    row = F.concat(F.lit("<tr><td>"), shown("manifest"), F.lit("</td><td>"), shown("n"), F.lit("</td><td>"), byte_label(F.col("bytes")), F.lit("</td></tr>"))
    line = F.concat(F.lit("<li><code>"), shown("url"), F.lit("</code> ("), shown("type"), F.lit(")</li>"))
    more = F.when(F.col("n_omitted") > 0, F.concat(F.lit("<p>and "), F.col("n_omitted").cast("string"), F.lit(" more</p>"))).otherwise("")
    body = F.concat(
        F.lit(REPORT_HEAD), F.array_join("rows", ""), F.lit("</table><h2>Failures ("), (F.size("lines") + F.col("n_omitted")).cast("string"), F.lit(")</h2>"),
        F.when(F.size("lines") > 0, F.concat(F.lit("<ul>"), F.array_join("lines", ""), F.lit("</ul>"))).otherwise("<p>none</p>"), more, F.lit("</body></html>"),
    )
    return _listed(totals, failed, row, line).select("job_id", body.alias("report"))
