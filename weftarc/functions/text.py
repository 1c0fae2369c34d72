"""Small text rules of reports and checks as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftarc.functions.names import portable_name

# What a message speaks of, by the first words that it holds, with the name of its category.
PACKAGE_FAULTS = (
    ("mime", "MimeType"), ("redirect", "RedirectTrace"), ("path mapping", "PathMapping"), ("local path", "LocalPath"), ("archive path", "ArchivePath"),
    ("byte length", "ByteLength"), ("sha-256", "IntegrityHash"), ("integrity", "Integrity"), ("manifest", "Manifest"), ("zip", "Zip"),
)

# Error codes and whether what failed may be tried again.
ERRORS = {
    "protocol-invalid-message": True, "page-unavailable": False, "page-capture-timeout": True, "page-navigation-changed": True, "tab-closed": False,
    "content-script-injection-failed": False, "content-script-unresponsive": True, "job-not-found": False, "invalid-job-transition": False, "invalid-job-counter": False,
    "storage-conflict": True, "storage-unavailable": True, "permission-denied": True, "network-request-failed": True, "resource-limit-exceeded": False,
    "archive-integrity-failed": True, "archive-download-failed": True, "capture-cancelled": False, "unexpected-error": True,
}


def escaped_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def escaped_markdown(text: Column) -> Column:
    """One line for a cell of a table."""
    return F.regexp_replace(F.regexp_replace(text, r"([\\|`*_\[\]<>])", r"\\$1"), r"[\r\n]+", " ")


def byte_label(n: Column) -> Column:
    """1023 B, 1.5 KiB, 2.0 MiB."""
    one = lambda size, unit: F.concat(F.format_string("%.1f", n.cast("double") / size), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, one(1024.0, "KiB")).otherwise(one(float(1 << 20), "MiB"))


def is_descriptor(descriptor: Column) -> Column:
    """Whether a srcset descriptor is none, a positive width or a positive density."""
    return descriptor.isNull() | descriptor.rlike(r"^0*[1-9][0-9]*w$") | descriptor.rlike(r"^(?=.*[1-9])[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?x$")


def doctype(name: Column, public_id: Column, system_id: Column) -> Column:
    """<!DOCTYPE ...> with its identifiers, quoted by what they do not hold."""
    quoted = lambda v: F.when(F.contains(v, F.lit('"')), F.concat(F.lit("'"), v, F.lit("'"))).otherwise(F.concat(F.lit('"'), v, F.lit('"')))
    blank = lambda v: F.coalesce(v, F.lit("")) == ""
    ids = F.when(~blank(public_id), F.concat(F.lit(" PUBLIC "), quoted(public_id), F.when(~blank(system_id), F.concat(F.lit(" "), quoted(system_id))).otherwise(""))).when(~blank(system_id), F.concat(F.lit(" SYSTEM "), quoted(system_id))).otherwise("")
    return F.concat(F.lit("<!DOCTYPE "), name, ids, F.lit(">"))


def package_fault(name: Column, message: Column) -> Column:
    """Name.Category of an error, without its words."""
    low = F.lower(F.coalesce(message, F.lit("")))
    category = F.lit("Unknown")
    for words, kind in reversed(PACKAGE_FAULTS):
        category = F.when(F.contains(low, F.lit(words)), kind).otherwise(category)
    return F.concat(F.when(name.isin("TypeError", "RangeError", "Error"), name).otherwise("Error"), F.lit("."), category)


def is_retryable_error(code: Column) -> Column:
    """By the catalogue; an unknown code is an unexpected error."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ERRORS.items() for x in kv]), code), F.lit(ERRORS["unexpected-error"]))


def archive_file_name(wanted: Column, prefix: str, host: Column, at: Column) -> Column:
    """A portable name that ends in .zip; without a wanted one prefix-host-YYYYMMDD.zip, the host without www."""
    usual = F.concat(F.lit(f"{prefix}-"), F.regexp_replace(host, r"^www\.", ""), F.lit("-"), F.date_format(at, "yyyyMMdd"))
    stem = F.regexp_replace(F.when(F.coalesce(F.trim(wanted), F.lit("")) == "", usual).otherwise(wanted), r"(?i)\.zip$", "")
    return F.concat(portable_name(stem, "archive"), F.lit(".zip"))


def transfer_bytes(text: Column) -> Column:
    """Bytes of Base64 in its one canonical form; null for any other text."""
    data = F.try_to_binary(text, F.lit("base64"))
    return F.when(F.replace(F.base64(data), F.lit("\r\n"), F.lit("")) == text, data)
