"""Portable file names, directories and hashes of archived resources as columns."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES, MAX_EXTENSION_BYTES = 240, 32

# The directory of each resource type, and the name of a resource without one.
TYPE_DIRECTORIES = {
    "document": "documents", "stylesheet": "css", "image": "images", "font": "fonts", "script": "js", "video": "media", "audio": "media",
    "wasm": "wasm", "manifest": "manifests", "model": "models", "texture": "textures", "data": "data", "other": "other",
}
FALLBACK_NAMES = {
    "document": "index.html", "stylesheet": "style.css", "image": "image", "font": "font", "script": "script.js", "video": "video", "audio": "audio",
    "wasm": "module.wasm", "manifest": "manifest.webmanifest", "model": "model", "texture": "texture", "data": "data", "other": "resource",
}
#: Names that Windows keeps for devices, with any extension.
DEVICES = r"(con|prn|aux|nul|clock\$|conin\$|conout\$|com[1-9¹²³]|lpt[1-9¹²³])"
_FORBIDDEN = r"[\x00-\x1f\x7f-\x9f<>:\"/\\|?*]+"


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Unicode normal form C; the one step that Spark has no function for."""
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def percent_decoded(segment: pa.Array) -> pa.Array:
    """UTF-8 of %XX sequences; the segment itself where they are malformed. A plus is a plus."""
    return pa.array([None if s is None else _decoded(s) for s in segment.to_pylist()], pa.string())


def _decoded(segment: str) -> str:
    if re.search("%(?![0-9a-fA-F]{2})", segment):
        return segment
    try:
        return re.sub(rb"%([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), segment.encode()).decode()
    except UnicodeDecodeError:
        return segment


def _fitting(text: Column, most: int | Column) -> Column:
    """The longest beginning of whole characters with at most ``most`` bytes of UTF-8."""
    most = F.lit(most) if isinstance(most, int) else most
    sizes = F.aggregate(
        F.split(text, ""),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(True).alias("open")),
        lambda a, c: F.when(a["open"] & (a["n"] + F.octet_length(c) <= most), F.struct((a["n"] + F.octet_length(c)).alias("n"), (a["chars"] + F.length(c)).alias("chars"), F.lit(True).alias("open"))).otherwise(
            F.struct(a["n"].alias("n"), a["chars"].alias("chars"), F.lit(False).alias("open"))
        ),
    )
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(text, F.lit(1), sizes["chars"]))


def _trimmed_end(text: Column) -> Column:
    return F.regexp_replace(text, "[ .]+$", "")


def _extension(name: Column) -> Column:
    """From the last dot on, if that is not the first character and it is short enough; else empty."""
    ext = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    return F.when(F.octet_length(ext) <= MAX_EXTENSION_BYTES, ext).otherwise("")


def portable_name(value: Column, fallback: str | Column = "resource") -> Column:
    """A file name that every common system takes, of a value in normal form C.

    Runs of forbidden characters become one underscore, leading spaces and trailing spaces and dots go, device
    names get an underscore in front; at most MAX_BYTES bytes stay, with a short extension kept.
    """
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    clean = F.regexp_replace(F.regexp_replace(value, _FORBIDDEN, "_"), "^ +|[ .]+$", "")
    safe = F.when(_trimmed_end(F.split_part(clean, F.lit("."), F.lit(1))).rlike(f"(?i)^{DEVICES}$"), F.concat(F.lit("_"), clean)).otherwise(clean)
    name = F.when(F.coalesce(safe, F.lit("")) == "", fallback).otherwise(safe)
    ext = _extension(name)
    stem = _trimmed_end(_fitting(F.substring(name, F.lit(1), F.length(name) - F.length(ext)), F.lit(MAX_BYTES) - F.octet_length(ext)))
    cut = F.when((ext != "") & (stem != ""), F.concat(stem, ext)).otherwise(_trimmed_end(_fitting(name, MAX_BYTES)))
    return F.when(F.octet_length(name) <= MAX_BYTES, name).otherwise(F.when(cut == "", fallback).otherwise(cut))


def with_suffix(name: Column, suffix: Column) -> Column:
    """stem--suffix.ext within the byte limit, of a portable name."""
    mark = F.concat(F.lit("--"), suffix)
    ext = _extension(name)
    stem = _trimmed_end(_fitting(F.substring(name, F.lit(1), F.length(name) - F.length(ext)), F.lit(MAX_BYTES) - F.octet_length(mark) - F.octet_length(ext)))
    return F.concat(F.when(stem == "", "resource").otherwise(stem), mark, ext)


def _by_type(table: dict[str, str], kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), kind)


def with_leaf_name(df: DataFrame, u: str, kind: str, out: str) -> DataFrame:
    """Adds ``out``, the file name of a parsed network URL: its last path segment decoded, or the type's usual name."""
    decoded = df.withColumn("__leaf", nfc(percent_decoded(F.regexp_extract(f"{u}.path", "([^/]*)$", 1))))
    return decoded.withColumn(out, portable_name(F.col("__leaf"), _by_type(FALLBACK_NAMES, F.col(kind)))).drop("__leaf")


def directory(u: Column, kind: Column) -> Column:
    """assets/origins/scheme/host/port/type of a parsed network URL."""
    host = (
        F.when(u["host"].startswith("["), F.concat(F.lit("ipv6-"), F.translate(u["host"], ":[]", "-")))
        .when(u["host"].rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), F.concat(F.lit("ipv4-"), u["host"]))
        .otherwise(F.concat(F.lit("dns-"), u["host"]))
    )
    port = F.when(u["port"] == "", "default").otherwise(F.concat(F.lit("port-"), u["port"]))
    return F.concat_ws("/", F.lit("assets/origins"), u["scheme"], host, port, _by_type(TYPE_DIRECTORIES, kind))


def query_hash(u: Column) -> Column:
    """12 hex digits of the query's SHA-256; null without a query."""
    return F.when(F.length(u["query"]) > 1, F.substring(F.sha2(F.substring(u["query"], F.lit(2), F.length(u["query"])), 256), 1, 12))


def is_archive_path(path: Column) -> Column:
    """Relative, with no backslash, and no empty, . or .. segment."""
    parts = F.split(path, "/", -1)
    return F.coalesce((path != "") & ~F.contains(path, F.lit("\\")) & F.forall(parts, lambda p: ~p.isin("", ".", "..")), F.lit(False))


def relative_path(source: Column, target: Column) -> Column:
    """The way from the folder of one archive path to another path, with .. where needed."""
    a, b = F.split(F.regexp_replace(source, "[^/]*$", ""), "/"), F.split(target, "/")
    folders = F.slice(a, F.lit(1), F.size(a) - 1)
    n = F.least(F.size(folders), F.size(b) - 1)
    same = F.size(F.filter(F.transform(F.sequence(F.lit(0), n), lambda k: (k > 0) & (F.slice(folders, F.lit(1), k) == F.slice(b, F.lit(1), k))), lambda x: x))
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(folders) - same), F.slice(b, same + 1, F.size(b))), "/")


