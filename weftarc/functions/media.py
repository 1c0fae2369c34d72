"""Media types, resource types and HTTP header values as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESOURCE_TYPES = ("document", "stylesheet", "image", "font", "script", "video", "audio", "wasm", "manifest", "model", "texture", "data", "other")

# File extensions with their resource type and media type.
EXTENSIONS = {
    "html": ("document", "text/html"), "htm": ("document", "text/html"), "xhtml": ("document", "application/xhtml+xml"),
    "css": ("stylesheet", "text/css"), "js": ("script", "text/javascript"), "mjs": ("script", "text/javascript"), "cjs": ("script", "text/javascript"),
    "json": ("data", "application/json"), "map": ("data", "application/json"), "wasm": ("wasm", "application/wasm"),
    "webmanifest": ("manifest", "application/manifest+json"), "manifest": ("manifest", "application/manifest+json"),
    "png": ("image", "image/png"), "jpg": ("image", "image/jpeg"), "jpeg": ("image", "image/jpeg"), "gif": ("image", "image/gif"),
    "webp": ("image", "image/webp"), "avif": ("image", "image/avif"), "svg": ("image", "image/svg+xml"), "ico": ("image", "image/x-icon"), "bmp": ("image", "image/bmp"),
    "woff": ("font", "font/woff"), "woff2": ("font", "font/woff2"), "ttf": ("font", "font/ttf"), "otf": ("font", "font/otf"), "eot": ("font", "application/vnd.ms-fontobject"),
    "mp4": ("video", "video/mp4"), "webm": ("video", "video/webm"), "ogv": ("video", "video/ogg"),
    "mp3": ("audio", "audio/mpeg"), "wav": ("audio", "audio/wav"), "oga": ("audio", "audio/ogg"), "vtt": ("data", "text/vtt"),
    "glb": ("model", "model/gltf-binary"), "gltf": ("model", "model/gltf+json"), "obj": ("model", None), "fbx": ("model", None),
    "ktx": ("texture", "image/ktx"), "ktx2": ("texture", "image/ktx2"), "basis": ("texture", None),
}

# How a resource may have been asked for, by the timing interface.
INITIATORS = (
    "audio", "beacon", "body", "css", "early-hint", "embed", "fetch", "frame", "iframe", "image", "img",
    "input", "link", "navigation", "object", "ping", "script", "track", "video", "xmlhttprequest", "other",
)
RETRYABLE_STATUSES = (408, 425, 429, 500, 502, 503, 504)
MAX_SAFE = (1 << 53) - 1
_TOKEN = r"[a-z0-9!#$&^_.+\-]+"


def type_of_media(mime: Column) -> Column:
    """Resource type of a media type in small letters, or null; the first rule that fits decides."""
    return (
        F.when(mime == "text/css", "stylesheet")
        .when(mime.isin("text/javascript", "application/javascript", "text/ecmascript", "application/ecmascript"), "script")
        .when(mime == "application/wasm", "wasm")
        .when(mime == "application/manifest+json", "manifest")
        .when(mime.isin("text/html", "application/xhtml+xml"), "document")
        .when(mime.isin("text/vtt", "application/json") | mime.endswith("+json"), "data")
        .when(mime.isin("image/ktx", "image/ktx2"), "texture")
        .when(mime.startswith("image/"), "image")
        .when(mime.startswith("font/") | (mime == "application/vnd.ms-fontobject"), "font")
        .when(mime.startswith("video/"), "video")
        .when(mime.startswith("audio/"), "audio")
        .when(mime.startswith("model/"), "model")
        .when(mime.startswith("text/"), "data")
    )


def extension_of(u: Column) -> Column:
    """The known extension of a parsed URL's last path segment in small letters, or null; data and blob URLs have none."""
    found = F.lower(F.regexp_extract(u["path"], r"\.([^./]+)$", 1))
    return F.when(~u["scheme"].isin("data", "blob") & found.isin(*EXTENSIONS), found)


def _of_extension(extension: Column, k: int) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for e, v in EXTENSIONS.items() if v[k] for x in (e, v[k])]), extension)


def type_of_extension(extension: Column) -> Column:
    return _of_extension(extension, 0)


def media_of_extension(extension: Column) -> Column:
    return _of_extension(extension, 1)


def initiator(value: Column) -> Column:
    """Trimmed, in small letters; anything unknown is other."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*INITIATORS), v).otherwise("other")


def media_essence(content_type: Column) -> Column:
    """type/subtype of a Content-Type value in small letters, or null if it is not one."""
    v = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return F.when(v.rlike(f"^{_TOKEN}/{_TOKEN}$"), v)


def content_length(value: Column) -> Column:
    """Digits up to 2**53 - 1 as a long, else null."""
    v = F.trim(value)
    n = F.when(v.rlike("^[0-9]{1,18}$") | v.rlike("^0*[0-9]{1,18}$"), F.regexp_extract(v, "^0*([0-9]{1,18})$", 1)).try_cast("long")
    return F.when(n <= MAX_SAFE, n)


def retry_after_ms(value: Column, now: Column) -> Column:
    """Milliseconds of whole seconds or of one of the three HTTP date forms; past dates give 0; else null. ``now``: a timestamp."""
    v = F.trim(value)
    seconds = F.when(v.rlike("^[0-9]{1,13}$"), v.cast("long") * 1000)
    week, month = "(Mon|Tue|Wed|Thu|Fri|Sat|Sun)", "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    long_week = "(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"
    clock = r"([0-9]{2}:[0-9]{2}:[0-9]{2})"
    forms = (
        (rf"^{week}, ([0-9]{{2}} {month} [0-9]{{4}} {clock}) GMT$", 2, "dd MMM yyyy HH:mm:ss"),
        (rf"^{long_week}, ([0-9]{{2}}-{month}-[0-9]{{2}} {clock}) GMT$", 2, "dd-MMM-yyyy HH:mm:ss"),
        (rf"^{week} ({month} [ 0-9][0-9] {clock} [0-9]{{4}})$", 2, "MMM d HH:mm:ss yyyy"),
    )
    dates = [F.when(v.rlike(p), F.regexp_replace(F.regexp_extract(v, p, k), " +", " ")) for p, k, _ in forms]
    # years of two digits are of 1950 to 2049
    dates[1] = F.regexp_replace(F.regexp_replace(dates[1], r"-([5-9][0-9]) ", "-19$1 "), r"-([0-4][0-9]) ", "-20$1 ")
    stamps = [F.try_to_timestamp(d, F.lit(f)) for d, (_, _, f) in zip(dates, forms, strict=True)]
    later = F.unix_millis(F.coalesce(*stamps)) - F.unix_millis(now)
    ms = F.coalesce(seconds, F.when(later.isNotNull(), F.greatest(later, F.lit(0))))
    return F.when(ms <= MAX_SAFE, ms)


def retry_delay_ms(failed_attempt: Column, retry_after: Column, base: int = 500, most: int = 30_000) -> Column:
    """min(most, max(base * 2**(n - 1), retry_after)) after the n-th failure."""
    back_off = F.lit(base).cast("double") * F.pow(F.lit(2.0), F.least(failed_attempt - 1, F.lit(52)))
    return F.least(F.lit(most).cast("double"), F.greatest(back_off, F.coalesce(retry_after, F.lit(0)).cast("double"))).cast("long")


def is_retryable(status: Column) -> Column:
    return F.coalesce(status.isin(*RETRYABLE_STATUSES), F.lit(False))
