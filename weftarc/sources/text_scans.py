"""Small scanners of srcset values, style sheets and scripts, each as a column function that gives an array."""

from __future__ import annotations

import json
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import functions as F

from weftarc.functions.batches import each
from weftarc.sources.css_tokens import references
from weftarc.sources.script_tokens import strings

_SPACE = " \t\n\f\r"


def srcset(value: str | None) -> list[dict]:
    """Candidates of a srcset: URL, descriptor (null without one), start and end of the URL in the value.

    A URL runs up to white space, so it may hold commas; commas at its end close the candidate. In a descriptor
    a comma closes it unless it stands in parentheses.
    """
    value, out, at = value or "", [], 0
    while True:
        while at < len(value) and value[at] in _SPACE + ",":
            at += 1
        if at >= len(value):
            return out
        start = at
        while at < len(value) and value[at] not in _SPACE:
            at += 1
        url = value[start:at].rstrip(",")
        if len(url) < at - start:
            out.append({"raw_url": url, "descriptor": None, "start": start, "stop": start + len(url)})
            continue
        begin, depth = at, 0
        while at < len(value) and (depth or value[at] != ","):
            depth += (value[at] == "(") - (value[at] == ")" and depth > 0)
            at += 1
        out.append({"raw_url": url, "descriptor": " ".join(value[begin:at].split()) or None, "start": start, "stop": start + len(url)})


#: A way or a web address whose path ends with an extension.
_FILE_LIKE = re.compile(r"(?:(?:https?:)?//[^/?#]+/|/(?!/)|\.{1,2}/)[^?#]*\.[a-z0-9]{1,12}(?:[?#].*)?", re.I | re.S)
_PIECE = re.compile(r"\\(?:u\{(?P<code>[0-9a-fA-F]{1,6})\}|u(?P<u>[0-9a-fA-F]{4})|x(?P<x>[0-9a-fA-F]{2})|(?P<line>\r\n|[\n\u2028\u2029])|(?P<one>.))|(?P<plain>[^\\]+)", re.S)
_CONTROLS = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
_JSON_STRING = re.compile(r'"(?:\\.|[^"\\])*"(?P<key>\s*:)?', re.S)


def _literal(raw: str) -> tuple[str, list[tuple[int, int]]]:
    """What a string literal stands for, and where each of its pieces begins there and in the script."""
    out, places, at = [], [], 0
    for m in _PIECE.finditer(raw):
        code = m["code"] or m["u"] or m["x"]
        piece = m["plain"] or ("" if m["line"] else chr(min(int(code, 16), 0x10FFFF)) if code else _CONTROLS.get(m["one"], m["one"]))
        places.append((at, m.start()))
        out.append(piece)
        at += len(piece)
    return "".join(out), places


def _whole(text: str) -> str:
    """Halves of a character as the character; a lone half becomes U+FFFD."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _json_strings(raw: str, start: int) -> list[dict]:
    """Values in JSON in a string literal that look like files, with their places; none if it is no JSON."""
    text, places = _literal(raw)
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return []
    firsts = [p[0] for p in places]

    def place(at: int) -> int:
        begins, there = places[bisect_right(firsts, at) - 1]
        return start + there + at - begins

    out = []
    for m in _JSON_STRING.finditer(text):
        value = "" if m["key"] else _whole(json.loads(m[0], strict=False))
        if _FILE_LIKE.fullmatch(value):
            out.append({"kind": "json", "raw_url": value, "start": place(m.start() + 1), "stop": place(m.end() - 1)})
    return out


def javascript(text: str | None) -> list[dict]:
    """References of a script: strings in module and loading positions, other strings that look like files, and such strings in embedded JSON.

    A script in which something does not end, or brackets do not fit, has none.
    """
    out = []
    for use, token in strings(text or "") or ():
        raw, start = token.text[1:-1], token.start + 1
        if use == "json":
            out += _json_strings(raw, start)
            continue
        url = _whole(_literal(raw)[0])
        if raw and (use != "literal" or _FILE_LIKE.fullmatch(url)):
            out.append({"kind": use, "raw_url": url, "start": start, "stop": token.stop - 1})
    return out


def _column(scan, fields: dict[str, str]):
    types = {"string": pa.string(), "int": pa.int32()}
    kind = pa.list_(pa.struct([(k, types[t]) for k, t in fields.items()]))

    @F.arrow_udf(f"array<struct<{', '.join(f'{k}: {t}' for k, t in fields.items())}>>")
    def scanned(text: pa.Array) -> pa.Array:
        return each(scan, kind, text)

    return scanned


def srcset_candidates(value):
    return _column(srcset, {"raw_url": "string", "descriptor": "string", "start": "int", "stop": "int"})(value)


def css_references(text):
    return _column(references, {"kind": "string", "property": "string", "raw_url": "string", "format": "string", "start": "int", "stop": "int"})(text)


def javascript_references(text):
    return _column(javascript, {"kind": "string", "raw_url": "string", "start": "int", "stop": "int"})(text)
