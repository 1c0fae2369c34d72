"""References of style sheets by the syntax of CSS: tokens with escapes, then rules, preludes and declarations over a stack of blocks."""

from __future__ import annotations

import re

_ESCAPE = r"\\(?:[0-9a-fA-F]{1,6}(?:\r\n|[ \t\r\n\f])?|[^\r\n\f0-9a-fA-F])"
_START = rf"(?:[A-Za-z_\u0080-\U0010FFFF]|{_ESCAPE})"
_INNER = rf"(?:[\w\u0080-\U0010FFFF-]|{_ESCAPE})"
_NAME = rf"(?:--{_INNER}*|-?{_START}{_INNER}*)"
_TOKEN = re.compile(
    rf"""(?P<space>/\*.*?(?:\*/|\Z)|[ \t\r\n\f]+|<!--|-->)|(?P<string>"(?:[^"\\\r\n\f]|\\(?:\r\n|.)|\\\Z)*"|'(?:[^'\\\r\n\f]|\\(?:\r\n|.)|\\\Z)*')|(?P<bad>"(?:[^"\\\r\n\f]|\\(?:\r\n|.))*\\?|'(?:[^'\\\r\n\f]|\\(?:\r\n|.))*\\?)"""
    rf"""|(?P<number>[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?(?:%|{_NAME})?)|@(?P<at>{_NAME})|(?P<hash>\#{_INNER}+)|(?P<name>{_NAME})(?P<call>\()?|(?P<mark>.)""",
    re.S | re.A,
)
_URL = re.compile(rf"""[ \t\r\n\f]*(?P<url>(?:[^"'()\\\x00-\x08\x0b\x0e-\x1f\x7f \t\r\n\f]|{_ESCAPE})*)[ \t\r\n\f]*(?P<end>\)|\Z)?""", re.A)
_REST_OF_BAD_URL = re.compile(r"(?:[^)\\]|\\.|\\\Z)*\)?", re.S)
_QUOTED = re.compile(r"[ \t\r\n\f]*[\"']")
_CLOSES = {")": "(", "]": "[", "}": "{"}


def unescaped(text: str) -> str:
    """What a name, string or URL with escapes stands for."""

    def one(m: re.Match) -> str:
        if m[1] is None:
            return "" if m[2] in ("\n", "\r\n", "\f", "\r") else m[2]
        code = int(m[1], 16)
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\N{REPLACEMENT CHARACTER}"

    return re.sub(r"\\(?:([0-9a-fA-F]{1,6})(?:\r\n|[ \t\r\n\f])?|(\r\n|.))", one, text, flags=re.S) if "\\" in text else text


def tokens(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) without white space and comments. Kinds: string, bad, number, at, hash, name, call, url, and each mark as itself."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, start, at = m.lastgroup, at, m.end()
        if kind == "call" and unescaped(m["name"]).lower() == "url" and not _QUOTED.match(text, at):
            u = _URL.match(text, at)
            at = u.end() if u["end"] else _REST_OF_BAD_URL.match(text, at).end()
            out.append(("url" if u["end"] == ")" else "bad", start, at, unescaped(u["url"])))
        elif kind == "mark":
            out.append((m["mark"], start, at, ""))
        elif kind == "string":
            out.append((kind, start, at, unescaped(m[0][1:-1])))
        elif kind != "space":
            out.append((kind, start, at, unescaped(m["at"] or m["name"] or "") if kind in ("at", "name", "call") else ""))
    return out


def _url_at(found: list[tuple[str, int, int, str]], k: int) -> tuple[str, int, int] | None:
    """(URL, start, end) of the url() that begins with token ``k``; none if it does not end."""
    kind, start, stop, value = found[k]
    if kind == "url":
        return value, start, stop
    if kind == "call" and value.lower() == "url" and k + 2 < len(found) and found[k + 1][0] == "string" and found[k + 2][0] == ")":
        return found[k + 1][3], start, found[k + 2][2]
    return None


def references(text: str | None) -> list[dict]:
    """References of a style sheet or of declarations: kind (import, font-face, url), property, URL, format, start and end.

    Those of declarations at any depth, custom properties and nested rules included, and the first thing of an @import; what
    else stands in preludes is none. Blank URLs and those that do not end are left out.
    """
    found = tokens(text or "")
    out: list[dict] = []
    blocks: list[str] = []  # the nearest at-rule around each open block
    n, k = len(found), 0

    def end_of(k: int, stops: str) -> int:
        """Where the run from token ``k`` ends: at one of ``stops`` that is in no bracket, or the end of the block."""
        depth: list[str] = []
        while k < n:
            kind = found[k][0]
            if not depth and (kind in stops or (kind == "}" and blocks)):
                return k
            if kind == "call" or kind in "([{":
                depth.append("(" if kind == "call" else kind)
            elif kind in _CLOSES and depth and depth[-1] == _CLOSES[kind]:
                depth.pop()
            k += 1
        return n

    def add(kind: str, name: str | None, url: tuple[str, int, int]) -> None:
        if url[0].strip():
            out.append({"kind": kind, "property": name, "raw_url": url[0], "format": None, "start": url[1], "stop": url[2]})

    def declared(name: str, k: int, stop: int) -> None:
        face = name == "src" and bool(blocks) and blocks[-1] == "font-face"
        waits = False  # for the format of the last URL
        while k < stop:
            kind, _, _, value = found[k]
            url = _url_at(found, k)
            if url:
                add("font-face" if face else "url", name, url)
                waits = face and bool(url[0].strip())
            elif kind == "," and face:
                waits = False
            elif waits and kind == "call" and value.lower() == "format" and k + 1 < stop and found[k + 1][0] in ("string", "name"):
                form = found[k + 1]
                out[-1]["format"], waits = form[3].strip() or None, False
            k += 3 if url and kind == "call" else 1

    while k < n:
        kind, _, _, value = found[k]
        if kind == "}":
            del blocks[-1:]
            k += 1
        elif kind in (";", "{"):
            blocks += [blocks[-1] if blocks else ""] if kind == "{" else []
            k += 1
        elif kind == "at":
            stop = end_of(k + 1, ";{")
            if value.lower() == "import" and k + 1 < stop:
                first = found[k + 1]
                url = (first[3], first[1], first[2]) if first[0] == "string" else _url_at(found, k + 1)
                if url:
                    add("import", None, url)
            if stop < n and found[stop][0] == "{":
                blocks.append(value.lower())
            k = stop + (stop < n and found[stop][0] != "}")
        else:
            named = kind == "name" and k + 1 < n and found[k + 1][0] == ":"
            own = named and value.startswith("--")
            stop = end_of(k, ";" if own else ";{")
            if stop < n and found[stop][0] == "{":
                blocks.append(blocks[-1] if blocks else "")
                k = stop + 1
                continue
            if named:
                declared(value if own else value.lower(), k + 2, stop)
            k = stop + (stop < n and found[stop][0] == ";")
            if k == stop and stop < n and found[stop][0] == "}" and not blocks:
                k += 1
    return out
