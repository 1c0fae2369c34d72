"""Tokens of scripts: a pushdown automaton over brackets that tells regular expressions from divisions and nests templates."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Words after which a slash begins a regular expression, and those whose parentheses come before a statement.
BEFORE_VALUE = frozenset("await case delete do else extends in instanceof new of return throw typeof void yield".split())
HEADS = frozenset(("if", "while", "for", "with"))
_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n\r\u2028\u2029]*|<!--[^\n\r\u2028\u2029]*|/\*.*?\*/)|(?P<string>"(?:[^"\\\n\r]|\\(?:\r\n|.))*"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*')"""
    r"""|(?P<number>\.?[0-9][\w.]*)|(?P<name>\#?(?:[\w$\u0080-\U0010FFFF]|\\u\{?[0-9a-fA-F]+\}?)+)|(?P<mark>=>|\?\.(?![0-9])|\.\.\.|\+\+|--|[^\s"'`/\\\#]|/)""", re.S
)
_REGEX = re.compile(r"/(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[\w$]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?P<end>`|\$\{)", re.S)
_HASHBANG = re.compile(r"#![^\n\r]*")


@dataclass(slots=True)
class Token:
    """kind: name, number, string, template (a whole one without substitutions), part (of a template), regex, mark."""

    kind: str
    start: int
    stop: int
    text: str


def tokens(script: str) -> list[Token] | None:
    """The tokens of a script; None if something in it does not end or brackets do not fit."""
    out: list[Token] = []
    brackets: list[tuple[str, bool]] = []  # each with whether a value may begin right after it has closed
    at = (m := _HASHBANG.match(script)) and m.end() or 0
    value_next = True  # whether a value, not an operator, can come
    while at < len(script):
        last = out[-1] if out else None
        if script[at] == "/" and value_next and not script.startswith(("//", "/*"), at):
            m = _REGEX.match(script, at)
            if not m:
                return None
            out.append(Token("regex", at, m.end(), m[0]))
            at, value_next = m.end(), False
            continue
        resumes = script[at] == "}" and bool(brackets) and brackets[-1][0] == "`"
        if script[at] == "`" or resumes:
            m = _TEMPLATE.match(script, at + 1)
            if not m:
                return None
            if resumes:
                brackets.pop()
            ends = m["end"] == "`"
            out.append(Token("template" if ends and not resumes else "part", at, m.end(), script[at : m.end()]))
            if not ends:
                brackets.append(("`", False))
            at, value_next = m.end(), not ends
            continue
        m = _TOKEN.match(script, at)
        if not m:
            return None
        kind, start, at = m.lastgroup, at, m.end()
        if kind == "space":
            continue
        text = m[0]
        out.append(Token(kind, start, at, text))
        if kind == "name":
            value_next = text in BEFORE_VALUE and not (last and last.text in (".", "?."))
        elif kind != "mark":
            value_next = False
        elif text in "([{":
            if text == "(":
                after = last is not None and last.kind == "name" and last.text in HEADS and not (len(out) > 2 and out[-3].text in (".", "?."))
            else:
                # a brace that stands where a statement can begin, or behind a head, holds statements
                after = text == "{" and (last is None or last.text in (")", ";", "{", "}", "=>", "else", "do", "try", "finally") or (last.text == ":" and _in_case(out)) or (last.kind == "name" and last.text not in BEFORE_VALUE))
            brackets.append((text, after))
            value_next = True
        elif text in ")]}":
            if not brackets or brackets[-1][0] != {")": "(", "]": "[", "}": "{"}[text]:
                return None
            value_next = brackets.pop()[1]
        elif text in ("++", "--"):
            value_next = not (last is not None and (last.kind in ("name", "number") or last.text in (")", "]")) and not value_next)
        else:
            value_next = text not in (".", "?.")
    return out if not brackets else None


def _in_case(out: list[Token]) -> bool:
    """Whether the colon before the last token ends a case or a label."""
    for t in reversed(out[:-2]):
        if t.kind == "name" and t.text in ("case", "default"):
            return True
        if t.text in (";", "{", "}", "?", ",", "("):
            return False
    return False


_LOADERS, _MADE = ("fetch", "importScripts"), ("Worker", "SharedWorker", "URL", "Request")


def strings(script: str) -> list[tuple[str, Token]] | None:
    """(use, token) of strings and templates without substitutions. use: module, load, json (given to JSON.parse) or literal."""
    found = tokens(script)
    if found is None:
        return None
    out = []
    for k, t in enumerate(found):
        if t.kind not in ("string", "template"):
            continue
        before = [x.text if x.kind in ("name", "mark") else "" for x in reversed(found[max(0, k - 4) : k])] + [""] * 4
        first, second, third, fourth = before[:4]
        use = "literal"
        if first in ("import", "from") and second not in (".", "?.") and t.kind == "string":
            use = "module"
        elif first == "(":
            member = third in (".", "?.")
            if second == "import" and not member:
                use = "module"
            elif (second in _LOADERS and not member) or (second in _MADE and third == "new"):
                use = "load"
            elif second == "parse" and third == "." and fourth == "JSON":
                use = "json"
        out.append((use, t))
    return out
