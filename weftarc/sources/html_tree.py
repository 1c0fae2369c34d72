"""The tree of one page: tokens by the states of the HTML syntax, put in place by a stack of open elements and insertion modes.

A helper for tasks that go through pages; it knows nothing of Spark. It reads as a browser with scripting does: what is in noscript, iframe,
noembed, noframes and xmp is text, in textarea and title text with references. Comments and texts are not kept, but for
the text right inside title, style, script and textarea. What is in a template belongs to a tree of its own.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from html.entities import html5

# Kinds of elements in the syntax of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("style xmp iframe noembed noframes noscript script".split())
REFERENCED = frozenset(("title", "textarea"))
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes script style template title noscript".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu nav ol pre search section summary ul".split())
IMPLIED_ENDS = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
SPECIAL = BLOCKS | HEADINGS | TABLE_PARTS | HEAD_TAGS - {"noscript"} | frozenset(
    "applet area body br button dd dt embed form frame frameset head hr html iframe img input keygen li marquee noembed noscript object p param plaintext select source table textarea track wbr xmp".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template select".split())
TABLE_SCOPE = frozenset("html table template".split())
MATH_TEXT = frozenset("mi mo mn ms mtext annotation-xml".split())
SVG_HTML = frozenset("foreignobject desc title".split())
LEAVES_FOREIGN = BLOCKS | HEADINGS | FORMATTING - {"a"} | frozenset("body br dd dt embed head hr img li meta p ruby span sub sup table var".split())

_SPACE = " \t\n\f\r"
_TAG = re.compile(r"<(/?)([A-Za-z][^\t\n\f\r />\0]*)")
_ATTRIBUTE = re.compile(r"[\t\n\f\r /]*(?:([^\t\n\f\r />][^\t\n\f\r />=]*)[\t\n\f\r ]*(=?)[\t\n\f\r ]*)?")
_UNQUOTED = re.compile(r"[^\t\n\f\r >]*")
_COMMENT_END = re.compile(r"--!?>")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)(?P<more>=?)")


def _value(raw: str) -> str:
    """An attribute's value: a name without its semicolon is no reference before a letter, a digit or =."""

    def one(m: re.Match) -> str:
        named = m[0][1:].removesuffix("=") if m["more"] else m[0][1:]
        if named[0] != "#" and not named.endswith(";") and (m["more"] or named not in html5):
            return m[0]
        return html.unescape("&" + named) + m["more"]

    if "\r" in raw:
        raw = raw.replace("\r\n", "\n").replace("\r", "\n")
    return _REFERENCE.sub(one, raw) if "&" in raw else raw


@dataclass(slots=True, eq=False)
class Node:
    """An element: where its start tag and its text stand in the page; of one that has no tag in the page start is None."""

    tag: str
    attrs: dict[str, str]
    space: str = "html"  # or svg or math
    start: int | None = None
    stop: int | None = None
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    text: str | None = None
    text_start: int | None = None
    text_stop: int | None = None
    closed: bool = False


@dataclass(slots=True, eq=False)
class Token:
    kind: str  # start, end, text, space, doctype or eof
    name: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    closed: bool = False
    start: int | None = None
    stop: int | None = None


class Tree:
    """Builds the tree of ``page``; ``root`` is the document, whose child is the html element."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.root = Node("#document", {})
        self.open: list[Node] = []
        self.formatting: list[Node | None] = []  # None: a marker
        self.mode, self.templates = self.initial, []
        self.head = self.form = None
        self.quirks, self.foster = True, False
        for token in self.tokens():
            self.take(token)

    # -- tokens

    def tokens(self):
        page, end = self.page, len(self.page)
        while self.at < end:
            start = self.at
            if page[start] != "<":
                stop = page.find("<", start)
                self.at = stop = end if stop < 0 else stop
                yield from self.text(start, stop)
            elif m := _TAG.match(page, start):
                if token := self.tag(m):
                    yield token
            elif page.startswith("<!--", start):
                if page.startswith((">", "->"), start + 4):
                    self.at = page.index(">", start) + 1
                else:
                    m = _COMMENT_END.search(page, start + 4)
                    self.at = m.end() if m else end
            elif page.startswith("<![CDATA[", start) and self.open and self.open[-1].space != "html":
                stop = page.find("]]>", start)
                self.at = end if stop < 0 else stop + 3
                yield from self.text(start + 9, end if stop < 0 else stop)
            elif page.startswith(("<!", "<?", "</"), start) and start + 2 < end:
                stop = page.find(">", start)
                self.at = end if stop < 0 else stop + 1
                if page[start : start + 9].lower() == "<!doctype":
                    yield Token("doctype", page[start + 9 : self.at].strip(_SPACE + ">").lower())
            else:
                self.at = start + 1
                yield from self.text(start, self.at)
        yield Token("eof")

    def text(self, start: int, stop: int):
        data = self.page[start:stop]
        bare = data.lstrip(_SPACE)
        if len(bare) < len(data):
            yield Token("space", start=start, stop=stop - len(bare))
        if bare:
            yield Token("text", start=stop - len(bare), stop=stop)

    def tag(self, m: re.Match) -> Token | None:
        """The tag at the place; None where the page ends in it."""
        page, at, attrs = self.page, m.end(), {}
        while True:
            a = _ATTRIBUTE.match(page, at)
            at = a.end()
            if a[1] is None:
                break
            raw = ""
            if a[2]:
                quote = page[at : at + 1]
                if quote in ('"', "'") and quote:
                    stop = page.find(quote, at + 1)
                    if stop < 0:
                        self.at = len(page)
                        return None
                    raw, at = page[at + 1 : stop], stop + 1
                else:
                    raw = _UNQUOTED.match(page, at)[0]
                    at += len(raw)
            attrs.setdefault(a[1].lower(), _value(raw))
        if page[at : at + 1] != ">":
            self.at = len(page)
            return None
        self.at = at + 1
        return Token("end" if m[1] else "start", m[2].lower(), attrs, page[at - 1] == "/", m.start(), self.at)

    def raw(self, node: Node) -> None:
        """Takes the text up to the end tag of ``node``, which has just been put in place, and closes it."""
        page, begin = self.page, self.at
        end = re.compile(rf"</{re.escape(node.tag)}(?=[\t\n\f\r />])", re.I)
        at = begin
        while (m := end.search(page, at)) and node.tag == "script" and self._escaped(begin, m.start()):
            at = m.end()
        stop = m.start() if m else len(page)
        data = page[begin:stop]
        if node.tag == "textarea" and data[:1] == "\n":
            data = data[1:]
        node.text, node.text_start, node.text_stop = html.unescape(data) if node.tag in REFERENCED else data, begin, stop
        self.at = stop
        if m:
            self.tag(_TAG.match(page, stop))
        self.pop()

    def _escaped(self, begin: int, at: int) -> bool:
        """Whether an end tag of a script is text: inside <!-- there is a <script without its end."""
        opened, inner = self.page.rfind("<!--", begin, at), 0
        if opened < 0 or _COMMENT_END.search(self.page, opened + 2, at):
            return False
        for m in re.finditer(r"<(/?)script(?=[\t\n\f\r />])", self.page[opened:at], re.I):
            inner = 0 if m[1] else 1
        return bool(inner)

    # -- the stack

    def insert(self, t: Token, space: str = "html", below: Node | None = None) -> Node:
        node = Node(t.name, t.attrs, space, t.start, t.stop, closed=t.closed)
        self.put(node, below)
        self.open.append(node)
        return node

    def put(self, node: Node, below: Node | None = None) -> None:
        """``node`` where new ones go: in the current element, or before a table in which it must not be."""
        target = below or (self.open[-1] if self.open else self.root)
        if self.foster and target.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            table = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k].tag in ("table", "template")), 0)
            at = self.open[table]
            if at.tag == "table" and at.parent is not None:
                node.parent = at.parent
                at.parent.children.insert(at.parent.children.index(at), node)
                return
            target = at if at.tag == "template" else self.open[max(0, table - 1)]
        node.parent = target
        target.children.append(node)

    def pop(self) -> Node:
        return self.open.pop()

    def pop_to(self, *names: str) -> None:
        while self.open and self.pop().tag not in names:
            pass

    def back_to(self, *names: str) -> None:
        while len(self.open) > 1 and self.open[-1].tag not in (*names, "html", "template"):
            self.pop()

    def has(self, *names: str, bounds=SCOPE, more=()) -> bool:
        for node in reversed(self.open):
            if node.space == "html":
                if node.tag in names:
                    return True
                if node.tag in bounds or node.tag in more:
                    return False
            elif bounds is SCOPE and (node.tag in MATH_TEXT or node.tag in SVG_HTML):
                return False
        return False

    def implied(self, but: str = "") -> None:
        while self.open and self.open[-1].tag in IMPLIED_ENDS and self.open[-1].tag != but:
            self.pop()

    def close_p(self) -> None:
        if self.has("p", more=("button",)):
            self.implied("p")
            self.pop_to("p")

    def reconstruct(self) -> None:
        """Opens anew the formatting elements that were closed by others."""
        entries, k = self.formatting, len(self.formatting)
        while k and entries[k - 1] is not None and entries[k - 1] not in self.open:
            k -= 1
        for j in range(k, len(entries)):
            old = entries[j]
            entries[j] = self.insert(Token("start", old.tag, old.attrs))

    def format(self, node: Node) -> None:
        same = []
        for e in reversed(self.formatting):
            if e is None:
                break
            if e.tag == node.tag and e.attrs == node.attrs:
                same.append(e)
        if len(same) >= 3:
            self.formatting.remove(same[-1])
        self.formatting.append(node)

    def to_marker(self) -> None:
        while self.formatting and self.formatting.pop() is not None:
            pass

    def adopt(self, t: Token) -> None:
        """The end of a formatting element that may lie across others."""
        if self.open[-1].tag == t.name and self.open[-1] not in self.formatting:
            self.pop()
            return
        for _ in range(8):
            element = None
            for e in reversed(self.formatting):
                if e is None or e.tag == t.name:
                    element = e
                    break
            if element is None:
                return self.other_end(t)
            if element not in self.open:
                self.formatting.remove(element)
                return None
            if not self.has(t.name):
                return None
            place = self.open.index(element)
            block = next((n for n in self.open[place + 1 :] if n.tag in SPECIAL and n.space == "html"), None)
            if block is None:
                del self.open[place:]
                self.formatting.remove(element)
                return None
            ancestor, mark, last = self.open[place - 1], self.formatting.index(element), block
            at = self.open.index(block)
            for inner in range(1, 1 << 30):
                at -= 1
                node = self.open[at]
                if node is element:
                    break
                if inner > 3 and node in self.formatting:
                    mark -= self.formatting.index(node) < mark
                    self.formatting.remove(node)
                if node not in self.formatting:
                    del self.open[at]
                    continue
                copy = Node(node.tag, node.attrs)
                self.formatting[self.formatting.index(node)] = self.open[at] = copy
                if last is block:
                    mark = self.formatting.index(copy) + 1
                self.move(last, copy)
                last = copy
            last.parent.children.remove(last) if last.parent else None
            self.foster, was = True, self.foster
            self.put(last, ancestor)
            self.foster = was
            copy = Node(element.tag, element.attrs)
            for child in list(block.children):
                self.move(child, copy)
            self.move(copy, block)
            gone = self.formatting.index(element)
            self.formatting.remove(element)
            self.formatting.insert(mark - (gone < mark), copy)
            self.open.remove(element)
            self.open.insert(self.open.index(block) + 1, copy)
        return None

    @staticmethod
    def move(node: Node, to: Node) -> None:
        if node.parent is not None:
            node.parent.children.remove(node)
        node.parent = to
        to.children.append(node)

    def other_end(self, t: Token) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            node = self.open[k]
            if node.tag == t.name and node.space == "html":
                self.implied(t.name)
                del self.open[k:]
                return
            if node.tag in SPECIAL and node.space == "html":
                return

    def reset(self) -> None:
        """The mode that fits the open elements."""
        for node in reversed(self.open):
            if node.tag in ("td", "th") and node is not self.open[0]:
                self.mode = self.in_cell
            elif node.tag == "tr":
                self.mode = self.in_row
            elif node.tag in ("tbody", "thead", "tfoot"):
                self.mode = self.in_table_body
            elif node.tag == "caption":
                self.mode = self.in_caption
            elif node.tag == "colgroup":
                self.mode = self.in_columns
            elif node.tag == "table":
                self.mode = self.in_table
            elif node.tag == "template":
                self.mode = self.templates[-1]
            elif node.tag == "head":
                self.mode = self.in_head
            elif node.tag == "frameset":
                self.mode = self.in_frameset
            elif node.tag == "html":
                self.mode = self.after_head if self.head else self.before_head
            elif node.tag != "body":
                continue
            else:
                self.mode = self.in_body
            return

    # -- modes

    def take(self, t: Token) -> None:
        now = self.open[-1] if self.open else None
        if now is not None and now.space != "html" and t.kind != "eof":
            math_text = now.space == "math" and now.tag in MATH_TEXT and now.tag != "annotation-xml"
            as_html = (now.space == "svg" and now.tag in SVG_HTML) or (now.tag == "annotation-xml" and now.attrs.get("encoding", "").lower() in ("text/html", "application/xhtml+xml"))
            if t.kind == "start":
                as_html = as_html or (math_text and t.name not in ("mglyph", "malignmark")) or (now.tag == "annotation-xml" and t.name == "svg")
            elif t.kind in ("text", "space"):
                as_html = as_html or math_text
            else:
                as_html = False
            if not as_html:
                return self.foreign(t)
        return self.mode(t)

    def go(self, mode, t: Token) -> None:
        self.mode = mode
        self.take(t)

    def foreign(self, t: Token) -> None:
        if t.kind in ("text", "space"):
            self.add_text(t)
        elif t.kind == "start":
            if t.name in LEAVES_FOREIGN or (t.name == "font" and t.attrs.keys() & {"color", "face", "size"}):
                while self.open[-1].space != "html" and not (self.open[-1].space == "math" and self.open[-1].tag in MATH_TEXT) and not (self.open[-1].space == "svg" and self.open[-1].tag in SVG_HTML):
                    self.pop()
                return self.mode(t)
            self.insert(t, self.open[-1].space)
            if t.closed:
                self.pop()
        elif t.kind == "end":
            if t.name in ("br", "p"):
                while self.open[-1].space != "html":
                    self.pop()
                return self.mode(t)
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].space == "html":
                    return self.mode(t)
                if self.open[k].tag == t.name:
                    del self.open[k:]
                    return None
        return None

    def add_text(self, t: Token) -> None:
        node = self.open[-1]
        if node.tag in ("title", "style", "script"):
            data = html.unescape(self.page[t.start : t.stop])
            node.text_start = t.start if node.text is None else node.text_start
            node.text, node.text_stop = (node.text or "") + data, t.stop

    def initial(self, t: Token) -> None:
        if t.kind == "doctype":
            self.quirks = not t.name.startswith("html")
            self.mode = self.before_html
        elif t.kind != "space":
            self.go(self.before_html, t)

    def before_html(self, t: Token) -> None:
        if t.kind == "start" and t.name == "html":
            self.insert(t)
            self.mode = self.before_head
        elif t.kind not in ("space", "doctype") and not (t.kind == "end" and t.name not in ("head", "body", "html", "br")):
            self.insert(Token("start", "html"))
            self.go(self.before_head, t)

    def before_head(self, t: Token) -> None:
        if t.kind == "start" and t.name == "head":
            self.head = self.insert(t)
            self.mode = self.in_head
        elif t.kind == "start" and t.name == "html":
            self.more_html(t)
        elif t.kind not in ("space", "doctype") and not (t.kind == "end" and t.name not in ("head", "body", "html", "br")):
            self.head = self.insert(Token("start", "head"))
            self.go(self.in_head, t)

    def more_html(self, t: Token) -> None:
        for k, v in t.attrs.items():
            self.open[0].attrs.setdefault(k, v)

    def in_head(self, t: Token) -> None:
        if t.kind in ("space", "doctype"):
            return None
        if t.kind == "start":
            if t.name == "html":
                return self.more_html(t)
            if t.name in REFERENCED or t.name in RAW:
                return self.raw(self.insert(t))
            if t.name == "template":
                self.insert(t)
                self.formatting.append(None)
                self.templates.append(self.in_template)
                self.mode = self.in_template
                return None
            if t.name in HEAD_TAGS:
                self.insert(t)
                self.pop()
                return None
            if t.name == "head":
                return None
        elif t.kind == "end":
            if t.name == "head":
                self.pop()
                self.mode = self.after_head
                return None
            if t.name == "template":
                if any(n.tag == "template" for n in self.open):
                    self.pop_to("template")
                    self.to_marker()
                    self.templates.pop()
                    self.reset()
                return None
            if t.name not in ("body", "html", "br"):
                return None
        self.pop()
        return self.go(self.after_head, t)

    def after_head(self, t: Token) -> None:
        if t.kind in ("space", "doctype"):
            return None
        if t.kind == "start":
            if t.name == "html":
                return self.more_html(t)
            if t.name in ("body", "frameset"):
                self.insert(t)
                self.mode = self.in_body if t.name == "body" else self.in_frameset
                return None
            if t.name in HEAD_TAGS and t.name != "noscript":
                self.open.append(self.head)
                self.in_head(t)
                self.open.remove(self.head)
                return None
            if t.name == "head":
                return None
        elif t.kind == "end" and t.name == "template":
            return self.in_head(t)
        elif t.kind == "end" and t.name not in ("body", "html", "br"):
            return None
        self.insert(Token("start", "body"))
        return self.go(self.in_body, t)

    def in_body(self, t: Token) -> None:
        if t.kind in ("text", "space"):
            self.reconstruct()
        elif t.kind == "start":
            self.body_start(t)
        elif t.kind == "end":
            self.body_end(t)
        elif t.kind == "eof" and self.templates:
            self.in_template(t)

    def body_start(self, t: Token) -> None:
        name = t.name
        if name == "html":
            if not self.templates:
                self.more_html(t)
        elif name == "body":
            if not self.templates and len(self.open) > 1 and self.open[1].tag == "body":
                for k, v in t.attrs.items():
                    self.open[1].attrs.setdefault(k, v)
        elif name in HEAD_TAGS:
            self.in_head(t)
        elif name in ("textarea", "iframe", "noembed", "xmp"):
            if name == "xmp":
                self.close_p()
                self.reconstruct()
            self.raw(self.insert(t))
        elif name == "plaintext":
            self.close_p()
            self.insert(t)
            self.at = len(self.page)
        elif name in BLOCKS or name == "p":
            self.close_p()
            self.insert(t)
        elif name in HEADINGS:
            self.close_p()
            if self.open[-1].tag in HEADINGS:
                self.pop()
            self.insert(t)
        elif name == "form":
            if self.form is None or self.templates:
                self.close_p()
                node = self.insert(t)
                self.form = self.form if self.templates else node
        elif name in ("li", "dd", "dt"):
            names = ("li",) if name == "li" else ("dd", "dt")
            for node in reversed(self.open):
                if node.tag in names:
                    self.implied(node.tag)
                    self.pop_to(node.tag)
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
            self.close_p()
            self.insert(t)
        elif name == "button":
            if self.has("button"):
                self.implied()
                self.pop_to("button")
            self.reconstruct()
            self.insert(t)
        elif name in FORMATTING:
            if name == "a":
                old = next((e for e in reversed(self.formatting[self._after_marker() :]) if e.tag == "a"), None)
                if old is not None:
                    self.adopt(Token("end", "a"))
                    for of in (self.formatting, self.open):
                        if old in of:
                            of.remove(old)
            self.reconstruct()
            if name == "nobr" and self.has("nobr"):
                self.adopt(Token("end", "nobr"))
                self.reconstruct()
            self.format(self.insert(t))
        elif name in ("applet", "marquee", "object"):
            self.reconstruct()
            self.insert(t)
            self.formatting.append(None)
        elif name == "table":
            if not self.quirks:
                self.close_p()
            self.insert(t)
            self.mode = self.in_table
        elif name in VOID or name in ("image", "param", "keygen"):
            if name == "hr":
                self.close_p()
            elif name not in ("param", "source", "track"):
                self.reconstruct()
            t.name = "img" if name == "image" else name
            self.insert(t)
            self.pop()
        elif name == "select":
            if self.has("select", bounds=SCOPE - {"select"}):
                self.pop_to("select")
            else:
                self.reconstruct()
                self.insert(t)
        elif name in ("option", "optgroup"):
            if self.open[-1].tag == "option":
                self.pop()
            if name == "optgroup" and self.open[-1].tag == "optgroup":
                self.pop()
            self.reconstruct()
            self.insert(t)
        elif name in ("rb", "rtc", "rp", "rt"):
            if self.has("ruby"):
                self.implied("" if name in ("rb", "rtc") else "rtc")
            self.insert(t)
        elif name in ("svg", "math"):
            self.reconstruct()
            self.insert(t, name)
            if t.closed:
                self.pop()
        elif name not in TABLE_PARTS and name not in ("frame", "frameset", "head"):
            self.reconstruct()
            self.insert(t)

    def _after_marker(self) -> int:
        return next((k + 1 for k in range(len(self.formatting) - 1, -1, -1) if self.formatting[k] is None), 0)

    def body_end(self, t: Token) -> None:
        name = t.name
        if name == "template":
            self.in_head(t)
        elif name in ("body", "html"):
            if self.has("body"):
                self.mode = self.after_body
                if name == "html":
                    self.after_body(t)
        elif name in BLOCKS or name == "button":
            if self.has(name):
                self.implied()
                self.pop_to(name)
        elif name == "form":
            node = self.form
            if self.templates:
                if self.has("form"):
                    self.implied()
                    self.pop_to("form")
                return
            self.form = None
            if node in self.open and self.has("form"):
                self.implied()
                self.open.remove(node)
        elif name == "p":
            if not self.has("p", more=("button",)):
                self.insert(Token("start", "p"))
            self.close_p()
        elif name in ("li", "dd", "dt"):
            if self.has(name, more=("ol", "ul") if name == "li" else ()):
                self.implied(name)
                self.pop_to(name)
        elif name in HEADINGS:
            if self.has(*HEADINGS):
                self.implied()
                self.pop_to(*HEADINGS)
        elif name in FORMATTING:
            self.adopt(t)
        elif name in ("applet", "marquee", "object"):
            if self.has(name):
                self.implied()
                self.pop_to(name)
                self.to_marker()
        elif name == "br":
            self.body_start(Token("start", "br"))
        else:
            self.other_end(t)

    def after_body(self, t: Token) -> None:
        if not (t.kind in ("space", "eof", "doctype") or (t.kind == "end" and t.name in ("html", "body"))):
            self.go(self.in_body, t)

    def in_table(self, t: Token) -> None:
        if t.kind == "start":
            if t.name in ("caption", "colgroup", "tbody", "tfoot", "thead"):
                self.back_to("table")
                if t.name == "caption":
                    self.formatting.append(None)
                self.insert(t)
                self.mode = {"caption": self.in_caption, "colgroup": self.in_columns}.get(t.name, self.in_table_body)
                return None
            if t.name in ("col", "td", "th", "tr"):
                self.back_to("table")
                self.insert(Token("start", "colgroup" if t.name == "col" else "tbody"))
                return self.go(self.in_columns if t.name == "col" else self.in_table_body, t)
            if t.name == "table":
                if self.has("table", bounds=TABLE_SCOPE):
                    self.pop_to("table")
                    self.reset()
                    self.take(t)
                return None
            if t.name in ("style", "script", "template"):
                return self.in_head(t)
            if t.name == "input" and t.attrs.get("type", "").lower() == "hidden":
                self.insert(t)
                self.pop()
                return None
            if t.name == "form":
                if self.form is None and not self.templates:
                    self.form = self.insert(t)
                    self.pop()
                return None
        elif t.kind == "end":
            if t.name == "table":
                if self.has("table", bounds=TABLE_SCOPE):
                    self.pop_to("table")
                    self.reset()
                return None
            if t.name in TABLE_PARTS or t.name in ("body", "html"):
                return None
            if t.name == "template":
                return self.in_head(t)
        elif t.kind in ("space", "doctype"):
            return None
        self.foster, was = True, self.foster
        self.in_body(t)
        self.foster = was
        return None

    def in_caption(self, t: Token) -> None:
        ends = (t.kind == "start" and t.name in TABLE_PARTS) or (t.kind == "end" and t.name == "table")
        if ends or (t.kind == "end" and t.name == "caption"):
            if self.has("caption", bounds=TABLE_SCOPE):
                self.pop_to("caption")
                self.to_marker()
                self.mode = self.in_table
                if ends:
                    self.take(t)
        elif not (t.kind == "end" and t.name in TABLE_PARTS | {"body", "html"}):
            self.in_body(t)

    def in_columns(self, t: Token) -> None:
        if t.kind in ("space", "doctype"):
            return None
        if t.kind == "start" and t.name == "col":
            self.insert(t)
            self.pop()
            return None
        if t.name == "template" and t.kind in ("start", "end"):
            return self.in_head(t)
        if t.kind == "end" and t.name == "col":
            return None
        if self.open[-1].tag != "colgroup":
            return None
        self.pop()
        self.mode = self.in_table
        return None if t.kind == "end" and t.name == "colgroup" else self.take(t)

    def in_table_body(self, t: Token) -> None:
        parts = ("tbody", "tfoot", "thead")
        if t.kind == "start" and t.name in ("tr", "th", "td"):
            self.back_to(*parts)
            self.insert(t if t.name == "tr" else Token("start", "tr"))
            self.mode = self.in_row
            return None if t.name == "tr" else self.take(t)
        if (t.kind == "end" and t.name in (*parts, "table")) or (t.kind == "start" and t.name in ("caption", "col", "colgroup", *parts)):
            if self.has(*((t.name,) if t.kind == "end" and t.name in parts else parts), bounds=TABLE_SCOPE):
                self.back_to(*parts)
                self.pop()
                self.mode = self.in_table
                if t.kind == "start" or t.name == "table":
                    self.take(t)
            return None
        if t.kind == "end" and t.name in TABLE_PARTS | {"body", "html"}:
            return None
        return self.in_table(t)

    def in_row(self, t: Token) -> None:
        if t.kind == "start" and t.name in ("th", "td"):
            self.back_to("tr")
            self.insert(t)
            self.mode = self.in_cell
            self.formatting.append(None)
            return None
        ends = (t.kind == "end" and t.name in ("table", "tbody", "tfoot", "thead")) or (t.kind == "start" and t.name in TABLE_PARTS)
        if ends or (t.kind == "end" and t.name == "tr"):
            if self.has("tr", bounds=TABLE_SCOPE) and (t.kind == "start" or self.has(t.name, bounds=TABLE_SCOPE)):
                self.back_to("tr")
                self.pop()
                self.mode = self.in_table_body
                if ends:
                    self.take(t)
            return None
        if t.kind == "end" and t.name in TABLE_PARTS | {"body", "html"}:
            return None
        return self.in_table(t)

    def in_cell(self, t: Token) -> None:
        outer = t.kind == "end" and t.name in ("table", "tbody", "tfoot", "thead", "tr")
        if t.kind == "end" and t.name in ("td", "th"):
            if self.has(t.name, bounds=TABLE_SCOPE):
                self.close_cell(t.name)
        elif (t.kind == "start" and t.name in TABLE_PARTS) or (outer and self.has(t.name, bounds=TABLE_SCOPE)):
            if self.has("td", "th", bounds=TABLE_SCOPE):
                self.close_cell("td", "th")
                self.take(t)
        elif not outer and not (t.kind == "end" and t.name in ("body", "caption", "col", "colgroup", "html")):
            self.in_body(t)

    def close_cell(self, *names: str) -> None:
        self.implied()
        self.pop_to(*names)
        self.to_marker()
        self.mode = self.in_row

    def in_template(self, t: Token) -> None:
        if t.kind in ("text", "space"):
            return self.in_body(t)
        if t.kind == "eof":
            if any(n.tag == "template" for n in self.open):
                self.pop_to("template")
                self.to_marker()
                self.templates.pop()
                self.reset()
                return self.take(t)
            return None
        if (t.kind == "start" and t.name in HEAD_TAGS and t.name != "noscript") or (t.kind == "end" and t.name == "template"):
            return self.in_head(t)
        if t.kind == "start":
            modes = {"caption": self.in_table, "colgroup": self.in_table, "tbody": self.in_table, "tfoot": self.in_table, "thead": self.in_table, "col": self.in_columns, "tr": self.in_table_body, "td": self.in_row, "th": self.in_row}
            mode = modes.get(t.name, self.in_body)
            self.templates[-1] = mode
            return self.go(mode, t)
        return None

    def in_frameset(self, t: Token) -> None:
        if t.kind == "start" and t.name in ("frameset", "frame"):
            self.insert(t)
            if t.name == "frame":
                self.pop()
        elif t.kind == "end" and t.name == "frameset" and len(self.open) > 1:
            self.pop()
        elif t.kind == "start" and t.name == "noframes":
            self.in_head(t)


def nodes(page: str) -> list[dict]:
    """The elements of a page in the order of its tree, with the number (from 1) of the parent and of the template around (0: none).

    shadow_depth: how many open shadow roots (templates that declare one for their parent, the first of each) are around; -1 in any other template.
    """
    out: list[dict] = []
    hosts: set[int] = set()
    todo = [(n, 0, 0, 1, False, 0) for n in reversed(Tree(page).root.children)]
    while todo:
        node, parent, template, depth, in_svg, shadow = todo.pop()
        in_svg = node.space == "svg" or (in_svg and node.space != "html")
        at = len(out) + 1
        out.append({
            "tag": node.tag, "attrs": list(node.attrs.items()), "text": node.text if node.tag != "textarea" else None, "in_svg": in_svg, "start": node.start, "stop": node.stop,
            "parent_no": parent, "template_no": template, "depth": depth, "text_start": node.text_start, "text_stop": node.text_stop, "closed": node.closed,
            "shadow_depth": shadow,
        })
        inside = template
        if node.tag == "template" and node.space == "html":
            inside = at
            declares = shadow >= 0 and node.attrs.get("shadowrootmode", "").lower() in ("open", "closed") and parent not in hosts
            shadow = shadow + 1 if declares and node.attrs["shadowrootmode"].lower() == "open" else -1
            hosts |= {parent} if declares else set()
        todo += [(c, at, inside, depth + 1, in_svg, shadow) for c in reversed(node.children)]
    return out
