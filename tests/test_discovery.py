import pytest

from weftarc.operators import discovery
from weftarc.sources import css_tokens, html, script_tokens, text_scans

PAGE = """<html><head><title> A
 b</title><base href="/base/x"><link rel="stylesheet" href="a.css"><link rel="canonical" href="no.css"><style>@import "i.css"; @font-face{src:url(f.woff2) format("woff2"), url('g.ttf')} p{background:url( "bg\\69.png" )}</style></head>
<body style="background-image:url(b.png)"><img src="1.png" srcset="data:image/png,a,b 1x, 2.png 2x"><video poster=p.jpg src=v.mp4></video><svg><use href="#a"/><image xlink:href="s.png"/><rect fill="url(pat.svg#x)"/></svg><iframe src="https://other.example/"></iframe><iframe sandbox src="z"></iframe><iframe></iframe><a href="/go">x</a><script>import x from "./m.js"; fetch('/api/d.json'); var q="./img/z.png", r="img/y.png"; // "no.png"
fetch('/api/d.json')</script><input type=image src=i.gif><img src=" "></body></html>"""
H = "http://h.example"


@pytest.fixture(scope="module")
def found(spark):
    return html.elements(spark.createDataFrame([(1, f"{H}/d/page", PAGE), (2, f"{H}/", None)], "page_id long, url string, html string")).cache()


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("page_id", "ordinal").collect()]


def test_metadata(found):
    assert [tuple(r) for r in html.metadata(found).collect()] == [(1, "A b", f"{H}/base/x")]


def test_dom_candidates(found):
    assert rows(discovery.dom_candidates(found), "ordinal", "tag", "attribute", "descriptor", "resolved_url") == [
        (1, "link", "href", None, f"{H}/base/a.css"), (2, "img", "src", None, f"{H}/base/1.png"), (3, "img", "srcset", "1x", "data:image/png,a,b"), (4, "img", "srcset", "2x", f"{H}/base/2.png"),
        (5, "video", "src", None, f"{H}/base/v.mp4"), (6, "video", "poster", None, f"{H}/base/p.jpg"), (7, "iframe", "src", None, "https://other.example/"), (8, "iframe", "src", None, f"{H}/base/z"),
        (9, "input", "src", None, f"{H}/base/i.gif"),
    ]


def test_styles(found):
    sources = discovery.css_sources(found)
    assert rows(sources, "ordinal", "source_type", "attribute") == [(1, "style-element", None), (2, "style-attribute", "style"), (3, "svg-presentation-attribute", "fill")]
    assert rows(discovery.css_candidates(sources), "source_ordinal", "kind", "property", "format", "resolved_url") == [
        (1, "import", None, None, f"{H}/base/i.css"), (1, "font-face", "src", "woff2", f"{H}/base/f.woff2"), (1, "font-face", "src", None, f"{H}/base/g.ttf"), (1, "url", "background", None, f"{H}/base/bgi.png"),
        (2, "url", "background-image", None, f"{H}/base/b.png"), (3, "url", "fill", None, f"{H}/base/pat.svg"),
    ]


def test_svg_scripts_regions_links(found):
    assert rows(discovery.svg_candidates(found), "tag", "attribute", "resolved_url") == [("image", "xlink:href", f"{H}/base/s.png")]
    assert rows(discovery.script_references(found), "kind", "resolved_url") == [("module", f"{H}/base/m.js"), ("load", f"{H}/api/d.json"), ("literal", f"{H}/base/img/z.png")]
    assert rows(discovery.regions(found), "ordinal", "status") == [(1, "cross-origin"), (2, "sandboxed"), (3, "same-origin-candidate")]
    assert rows(discovery.navigation_links(found), "resolved_url") == [(f"{H}/go",)]


@pytest.mark.parametrize(
    "value, want",
    [("a.png 1x, b.png 2x", [("a.png", "1x"), ("b.png", "2x")]), ("a.png,b.png 2x", [("a.png,b.png", "2x")]), ("a.png, b.png", [("a.png", None), ("b.png", None)]), (" ,, ", []), (None, []), ("a (1,2), b", [("a", "(1,2)"), ("b", None)])],
)
def test_srcset(value, want):
    got = text_scans.srcset(value)
    assert [(c["raw_url"], c["descriptor"]) for c in got] == want
    assert all(value[c["start"] : c["stop"]] == c["raw_url"] for c in got)


def test_styles_that_are_broken_or_only_declarations():
    assert [c["raw_url"] for c in css_tokens.references("color:red;background:url(x.png)")] == ["x.png"]
    assert css_tokens.references("/* url(no.png) */ p { color: red") == [] and css_tokens.references(None) == []


def test_strings_of_scripts():
    found = lambda s: [(r["kind"], r["raw_url"], s[r["start"] : r["stop"]]) for r in text_scans.javascript(s)]
    assert found(r"""JSON.parse('{"/k.js":["/a.js","a.js","\u002fb.js",{"x":"https://h/c.png?1"}],"n":1}')""") == [("json", "/a.js", "/a.js"), ("json", "/b.js", r"\u002fb.js"), ("json", "https://h/c.png?1", "https://h/c.png?1")]
    assert found(r'JSON.parse("{\"a\":\"./x\/y.css\"}")') == [("json", "./x/y.css", r"./x\/y.css")]
    assert found("JSON.parse('{'); JSON.parse(''); JSON.parse('\"/a.js\"')") == [("json", "/a.js", "/a.js")]
    assert found(r"f('\x2fa.js', '/a b.js', '//h.example', '//h/a.js', 'https://h.example', '/a', '../.js', `/${a}.js`, '${/a.js')") == [
        ("literal", "/a.js", r"\x2fa.js"), ("literal", "/a b.js", "/a b.js"), ("literal", "//h/a.js", "//h/a.js"), ("literal", "../.js", "../.js"),
    ]
    assert found(r"import('\ud83d\ude00'); fetch('\ud83d')") == [("module", "😀", r"\ud83d\ude00"), ("load", "�", r"\ud83d")]
    assert text_scans.javascript(None) == [] and text_scans.javascript("") == []


def urls_of(sheet):
    return [(r["kind"], r["property"], r["raw_url"], r["format"]) for r in css_tokens.references(sheet)]


@pytest.mark.parametrize(
    "sheet, want",
    [
        (r"p{background:\75rl(a.png)} q{cursor:u\52 l( 'b.cur' )}", [("url", "background", "a.png", None), ("url", "cursor", "b.cur", None)]),
        ('@import "./t.css" screen; @import url(u.css); @IMPORT  url("v.css") layer(x);', [("import", None, "./t.css", None), ("import", None, "u.css", None), ("import", None, "v.css", None)]),
        ('@import layer(x) "no.css"; @import;', []),
        (
            "@font-face{font-family:A;src:url('a.woff2') format(\"woff2\"), url(a.woff) format(woff), url(a.ttf), local(x) format(no)}",
            [("font-face", "src", "a.woff2", "woff2"), ("font-face", "src", "a.woff", "woff"), ("font-face", "src", "a.ttf", None)],
        ),
        ("@media x{@font-face{src:url(a) tech(b) format(c)}} p{src:url(d) format(e)}", [("font-face", "src", "a", "c"), ("url", "src", "d", None)]),
        ("@supports (background:url(no.png)){p{background:url(yes.png)}} @namespace url(no); @document url(no){a{b:url(yes2)}}", [("url", "background", "yes.png", None), ("url", "b", "yes2", None)]),
        ("a{color:red;&:hover{background:url(n1)} .b & {mask:image-set(url(n2) 1x, 'n3' 2x)} border-image:url(n4)}", [("url", "background", "n1", None), ("url", "mask", "n2", None), ("url", "border-image", "n4", None)]),
        ("p{--a:{x:url(c1)}; --B: url(c2)}", [("url", "--a", "c1", None), ("url", "--B", "c2", None)]),
        ("p{content:'unended\n;background:url(after.png)}", [("url", "background", "after.png", None)]),
        ("p{background:url(b ad.png);color:url(ok)} q{a:url(x'y);b:url(ok2)}", [("url", "color", "ok", None), ("url", "b", "ok2", None)]),
        ('@import url("unterminated); .broken { background: url(', []),
        ("p{background:url(", []), ("p{background:url('a'", []), ("p{background:url( )} q{a:url('')}", []),
        ("/* url(no) p{ */p{a:url(/**/x)}", [("url", "a", "/**/x", None)]),
        ("a[href='url(no)']:not(url(no)){b:c} a:b{c:url(d)}", [("url", "c", "d", None)]),
        ("<!-- p{a:url(b)} -->", [("url", "a", "b", None)]), ("}p{a:url(b)}}q{c:url(d)}", [("url", "a", "b", None), ("url", "c", "d", None)]),
        ("p{width:2url(no);a:#url(no);b:myurl(no);background:URL(y)}", [("url", "background", "y", None)]),
        (r"p{a:url(a\)b);c:url('\26 \"x\
y')}", [("url", "a", "a)b", None), ("url", "c", '&"xy', None)]),
        ("fill: url(a.svg#x)", [("url", "fill", "a.svg#x", None)]), ("color:red;;background:url(b.png", []), ("p{a:b;{}c:url(d)}", [("url", "c", "d", None)]),
    ],
)
def test_css_by_its_syntax(sheet, want):
    assert urls_of(sheet) == want
    assert all(sheet[r["start"] : r["stop"]].endswith((")", '"', "'")) for r in css_tokens.references(sheet))


@pytest.mark.parametrize(
    "script, want",
    [
        ('const r=/"/; import("./a.js")', [("module", "./a.js")]), ("a = b / c; d = '/x.js' / 2", [("literal", "/x.js")]), ("if (x) /'/.test(y); fetch('u')", [("load", "u")]),
        ("x = `${ f(`/in.js`) }/no.js`; y = `/yes.js`", [("literal", "/in.js"), ("literal", "/yes.js")]), ("x = {}\n/ 'a' / fetch('q')", [("load", "q")]), ("{} /'/; import 'm'", [("module", "m")]),
        ("return /[/\"]/g.exec('./z.css')", [("literal", "./z.css")]), ("a++ / '/n.js' / b", [("literal", "/n.js")]), ("x = a ? /'/ : /\"/; new Worker('w')", [("load", "w")]),
        ("import x from './c.js'; export {y} from \"./d.js\"; export * from './e.js'", [("module", "./c.js"), ("module", "./d.js"), ("module", "./e.js")]),
        ("window.fetch('nothing'); o.import('nope'); JSON.parse('[\"/j.js\"]'); fetch(`t.json`)", [("json", "/j.js"), ("load", "t.json")]),
        ("// '/a.js'\n/* '/b.js' */ <!-- '/c.js'\nf('/d.js')", [("literal", "/d.js")]), ("#!/usr/bin '/no.js'\nf('/d.js')", [("literal", "/d.js")]),
        ("class A { #p = /'/; m() { return this.#p / 2 } } f('/e.js')", [("literal", "/e.js")]), ("switch (a) { case 1: { } /'/.x; default: f('/f.js') }", [("literal", "/f.js")]),
        ("function { invalid '/no.js'", []), ("f('/no.js'", []), ("x = 'unended\n; f('/no.js')", []), ("x = `unended ${ '/no.js'", []), ("f('/no.js')]", []), ("", []),
        ("const deps = [\"./chunks/home.js\", \"ordinary copy\", \"\", \".\", \"/about\"]; const page = import(`./chunks/home.js`);", [("literal", "./chunks/home.js"), ("module", "./chunks/home.js")]),
        ("new URL('../m.wasm#x', import.meta.url)", [("load", "../m.wasm#x")]), ("x = y.return / 'a' / '/g.js'", [("literal", "/g.js")]), ("while (a) /}/.test(b)", []),
    ],
)
def test_scripts_by_their_tokens(script, want):
    assert [(r["kind"], r["raw_url"]) for r in text_scans.javascript(script)] == want


def test_tokens_of_long_and_deep_scripts():
    assert len(script_tokens.tokens("a(" * 5000 + ")" * 5000)) == 15_000 and script_tokens.tokens("`${" * 3000) is None
    assert len(css_tokens.references("a{" * 3000 + "b:url(c);" * 1000)) == 1000 and css_tokens.references("(" * 9000) == []


def test_regions_stop_at_a_depth_and_say_so(spark, monkeypatch):
    page = "<p>x</p>"
    for _ in range(4):
        page = '<iframe srcdoc="' + page.replace("&", "&amp;").replace('"', "&quot;") + '"></iframe>'
    pages = spark.createDataFrame([(1, f"{H}/", page), (2, f"{H}/", None)], "page_id long, url string, html string")
    assert [(r.depth, r.reason) for r in discovery.page_regions(pages).collect()] == [(k, "same-origin") for k in range(4)]
    monkeypatch.setattr(discovery, "MOST_LEVELS", 2)
    assert [(r.depth, r.reason) for r in discovery.page_regions(pages).collect()] == [(0, "same-origin"), (1, "same-origin"), (2, "too-deep")]
    assert discovery.page_regions(pages.limit(0)).count() == 0
