import pytest
from pyspark.sql import functions as F

from weftarc.sources import html
from weftarc.sources.html_tree import nodes


def shown(page: str, templates: bool = True) -> str:
    """The tree below body (or frameset) as tag(children); what is in a template stands in brackets."""
    rows = nodes(page)
    of: dict[int, list[int]] = {}
    for k, r in enumerate(rows, 1):
        of.setdefault(r["parent_no"], []).append(k)

    def one(k: int) -> str:
        inside = " ".join(one(c) for c in of.get(k, []))
        tag = rows[k - 1]["tag"]
        return tag + (f"[{inside}]" if tag == "template" and inside else f"({inside})" if inside else "")

    body = next(k for k, r in enumerate(rows, 1) if r["tag"] in ("body", "frameset"))
    return " ".join(one(c) for c in of.get(body, []))


TREES = [
    ("<p>a<p>b<div>c</div>d", "p p div"),
    ("<p>1<b>2<i>3</b>4</i>5</p>", "p(b(i) i)"),
    ("<b>1<p>2</b>3</p>", "b p(b)"),
    ("<p><b>x<br><p>y</p><p></p>z", "p(b(br)) p(b) p b"),
    ("<b><b><b><b><p>x", "b(b(b(b(p))))"),
    ("<p><b><b><b><b></p>x", "p(b(b(b(b)))) b(b(b))"),
    ("<a href=1>x<a href=2>y</a>", "a a"),
    ("<a><p>x</a>y</p>", "a p(a)"),
    ("<a><table><td><a>x</table>y", "a(table(tbody(tr(td(a)))))"),
    ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>", "ul(li li(ul(li)) li)"),
    ("<dl><dt>1<dd>2<dt>3</dl>", "dl(dt dd dt)"),
    ("<table><tr><td>1<td>2<tr><th>3</table>", "table(tbody(tr(td td) tr(th)))"),
    ("<table><img src=1><tr><td>x</table>", "img table(tbody(tr(td)))"),
    ("<table><b>x<tr><td>y</table>", "b table(tbody(tr(td)))"),
    ("<table><caption><p>x<tr><td>", "table(caption(p) tbody(tr(td)))"),
    ("<table><col><tr><td><table><td>x</table>y</table>", "table(colgroup(col) tbody(tr(td(table(tbody(tr(td)))))))"),
    ("<table><script>1</script><style>2</style><div>x</div>", "div table(script style)"),
    ("<!DOCTYPE html><p><table></table>", "p table"),
    ("<p><table></table>", "p(table)"),
    ("<h1>a<h2>b</h1>c", "h1 h2"),
    ("<button>1<p>2<button>3", "button(p) button"),
    ("<form><div><form><input></form></div>x", "form(div(input))"),
    ("<select><option>1<option>2<optgroup><option>3</select><p>", "select(option option optgroup(option)) p"),
    ("<svg><title>a<i>b</i></title><image/><rect><p>x</svg>", "svg(title(i) image rect) p"),
    ("<svg><foreignObject><div><img></div></foreignObject><path/></svg>", "svg(foreignobject(div(img)) path)"),
    ("<svg><style>a<b>c</style></svg>", "svg(style) b"),
    ("<math><mi><img></mi><mo/></math>", "math(mi(img) mo)"),
    ("<body><template><tr><td><img></td></tr></template><img>", "template[tr(td(img))] img"),
    ("<body><template><p>a<template><i></template></template><p>", "template[p(template[i])] p"),
    ("<div></p></br></div></span><img/>", "div(p br) img"),
    ("</body></html><p>late", "p"),
    ("<image src=1><hr></hr><br/><wbr>", "img hr br wbr"),
    ("<ruby>1<rt>2<rp>3</ruby>", "ruby(rt rp)"),
    ("<nobr>1<nobr>2", "nobr nobr"),
    ("<object><b></object>x<p>y", "object(b) p"),
    ("<i><li>a</i>b<li>c", "i li(i) li"),
    ("<p><!-- <img> --><!--> <img>--></p><!-->x<img><![CDATA[<b>]]><? <i> ?>", "p(img) img"),
    ("<img title='a>b' src=x><img alt=\"<p>\"><p title=>", "img img p"),
    ("<div<p>x", "div<p"),
    ("<img src=a <p>x", "img"),
    ("<p>x<img src='never closed", "p"),
    ("<li>1<div><li>2", "li(div) li"),
    ("<p>1<a>2<address>3</a>4", "p(a) address(a)"),
    ("<html><frameset><frame><frame></frameset>", "frame frame"),
    ("<b>1<table><td>3</b>4</table>5", "b(table(tbody(tr(td))))"),
]


@pytest.mark.parametrize("page, tree", TREES)
def test_trees(page, tree):
    assert shown(page) == tree


@pytest.mark.parametrize("context", ["textarea", "title", "template", "noscript", "iframe", "xmp", "noembed", "plaintext", "noframes", "style", "script"])
def test_an_image_that_is_text_is_no_element(context):
    page = f"<!DOCTYPE html><body><{context}><img src=1></{context}><img src=2>"
    images = [r["attrs"] for r in nodes(page) if r["tag"] == "img" and r["template_no"] == 0]
    assert images == ([] if context == "plaintext" else [[("src", "2")]])


def test_texts_and_their_places():
    page = "<title>a &amp; b</title><style>p{}</style><script><!-- <script> </script> x --></script><textarea>\n&lt;</textarea>"
    rows = {r["tag"]: r for r in nodes(page)}
    assert rows["title"]["text"] == "a & b" and rows["style"]["text"] == "p{}" and rows["script"]["text"] == "<!-- <script> </script> x -->" and rows["textarea"]["text"] is None
    for tag in ("title", "style", "script"):
        assert page[rows[tag]["start"] : rows[tag]["stop"]] == f"<{tag}>"
        assert page[rows[tag]["text_start"] : rows[tag]["text_stop"]].replace("&amp;", "&") == rows[tag]["text"]


def test_attributes():
    (img,) = (r["attrs"] for r in nodes('<img SRC="a?b=1&copy=2&amp;x&copy;" src=no alt=x/y data-é=1 checked  = "a\r\nb" / q=>') if r["tag"] == "img")
    assert dict(img) == {"src": "a?b=1&copy=2&x©", "alt": "x/y", "data-é": "1", "checked": "a\nb", "q": ""}


def test_pages_that_are_hardly_html(spark):
    pages = ["", None, "<", "</", "<!", "plain", "<![CDATA[", "<p" * 3, "<b>" * 400 + "<p>" * 400, "<table>" * 300, "<div>" * 5000, "<body>" + "</p>" * 50, "<a><b><i>" * 60 + "</a>" * 90, "\0<p\0>"]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("http://h.example/"))
    counted = {r.page_id: r["count"] for r in html.elements(rows).groupBy("page_id").count().collect()}
    assert 0 not in counted and 1 not in counted and counted[5] == 3 and counted[10] == 5003 and counted[11] == 53
    assert html.elements(rows.limit(0)).count() == 0


def test_templates_are_apart(spark):
    page = "<base href=/x/><template><base href=/no/><img src=a><template><i></i></template></template><img src=b>"
    rows = spark.createDataFrame([(1, "http://h.example/", "<template><base href=/no/></template>" + page)], "page_id long, url string, html string")
    assert [(r.tag, r.base_url) for r in html.elements(rows).filter("tag = 'img'").collect()] == [("img", "http://h.example/x/")]
    assert [(r.tag, r.template_no) for r in html.elements(rows, templates=True).filter("template_no > 0").orderBy("element_no").collect()] == [("base", 3), ("base", 6), ("img", 6), ("template", 6), ("i", 9)]
