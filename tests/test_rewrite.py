import pytest
from pyspark.sql import functions as F

from weftarc.functions import privacy, urls
from weftarc.operators import csp, offline_pages, policy, rewrite
from weftarc.sources import html

B = "http://h.example/d/page"


@pytest.fixture(scope="module")
def saved(spark):
    rows = [(1, f"http://h.example/{n}", ["http://H.example:80/alias.png"] if n == "d/1.png" else None, f"assets/é {n.rpartition('/')[2]}") for n in ("d/1.png", "d/a.css", "d/m.js", "f.woff2")]
    return rewrite.lookup(spark.createDataFrame(rows, "job_id long, url string, aliases array<string>, path string"))


def texts(spark, *values):
    return spark.createDataFrame([(1, k, "css/s.css", B, v) for k, v in enumerate(values)], "job_id long, text_id long, source_path string, base_url string, text string")


def out(df):
    return {r.text_id: (r.text, r.n_rewritten, r.n_unmapped) for r in df.collect()}


def test_css(spark, saved):
    got = out(rewrite.rewrite_css(texts(spark, "p{background:url(1.png#x)} @font-face{src:url('/f.woff2')}", "p{background:url(none.png)}", "", "a{fill:url(#g)}"), saved))
    assert got[0] == ("p{background:url(\"../assets/%C3%A9%201.png#x\")} @font-face{src:url(\"../assets/%C3%A9%20f.woff2\")}", 2, 0)
    assert got[1] == ("p{background:url(none.png)}", 0, 1) and got[2] == ("", 0, 0) and got[3] == ("a{fill:url(#g)}", 0, 0)
    assert out(rewrite.rewrite_css(texts(spark, "p{background:url(none.png)}"), saved, neutralise=True))[0][0] == 'p{background:url("data:,")}'


def test_srcset_and_scripts(spark, saved):
    got = out(rewrite.rewrite_srcset(texts(spark, "1.png 1x,  none.png 2x, data:image/png,a,b 3x", "1.png 0w, /alias.png"), saved))
    assert got[0] == ("../assets/%C3%A9%201.png 1x,  none.png 2x, data:image/png,a,b 3x", 1, 1) and got[1][0] == "1.png 0w, ../assets/%C3%A9%201.png"
    got = out(rewrite.rewrite_javascript(texts(spark, 'import x from "./m.js"; f("none.js") // "m.js"'), saved))
    assert got[0][0] == 'import x from "../assets/%C3%A9%20m.js"; f("none.js") // "m.js"'
    got = out(rewrite.rewrite_javascript(texts(spark, """fetch('1.png'); JSON.parse('{"./1.png":"./1.png#f","b":["/none.png"]}')"""), saved))
    assert got[0] == ("""fetch('../assets/%C3%A9%201.png'); JSON.parse('{"./1.png":"./assets/%C3%A9%201.png#f","b":["/none.png"]}')""", 2, 1)


def test_html(spark, saved):
    page = '<html><head><base href="/d/page">\n<link rel=stylesheet href="a.css" integrity=x><link rel=prefetch href=z><meta http-equiv=Content-Security-Policy content=a></head><body><img src="1.png" alt="ü"><img src=none.png>\n<input name=user value=me><a href="1.png">t</a><script>1</script></body></html>'
    pages = spark.createDataFrame([(7, 1, "index.html", B, page, "http://h.example/d/page"), (8, 1, "index.html", B, None, "http://h.example/")], "page_id long, job_id long, source_path string, base_url string, html string, url string")
    got = {r.page_id: r for r in offline_pages.rewrite_html(html.elements(pages), pages, saved, policy="default-src 'self'", freeze_scripts=True).collect()}
    assert got[7].html == (
        "<html><head><meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'self'\">\n<link rel=\"stylesheet\" href=\"assets/%C3%A9%20a.css\"></head><body>"
        '<img src="assets/%C3%A9%201.png" alt="ü"><img src=none.png>\n<input name="user"><a href="1.png">t</a><script type="application/x-disabled-script">1</script></body></html>'
    )
    assert (got[7].n_rewritten, got[7].n_unmapped) == (2, 1) and got[8].html == ""


def test_two_paths_of_one_url_are_an_error(spark):
    rows = [(1, "http://h.example/a", None, "x"), (1, "http://h.example/a#f", None, "y")]
    with pytest.raises(Exception, match="two paths"):
        rewrite.lookup(spark.createDataFrame(rows, "job_id long, url string, aliases array<string>, path string")).collect()


def test_cleanup(spark):
    page = '<script src="https://x.example/analytics.js"></script><img src="/pixel/a"><iframe src="/checkout/x"></iframe><iframe srcdoc="a"></iframe><iframe src=q></iframe><style>a{b:url(chrome-extension://x)}</style><p>'
    found = html.elements(spark.createDataFrame([(1, "http://h.example/", page)], "page_id long, url string, html string"))
    r = policy.cleanup_counts(found).first()
    assert (r.removed, r.n_extension_injection, r.n_tracking_runtime, r.n_payment_runtime, r.n_nonportable_iframe) == (5, 1, 2, 1, 1)


def test_secrets(spark):
    names = {"accessToken": True, "api_key": True, "key_api": False, "user": False, "session-user-id": True, "csrf": True, "author": False, None: False}
    df = spark.createDataFrame([(k,) for k in names], "n string").select("n", privacy.is_sensitive(F.col("n")).alias("s"))
    assert {r.n: r.s for r in df.collect()} == names
    cases = {"https://h.example/a?token=1&b=2#f": "https://h.example/a?token=REDACTED&b=2", "data:text/plain,x": "data:REDACTED", "blob:https://a.example/1": "blob:https://a.example/REDACTED", "ftp://h/x": "ftp:REDACTED"}
    df = urls.with_url(spark.createDataFrame([(k,) for k in cases], "v string"), "v").select("v", privacy.diagnostic_url(F.col("u")).alias("d"))
    assert {r.v: r.d for r in df.collect()} == cases


def test_policies_of_pages(spark):
    report_only, own = "content-security-policy-report-only", "content-security-policy"
    rows = [
        (1, own, "default-src 'none'; img-src *; IMG-SRC x", True, ["image", "font", "script"]), (2, own, "script-src-elem 'self'", True, ["script", "image"]), (3, own, None, True, ["font"]),
        (4, own, "img-src 'none'", False, ["image"]), (5, report_only, "img-src 'none'", True, ["image"]), (6, own, ";; Font-Src 'NONE' a ;", True, ["font", "image"]), (7, own, "img-src 'none'", True, None),
    ]
    df = spark.createDataFrame(rows, "page_id long, http_equiv string, policy string, in_head boolean, types array<string>")
    got = {r.page_id: (r.status, r.adjusted_policy, [(c.directive, c.added, c.removed) for c in r.changes]) for r in csp.adjusted(df).collect()}
    assert got == {
        1: ("adjusted", "default-src 'self'; img-src * 'self'; img-src x", [("default-src", ["'self'"], ["'none'"]), ("img-src", ["'self'"], [])]), 2: ("unchanged", "script-src-elem 'self'", []),
        3: ("empty-policy", "", []), 4: ("outside-head", "img-src 'none'", []), 5: ("report-only-unsupported", "img-src 'none'", []), 6: ("adjusted", "font-src a 'self'", [("font-src", ["'self'"], ["'NONE'"])]), 7: ("unchanged", "img-src 'none'", []),
    }


def page_of(spark, saved, html_text, **options):
    pages = spark.createDataFrame([(7, 1, "index.html", B, html_text, B)], "page_id long, job_id long, source_path string, base_url string, html string, url string")
    return offline_pages.rewrite_html(html.elements(pages), pages, saved, **options).first()


A = "assets/%C3%A9%20"


def test_every_kind_of_reference_of_a_page(spark, saved):
    page = (
        '<style>p{background:url(1.png)} q{background:url(no.png)}</style><img srcset="1.png 1x, no.png 2x" src=/alias.png crossorigin integrity=x>'
        '<p style="background:url(1.png);color:red">t</p><svg><image xlink:href="1.png"/><rect fill="url(1.png#a)" stroke="red"/><style>a{fill:url(1.png)}</style></svg>'
        '<script>import("./m.js"); x("none.js")</script><textarea><img src="1.png"></textarea><template><img src="1.png"></template><a href="1.png">u</a>'
    )
    got = page_of(spark, saved, page)
    assert got.html == (
        f'<style>p{{background:url("{A}1.png")}} q{{background:url(no.png)}}</style><img srcset="{A}1.png 1x, no.png 2x" src="{A}1.png">'
        f'<p style="background:url(&quot;{A}1.png&quot;);color:red">t</p><svg><image xlink:href="{A}1.png"/><rect fill="url(&quot;{A}1.png#a&quot;)" stroke="red"/><style>a{{fill:url("{A}1.png")}}</style></svg>'
        f'<script>import("./{A}m.js"); x("none.js")</script><textarea><img src="1.png"></textarea><template><img src="1.png"></template><a href="1.png">u</a>'
    )
    assert (got.n_rewritten, got.n_unmapped, got.n_srcset, got.n_css, got.n_script) == (2, 0, 1, 4, 1)
    again = page_of(spark, saved, got.html)
    assert again.html == got.html


def test_what_outranks_references(spark, saved):
    call = 'navigator.serviceWorker.register("./m.js")'
    page = f'<html><head><title>x</title></head><script>{call}; import("./m.js")</script><link rel="prefetch stylesheet" href="a.css"><img src="none.png" integrity=x><p style="background:url(none.png)">'
    got = page_of(spark, saved, page, guard=True, policy="a", neutralise=True)
    deny, guard = offline_pages.DENIED, offline_pages.GUARD
    assert got.html == f'<html><head>{guard}<meta http-equiv="Content-Security-Policy" content="a"><title>x</title></head><script>{deny}; import("./{A}m.js")</script><img><p style="background:url(&quot;data:,&quot;)">'
    frozen = page_of(spark, saved, f"<script>{call}; import('./m.js')</script>", guard=True, freeze_scripts=True)
    assert frozen.html == f"{guard}<script type=\"{offline_pages.INERT_TYPE}\">{call}; import('./m.js')</script>" and frozen.n_script == 0
    assert page_of(spark, saved, "").html == "" and page_of(spark, saved, None, policy="a").html == "" and page_of(spark, saved, "text", policy="a").html == "text"


def test_spans_inside_others(spark):
    spans = "array(struct(0 as start, 4 as stop, 'a' as new), struct(2 as start, 3 as stop, 'b' as new), struct(4 as start, 4 as stop, 'c' as new), struct(5 as start, 6 as stop, 'd' as new), struct(5 as start, 9 as stop, 'e' as new))"
    df = spark.sql(f"select {spans} as s, '0123456789' as t, array() as none")
    got = df.select(rewrite.outermost(F.col("s")).alias("o"), rewrite.applied(F.col("t"), rewrite.outermost(F.col("s"))).alias("r"), rewrite.applied(F.col("t"), rewrite.outermost(F.slice("s", F.lit(1), F.lit(0)))).alias("n")).first()
    assert [s.new for s in got.o] == ["a", "c", "e"] and got.r == "ac4e9" and got.n == "0123456789"
