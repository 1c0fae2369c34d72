"""Queries over the driver's tables. Where a table has no column of an operator's input, it is made from others.

Pages hold no resource elements, and there are no tables of fetches or jobs; such inputs are derived from ids
by the expressions below, which Spark and DuckDB read alike. They are synthetic and say so by their place here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftarc.functions import media, privacy, text
from weftarc.functions.tables import table, written
from weftarc.functions.urls import network_target, shown_host, url_class, with_url
from weftarc.operators import archives, discovery, evidence, fetch, jobs, offline_pages, paths, policy, reports, rewrite, store, timing
from weftarc.sources.html import elements, metadata
from weftarc.sources.text_scans import css_references, javascript_references

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _derived(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


def _in_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# -- pages


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(table(spark, sf_dir, "pages"))


def _some(n: str, html: str) -> str:
    """``html`` as often as the expression ``n`` says, for Spark and DuckDB alike."""
    return f"repeat('{html}', CAST({n} AS INT))"


#: Pages that refer to resources of every kind, made from page ids; the driver's pages have links and plain text only.
_RICH_HTML = "concat('<html><head>', " + ", ".join([
    _some("page_id % 2", '<base href="https://base.example.com/d/">'),
    "'<style>p{background:url(bg.png)} q{fill:url(#own)}</style>'",
    _some("page_id % 3", '<link rel="stylesheet" href="s.css"><link rel="next" href="n.html">'),
    "'</head><body>'",
    _some("page_id % 4", '<img src="a.png" srcset="b.png 1x, c.png 2x">'),
    _some("page_id % 5", '<p style="cursor:url(x.cur)">t</p><video poster="v.jpg"></video>'),
    _some("page_id % 3", '<svg><image href="i.svg"/><use href="#own"/></svg>'),
    _some("page_id % 2", '<iframe sandbox src="https://frames.example.net/"></iframe>'),
    _some("page_id % 3", '<script>fetch("lib/x.json"); fetch("lib/x.json")</script>'),
    _some("page_id % 7", '<script src="https://www.google-analytics.com/analytics.js"></script>'),
    _some("page_id % 2", '<embed src="https://pay.example.com/checkout">'),
    _some("page_id % 6", '<script src="chrome-extension://abc/x.js"></script>'),
    "'</body></html>'",
]) + ")"


def _rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_RICH_HTML).alias("html"))


@query("""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&', 'g'), '\\s+', ' ', 'g')) AS title,
       regexp_replace(url, '#.*$', '') AS base_url
FROM pages
""")
def src_page_metadata(spark, sf_dir):
    """SRC-1, SRC-2: title and base URL of every page."""
    rows = with_url(metadata(_elements(spark, sf_dir)), "base_url", "u")
    return rows.select("page_id", "title", F.col("u.href").alias("base_url"))


#: The pages leave b open at a line's break: each later paragraph, and the footer, opens what is still open anew, three at most.
@query(r"""
WITH cut AS (
  SELECT page_id, string_split(regexp_extract(html, '(?s)</h1>(.*)</article>', 1), '<p>')[2:] AS ps, len(regexp_extract_all(html, '<li>')) AS n_li FROM pages
), ps AS (
  SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM cut
), marked AS (
  SELECT *, CASE WHEN starts_with(p, '<b>') THEN 1 ELSE 0 END AS own, CASE WHEN regexp_replace(p, '<[^>]*>', '', 'g') = '' THEN 0 ELSE 1 END AS said, len(regexp_extract_all(p, '<br>')) AS n_br FROM ps
), opened AS (
  SELECT *, least(3, coalesce(sum(own) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS still FROM marked
), counted AS (
  SELECT page_id, count(*) AS n_p, sum(CASE WHEN own + still * greatest(own, said) > 0 THEN 1 ELSE 0 END) AS p_b, sum(greatest(own + still * greatest(own, said) - 1, 0)) AS b_b, sum(n_br) AS n_br, least(3, sum(own)) AS last
  FROM opened GROUP BY page_id
), all_counts AS (
  SELECT page_id, unnest([
    {'parent': '', 'tag': 'html', 'n': 1}, {'parent': 'html', 'tag': 'head', 'n': 1}, {'parent': 'html', 'tag': 'body', 'n': 1}, {'parent': 'head', 'tag': 'meta', 'n': 1}, {'parent': 'head', 'tag': 'title', 'n': 1},
    {'parent': 'head', 'tag': 'style', 'n': 1}, {'parent': 'head', 'tag': 'script', 'n': 1}, {'parent': 'body', 'tag': 'nav', 'n': 1}, {'parent': 'nav', 'tag': 'ul', 'n': 1}, {'parent': 'ul', 'tag': 'li', 'n': n_li},
    {'parent': 'li', 'tag': 'a', 'n': n_li}, {'parent': 'body', 'tag': 'div', 'n': 1}, {'parent': 'body', 'tag': 'article', 'n': 1}, {'parent': 'article', 'tag': 'h1', 'n': 1}, {'parent': 'article', 'tag': 'p', 'n': coalesce(n_p, 0)},
    {'parent': 'p', 'tag': 'b', 'n': coalesce(p_b, 0)}, {'parent': 'b', 'tag': 'b', 'n': coalesce(b_b, 0) + greatest(coalesce(last, 0) - 1, 0)}, {'parent': 'b', 'tag': 'br', 'n': coalesce(n_br, 0)},
    {'parent': 'body', 'tag': 'footer', 'n': 1}, {'parent': 'footer', 'tag': 'b', 'n': least(1, coalesce(last, 0))}]) AS c
  FROM cut LEFT JOIN counted USING (page_id)
)
SELECT page_id, c.parent AS parent_tag, c.tag AS tag, c.n::BIGINT AS n FROM all_counts WHERE c.n > 0
""")
def src_element_parents(spark, sf_dir):
    """SRC-1: elements of every page's tree by the element around them."""
    found = _elements(spark, sf_dir).select("page_id", "element_no", "parent_no", "tag")
    around = found.select("page_id", F.col("element_no").alias("parent_no"), F.col("tag").alias("parent_tag"))
    return found.join(around, ["page_id", "parent_no"], "left").groupBy("page_id", F.coalesce("parent_tag", F.lit("")).alias("parent_tag"), "tag").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH links AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS raw, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS ordinal FROM pages
)
SELECT page_id, ordinal::INT AS ordinal, raw AS raw_url, regexp_extract(url, '^https?://[^/?#]*') || array_to_string(list_transform(string_split(raw, ''),
  lambda c: CASE WHEN regexp_matches(c, '^[!-~]$') THEN c ELSE url_encode(c) END), '') AS resolved_url
FROM links
""")
def fn_resolved_links(spark, sf_dir):
    """FN-1, FN-2: every link of every page against the page's base, in normal form."""
    return discovery.navigation_links(_elements(spark, sf_dir))


@query("""
SELECT page_id, 'style-element' AS source_type, 'style' AS tag, regexp_extract(html, '<style>([^<]*)</style>', 1) AS css_text, 0::BIGINT AS n_references FROM pages
UNION ALL SELECT -page_id, 'style-element', 'style', 'p{background:url(bg.png)} q{fill:url(#own)}', 1 FROM pages
UNION ALL SELECT -page_id, 'style-attribute', 'p', 'cursor:url(x.cur)', 1 FROM (SELECT page_id, unnest(range(0, page_id % 5)) FROM pages)
""")
def ext_css_sources(spark, sf_dir):
    """EXT-4, EXT-6: style sources of every page and of one derived from it (with the negative id), and the references in them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html").unionByName(_rich_pages(spark, sf_dir).withColumn("page_id", -F.col("page_id")))
    sources = written(discovery.css_sources(elements(pages)), "css-sources")
    n = discovery.css_candidates(sources).groupBy("page_id", F.col("source_ordinal").alias("ordinal")).count()
    return sources.join(n, ["page_id", "ordinal"], "left").select("page_id", "source_type", "tag", "css_text", F.coalesce("count", F.lit(0)).cast("long").alias("n_references"))


@query("""
SELECT page_id, page_id % 3 + 3 * (page_id % 4) + page_id % 5 + page_id % 2 + page_id % 7 + page_id % 2 + page_id % 6 AS n_dom, page_id % 3 AS n_svg,
  CASE WHEN page_id % 3 > 0 THEN 1 ELSE 0 END::BIGINT AS n_script, page_id % 2 AS n_regions FROM pages
""")
def ext_candidates(spark, sf_dir):
    """EXT-1, EXT-2, EXT-3, EXT-5, EXT-8, EXT-9: candidates of every page by kind (pages derived from page ids)."""
    found = written(elements(_rich_pages(spark, sf_dir)), "elements")
    parts = {"n_dom": discovery.dom_candidates, "n_svg": discovery.svg_candidates, "n_script": discovery.script_references, "n_regions": discovery.regions}
    out = table(spark, sf_dir, "pages").select("page_id")
    for name, of in parts.items():
        out = out.join(of(found).groupBy("page_id").agg(F.count(F.lit(1)).alias(name)), "page_id", "left")
    return out.select("page_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in parts])


#: Style sheets and scripts around the pages' own links ({0}), in turn, and what is to be read from each: kind, property or null, URL, format or null.
_SHEETS = (
    (r"a{{background:\75rl({0})}}", [("url", "background", "{0}", None)]),
    ("""@font-face{{src:url('{0}') format("woff2"), url({0}?2) format(woff)}}""", [("font-face", "src", "{0}", "woff2"), ("font-face", "src", "{0}?2", "woff")]),
    ('@import "{0}" screen; @import layer(x) url(no);', [("import", None, "{0}", None)]),
    ("@supports (a:url(no)){{b{{MASK:image-set(url({0}) 1x)}}}}", [("url", "mask", "{0}", None)]),
    ("a{{content:'x\n;cursor:url({0})}} q{{a:url(n o)}}", [("url", "cursor", "{0}", None)]),
    ("a{{b:c;&:hover{{fill:url( {0} )}}}}", [("url", "fill", "{0}", None)]),
    ("p{{--v:{{x:url({0})}};a:b}}", [("url", "--v", "{0}", None)]),
    ("@namespace url({0}); /* url({0}) */ a[b='url({0})']{{c:d}} p{{e:url({0}", []),
)
_SCRIPTS = (
    ("""const r=/"/; import("{0}.js")""", [("module", "{0}.js")]),
    ("x = 6 / 2; y = '{0}.js' / 3", [("literal", "{0}.js")]),
    ("""if (a) /'/.test(b); fetch("{0}")""", [("load", "{0}")]),
    ("x = `${{f(`{0}.js`)}}/no.js`; a++ / '{0}.css' / b", [("literal", "{0}.js"), ("literal", "{0}.css")]),
    ("""JSON.parse('{{"a":"{0}.json"}}'); window.fetch("{0}")""", [("json", "{0}.json")]),
    ("""f("{0}.js"; // not closed""", []),
    ("""{{}} /"/; new Worker("{0}"); export * from "{0}"; // "{0}.js\"""", [("load", "{0}"), ("module", "{0}")]),
)


def _text_of(shapes: tuple, k: str, way: str) -> Column:
    """The shape with the number ``k`` around ``way`` (both columns)."""
    text = F.lit("")
    for n, (shape, _) in enumerate(shapes):
        text = F.when(F.col(k) % len(shapes) == n, F.replace(F.lit(shape.format("\0")), F.lit("\0"), F.col(way))).otherwise(text)
    return text


def _rows_of(shapes: tuple, fields: tuple[str, ...], k: str, way: str) -> str:
    """DuckDB: the list of what is to be read from the shape with the number ``k``."""
    value = lambda v: "NULL::VARCHAR" if v is None else " || ".join(_in_sql(p) for p in v.format("\0").split("\0")).replace(" || ", f" || {way} || ")
    lists = ["[" + ", ".join("{" + ", ".join(f"'{f}': {value(v)}" for f, v in zip(fields, row, strict=True)) + "}" for row in rows) + "]" for _, rows in shapes]
    return f"CASE {k} % {len(shapes)} " + " ".join(f"WHEN {n} THEN {x}" for n, x in enumerate(lists) if x != "[]") + " ELSE [] END"


_WAYS = """SELECT page_id, unnest(ways) AS way, generate_subscripts(ways, 1) - 1 + page_id AS k FROM (SELECT page_id, regexp_extract_all(html, '<a href="(/[A-Za-z]+)">', 1) AS ways FROM pages)"""


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.expr("""posexplode(regexp_extract_all(html, '<a href="(/[A-Za-z]+)">', 1))""").alias("at", "way")
    return table(spark, sf_dir, "pages").select("page_id", found).withColumn("k", F.col("at") + F.col("page_id"))


@query(f"""
WITH w AS ({_WAYS}), r AS (SELECT page_id, k, unnest({_rows_of(_SHEETS, ("kind", "property", "raw_url", "format"), "k", "way")}) AS r FROM w)
SELECT page_id, k, r.kind AS kind, r.property AS property, r.raw_url AS raw_url, r.format AS format FROM r
""")
def ext_css_tokens(spark, sf_dir):
    """EXT-6, EXT-7: references of style sheets with escapes, formats, preludes, nested rules and broken strings (sheets are put around the pages' own links)."""
    sheets = _ways(spark, sf_dir).withColumn("text", _text_of(_SHEETS, "k", "way"))
    return sheets.select("page_id", F.col("k").cast("long").alias("k"), F.inline(css_references("text"))).drop("start", "stop")


@query(f"""
WITH w AS ({_WAYS}), r AS (SELECT page_id, k, unnest({_rows_of(_SCRIPTS, ("kind", "raw_url"), "k", "way")}) AS r FROM w)
SELECT page_id, k, r.kind AS kind, r.raw_url AS raw_url FROM r
""")
def ext_script_tokens(spark, sf_dir):
    """EXT-8: references of scripts with regular expressions, divisions, nested templates and JSON (scripts are put around the pages' own links)."""
    scripts = _ways(spark, sf_dir).withColumn("text", _text_of(_SCRIPTS, "k", "way"))
    return scripts.select("page_id", F.col("k").cast("long").alias("k"), F.inline(javascript_references("text"))).drop("start", "stop")


_DEEPEST = '<iframe src="https://far.example/x"></iframe><template shadowrootmode="closed"><iframe></iframe></template>'


def _framed(html: str, sandbox: str = "") -> str:
    return f'<iframe{sandbox} srcdoc="' + html.replace("&", "&amp;").replace('"', "&quot;") + '"></iframe>'


#: Regions in regions, by page id: frames in frames, open shadow roots in those, a sandbox around both; and what is to be found (depth, kind, access, reason).
_REGIONS = (
    ("<p>none</p><template><iframe></iframe></template>", []),
    (f"<div><template shadowrootmode=open><p><template shadowrootmode=OPEN>{_DEEPEST}</template></p></template></div>", [(0, "shadow-root", "accessible", "open-shadow-root"), (1, "shadow-root", "accessible", "open-shadow-root"), (2, "iframe", "inaccessible", "cross-origin")]),
    (_framed("<b>1</b>" + _framed(_framed(_DEEPEST))), [(0, "iframe", "accessible", "same-origin"), (1, "iframe", "accessible", "same-origin"), (2, "iframe", "accessible", "same-origin"), (3, "iframe", "inaccessible", "cross-origin")]),
    (_framed(f"<p><template shadowrootmode=open>{_framed('x')}</template></p>", ' sandbox="allow-scripts"'), [(0, "iframe", "inaccessible", "sandboxed"), (1, "shadow-root", "inaccessible", "sandboxed"), (2, "iframe", "inaccessible", "sandboxed")]),
    ('<iframe></iframe><iframe src="/own"></iframe><iframe sandbox="a allow-same-origin" src=""></iframe><iframe src="data:,x"></iframe>', [(0, "iframe", "accessible", "same-origin")] * 3 + [(0, "iframe", "inaccessible", "unavailable")]),
)


def _region_rows() -> str:
    lists = ["[" + ", ".join(f"{{'depth': {d}, 'kind': '{k}', 'access': '{a}', 'reason': '{r}'}}" for d, k, a, r in rows) + "]" for _, rows in _REGIONS]
    return f"CASE page_id % {len(_REGIONS)} " + " ".join(f"WHEN {n} THEN {x}" for n, x in enumerate(lists) if x != "[]") + " ELSE [] END"


@query(f"""
WITH r AS (SELECT page_id, unnest(rows) AS r, generate_subscripts(rows, 1)::BIGINT AS ordinal FROM (SELECT page_id, {_region_rows()} AS rows FROM pages))
SELECT page_id, ordinal, r.depth AS depth, r.kind AS kind, r.access AS access, r.reason AS reason FROM r
""")
def ext_page_regions(spark, sf_dir):
    """EXT-9: frames and open shadow roots to their depth, in the pages' own articles."""
    inside = F.lit("")
    for n, (html, _) in enumerate(_REGIONS):
        inside = F.when(F.col("page_id") % len(_REGIONS) == n, html).otherwise(inside)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), inside)).alias("html"))
    return discovery.page_regions(pages).select("page_id", "ordinal", "depth", "kind", "access", "reason")


_TARGETS = {
    "page_id": "page_id",
    "value": """CASE page_id % 14 WHEN 0 THEN url WHEN 1 THEN 'data:text/css;base64,QQ==' WHEN 2 THEN 'data:nocomma' WHEN 3 THEN 'blob:https://a.example.com/1-2'
      WHEN 4 THEN 'blob:x' WHEN 5 THEN 'ftp://files.example.com/a' WHEN 6 THEN 'http://localhost/a' WHEN 7 THEN concat('http://10.', CAST(page_id % 256 AS STRING), '.0.1/') WHEN 8 THEN 'http://user:pw@example.com/'
      WHEN 9 THEN 'http://0x7f.1/' WHEN 10 THEN 'http://[fe80::1]/x' WHEN 11 THEN '  ' WHEN 12 THEN 'not a url' ELSE 'https://Example.ORG:443/%7euser?q#f' END""",
}


@query(f"""
WITH t AS (SELECT {_sql(_TARGETS)} FROM pages)
SELECT page_id,
  CASE page_id % 14 WHEN 0 THEN regexp_replace(value, '#.*$', '') WHEN 9 THEN 'http://127.0.0.1/' WHEN 11 THEN NULL WHEN 12 THEN NULL WHEN 13 THEN 'https://example.org/%7Euser?q' ELSE value END AS href,
  CASE WHEN page_id % 14 = 1 THEN 'data' WHEN page_id % 14 = 3 THEN 'blob' WHEN page_id % 14 IN (2, 4, 5) THEN 'unsupported' WHEN page_id % 14 IN (11, 12) THEN NULL ELSE 'network' END AS kind,
  CASE page_id % 14 WHEN 2 THEN 'malformed-data-url' WHEN 4 THEN 'malformed-blob-url' WHEN 5 THEN 'unsupported-protocol' END AS unsupported,
  CASE page_id % 14 WHEN 11 THEN 'missing-url' WHEN 12 THEN 'invalid-url' WHEN 8 THEN 'embedded-credentials' WHEN 0 THEN NULL WHEN 13 THEN NULL
    WHEN 6 THEN 'local-network' WHEN 7 THEN 'local-network' WHEN 9 THEN 'local-network' WHEN 10 THEN 'local-network' ELSE 'unsupported-protocol' END AS blocked,
  CASE page_id % 14 WHEN 6 THEN 'local-hostname' WHEN 7 THEN 'private' WHEN 9 THEN 'loopback' WHEN 10 THEN 'link-local' END AS local_kind,
  CASE page_id % 14 WHEN 0 THEN regexp_extract(value, '^https?://[^/?#]*') || '/*' WHEN 13 THEN 'https://example.org/*' END AS pattern
FROM t
""")
def fn_network_targets(spark, sf_dir):
    """FN-1, FN-3, FN-13, FN-14, FN-15, FN-32: form, kind and network target of URLs of many kinds."""
    rows = with_url(_derived(table(spark, sf_dir, "pages"), _TARGETS), "value", "u").withColumn("c", url_class(F.col("u"))).withColumn("t", network_target(F.col("value"), F.col("u")))
    return rows.select("page_id", F.col("u.href").alias("href"), "c.kind", F.col("c.reason").alias("unsupported"), F.col("t.reason").alias("blocked"), "t.local_kind", "t.pattern")


#: Hosts outside ASCII with their known forms; null where a host is not sound.
_HOSTS = (
    ("bücher.example", "xn--bcher-kva.example"), ("FAß.de", "xn--fa-hia.de"), ("a\u00adb.com", "ab.com"), ("日本語。jp", "xn--wgv71a119e.jp"), ("βόλος.com", "xn--nxasmm1c.com"), ("♥.example", "xn--g6h.example"),
    ("１２７.０.０.１", "127.0.0.1"), ("مثال.إختبار", "xn--mgbh0fb.xn--kgbechtv"), ("١٢٣.example", None), ("xn--a.example", None), ("a\ufffdb", None), ("XN--BCHER-KVA.example", "xn--bcher-kva.example"),
)


@query(f"""
WITH words AS (SELECT page_id, unnest(ws) AS w, generate_subscripts(ws, 1)::BIGINT AS k FROM (SELECT page_id, regexp_extract_all(html, '<a href="/(\\p{{L}}+)">', 1) AS ws FROM pages))
SELECT page_id, k, lower(w) || '.example' AS shown, true AS is_ascii, CASE WHEN regexp_matches(w, '^[A-Za-z]*$') THEN lower(w) || '.example' END AS host FROM words
UNION ALL SELECT page_id, 0, NULL, CASE page_id % {len(_HOSTS)} {' '.join(f"WHEN {k} THEN " + ("NULL" if h is None else "true") for k, (_, h) in enumerate(_HOSTS))} END,
  CASE page_id % {len(_HOSTS)} {' '.join(f"WHEN {k} THEN " + ("NULL" if h is None else f"'{h}'") for k, (_, h) in enumerate(_HOSTS))} END FROM pages
""")
def fn_international_hosts(spark, sf_dir):
    """FN-1: hosts outside ASCII in Punycode and back: every word of letters that the pages link to as a host, and hosts with known forms."""
    pages = table(spark, sf_dir, "pages")
    words = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="/(\\p{L}+)">'), F.lit(1))).alias("k", "w"))
    words = words.select("page_id", (F.col("k") + 1).cast("long").alias("k"), F.concat(F.lit("http://"), "w", F.lit(".example/")).alias("value"))
    known = F.try_element_at(F.array(*[F.lit(f"http://{h}/") for h, _ in _HOSTS]), (F.col("page_id") % len(_HOSTS) + 1).cast("int"))
    rows = with_url(words.unionByName(pages.select("page_id", F.lit(0).cast("long").alias("k"), known.alias("value"))), "value", "u").withColumn("host", F.col("u.host"))
    is_ascii = F.when(F.col("host").isNotNull(), F.col("host").rlike("^[ -~]*$"))
    plain = (F.col("k") == 0) | F.col("value").rlike("^http://[A-Za-z]*[.]example/$")
    return rows.select("page_id", "k", F.when(F.col("k") > 0, shown_host("host")).alias("shown"), is_ascii.alias("is_ascii"), F.when(plain, F.col("host")).alias("host"))


_HEADERS = {
    "order_id": "o_orderkey",
    "content_type": "CASE o_orderkey % 8 WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN 'image/ktx2' WHEN 2 THEN 'application/ld+json' WHEN 3 THEN 'nonsense' WHEN 4 THEN ' font/woff2 ' WHEN 5 THEN 'image/png;a=b' WHEN 6 THEN NULL ELSE 'video/mp4' END",
    "content_length": "CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey AS STRING) WHEN 1 THEN '9007199254740992' WHEN 2 THEN '-1' WHEN 3 THEN ' 007 ' ELSE NULL END",
    "retry_after": "CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey % 50 AS STRING) WHEN 1 THEN 'Wed, 03 Jan 2024 00:00:10 GMT' WHEN 2 THEN 'Sunday, 06-Nov-94 08:49:37 GMT' WHEN 3 THEN 'Wed Jan  3 00:01:00 2024' WHEN 4 THEN 'soon' ELSE NULL END",
    "attempt": "1 + o_orderkey % 9",
    "status": "CASE o_orderkey % 4 WHEN 0 THEN 200 WHEN 1 THEN 503 WHEN 2 THEN 404 ELSE 429 END",
}


@query(f"""
WITH h AS (SELECT {_sql(_HEADERS)} FROM orders), p AS (
  SELECT *, CASE order_id % 6 WHEN 0 THEN (order_id % 50) * 1000 WHEN 1 THEN 10000 WHEN 2 THEN 0 WHEN 3 THEN 60000 END::BIGINT AS retry_after_ms FROM h
)
SELECT order_id,
  CASE order_id % 8 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/ktx2' WHEN 2 THEN 'application/ld+json' WHEN 4 THEN 'font/woff2' WHEN 5 THEN 'image/png' WHEN 7 THEN 'video/mp4' END AS mime,
  CASE order_id % 8 WHEN 0 THEN 'document' WHEN 1 THEN 'texture' WHEN 2 THEN 'data' WHEN 4 THEN 'font' WHEN 5 THEN 'image' WHEN 7 THEN 'video' END AS resource_type,
  CASE order_id % 5 WHEN 0 THEN order_id WHEN 3 THEN 7 END::BIGINT AS bytes,
  retry_after_ms, least(30000, greatest(500 * 2 ** (attempt - 1), coalesce(retry_after_ms, 0)))::BIGINT AS delay_ms, status IN (503, 429) AS retryable
FROM p
""")
def fn_http_headers(spark, sf_dir):
    """FN-6, FN-8, FN-9, FN-10, FN-11, FN-12: what response headers say."""
    h = _derived(table(spark, sf_dir, "orders"), _HEADERS)
    h = h.withColumn("mime", media.media_essence(F.col("content_type"))).withColumn("retry_after_ms", media.retry_after_ms(F.col("retry_after"), F.lit("2024-01-03 00:00:00").cast("timestamp")))
    return h.select(
        F.col("order_id"), "mime", media.type_of_media(F.col("mime")).alias("resource_type"), media.content_length(F.col("content_length")).alias("bytes"), "retry_after_ms",
        media.retry_delay_ms(F.col("attempt"), F.col("retry_after_ms")).alias("delay_ms"), media.is_retryable(F.col("status")).alias("retryable"),
    )


# -- evidence

_EVIDENCE = {
    "page_id": "page_id",
    "page_url": "url",
    "channel": "CASE k WHEN 0 THEN 'performance' WHEN 1 THEN 'dom-attribute' WHEN 2 THEN 'dom-attribute' WHEN 3 THEN 'dom-attribute' WHEN 4 THEN 'performance' WHEN 5 THEN 'css-ast' WHEN 6 THEN 'css-ast' WHEN 7 THEN 'svg-attribute' ELSE 'performance' END",
    "source_ordinal": "k",
    "value": """CASE k WHEN 0 THEN url WHEN 1 THEN concat('http://img', CAST(page_id % 7 AS STRING), '.example.net/i/p', CAST(page_id % 11 AS STRING), '.png') WHEN 2 THEN 'https://cdn.example.org/app.js'
      WHEN 3 THEN concat('https://frames.example.org/', CAST(page_id % 3 AS STRING)) WHEN 4 THEN 'https://www.google-analytics.com/g' WHEN 5 THEN 'data:text/css;base64,QQ==' WHEN 6 THEN 'https://cdn.example.org/f.woff2'
      WHEN 7 THEN 'http://localhost/x.svg' ELSE concat('http://IMG', CAST(page_id % 7 AS STRING), '.example.net:80/i/p', CAST(page_id % 11 AS STRING), '.png#again') END""",
    "tag": "CASE k WHEN 1 THEN 'img' WHEN 2 THEN 'script' WHEN 3 THEN 'iframe' WHEN 7 THEN 'image' END",
    "attribute": "CASE WHEN k IN (1, 2, 3) THEN 'src' WHEN k = 7 THEN 'href' END",
    "css_kind": "CASE k WHEN 5 THEN 'import' WHEN 6 THEN 'font-face' END",
    "css_property": "CASE k WHEN 6 THEN 'src' END",
    "css_source_type": "CASE WHEN k IN (5, 6) THEN 'style-element' END",
    "initiator": "CASE k WHEN 0 THEN 'navigation' WHEN 4 THEN 'beacon' WHEN 8 THEN 'script' END",
}
_EVIDENCE_SQL = f"""
WITH e AS (SELECT {_sql(_EVIDENCE)}, CASE k WHEN 0 THEN regexp_replace(url, '#.*$', '') WHEN 8 THEN 'http://img' || (page_id % 7) || '.example.net/i/p' || (page_id % 11) || '.png' END AS other
  FROM (SELECT page_id, url, unnest(range(0, 9)) AS k FROM pages)
), n AS (
  SELECT *, coalesce(other, value) AS target, CASE channel WHEN 'dom-attribute' THEN 1 WHEN 'svg-attribute' THEN 2 WHEN 'css-ast' THEN 3 ELSE 4 END AS r FROM e
)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    return evidence.normalised(_derived(pages, _EVIDENCE))


@query(_EVIDENCE_SQL + """, g AS (
  SELECT page_id, target AS url, min(r * 100 + source_ordinal) AS first, count(DISTINCT r * 100 + source_ordinal) AS n_evidence, array_to_string(list_sort(list(DISTINCT r)), ',') AS ranks FROM n GROUP BY ALL
)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY first, url))::INT AS ordinal, url, n_evidence,
  replace(replace(replace(replace(ranks, '1', 'dom-attribute'), '2', 'svg-attribute'), '3', 'css-ast'), '4', 'performance') AS channels
FROM g
""")
def ded_merged_evidence(spark, sf_dir):
    """DED-2, SET-1: evidence of four channels merged by URL (evidence derived from page ids)."""
    return evidence.merged(_evidence(spark, sf_dir)).withColumn("channels", F.array_join("channels", ","))


@query(_EVIDENCE_SQL + "SELECT page_id, target AS target_url, page_url AS source_url, count(*) AS in_degree FROM n GROUP BY ALL")
def grf_in_degrees(spark, sf_dir):
    """GRF-1, AGG-2: edges of the provenance graph by target."""
    return evidence.edges(_evidence(spark, sf_dir)).groupBy("page_id", "target_url", "source_url").agg(F.count(F.lit(1)).alias("in_degree"))


@query("""
WITH p AS (SELECT page_id, page_id % 4 = 0 AS lost, page_id % 7 = 0 AS twice FROM pages)
SELECT page_id, 'ordinals-not-dense' AS fault, CAST(8 - lost::INT + twice::INT AS VARCHAR) AS subject FROM p WHERE lost OR twice
UNION ALL SELECT page_id, 'repeated-node', 'http://img' || (page_id % 7) || '.example.net/i/p' || (page_id % 11) || '.png' FROM p WHERE twice
UNION ALL SELECT page_id, 'dangling-edge', 'https://cdn.example.org/app.js' FROM p WHERE lost
UNION ALL SELECT page_id, 'repeated-edge', 'data:text/css;base64,QQ==' FROM p WHERE page_id % 5 = 0
""")
def grf_faults(spark, sf_dir):
    """GRF-2: what is wrong with graphs of which some pages lost a node or have a node or an edge twice."""
    rows = _evidence(spark, sf_dir)
    nodes, edges = written(evidence.nodes(rows).select("page_id", "ordinal", "url"), "nodes"), written(evidence.edges(rows), "edges")
    bad_nodes = nodes.filter("not (page_id % 4 = 0 and ordinal = 2)").unionByName(nodes.filter("page_id % 7 = 0 and ordinal = 1"))
    return evidence.graph_faults(bad_nodes, edges.unionByName(edges.filter("page_id % 5 = 0 and channel = 'css-ast' and source_ordinal = 5")))


@query(_EVIDENCE_SQL + """
SELECT page_id, target AS url,
  CASE min(source_ordinal) WHEN 0 THEN 'document' WHEN 1 THEN 'image' WHEN 2 THEN 'script' WHEN 3 THEN 'document' WHEN 4 THEN 'other' WHEN 5 THEN 'stylesheet' WHEN 6 THEN 'font' ELSE 'image' END AS resource_type,
  CASE min(source_ordinal) WHEN 0 THEN 'performance-initiator' WHEN 4 THEN NULL WHEN 5 THEN 'data-url-header' WHEN 6 THEN 'css-context' ELSE 'dom-context' END AS type_source,
  CASE min(source_ordinal) WHEN 0 THEN CASE WHEN regexp_matches(target, '^[^?]*\\.html?(\\?|$)') THEN 'text/html' END WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/javascript' WHEN 5 THEN 'text/css' WHEN 6 THEN 'font/woff2' WHEN 7 THEN 'image/svg+xml' END AS mime,
  min(source_ordinal) = 1 AS has_conflict
FROM n GROUP BY page_id, target
""")
def inf_resource_types(spark, sf_dir):
    """INF-1, INF-2, INF-3, FN-7, DED-3: types and media types inferred from ranked hints."""
    return evidence.inferred(_evidence(spark, sf_dir)).select("page_id", "url", "resource_type", "type_source", "mime", "has_conflict")


@query("""
SELECT page_id, pattern, n_origins::BIGINT AS n_origins, n_resources::BIGINT AS n_resources, provenance::BIGINT AS provenance, n_critical::BIGINT AS n_critical, n_excluded::BIGINT AS n_excluded, resource_types, reasons, n_critical > 0 AS default_selected, granted FROM (
  SELECT page_id, 'http://img' || (page_id % 7) || '.example.net/*' AS pattern, 1 AS n_origins, 1 AS n_resources, 2 AS provenance, 1 AS n_critical, 0 AS n_excluded, 'image' AS resource_types, 'critical-resource-type' AS reasons, false AS granted FROM pages
  UNION ALL SELECT page_id, 'https://cdn.example.org/*', 1, 2, 2, 2, 0, 'font,script', 'critical-resource-type', true FROM pages
  UNION ALL SELECT page_id, 'https://frames.example.org/*', 1, 1, 1, 0, 1, 'document', 'iframe-document', false FROM pages
  UNION ALL SELECT page_id, 'https://www.google-analytics.com/*', 1, 1, 1, 0, 1, 'other', 'tracking-runtime', false FROM pages
)
""")
def agg_third_parties(spark, sf_dir):
    """AGG-1, FN-18, FLT-4, FLT-5, FLT-8: third parties of every page by permission pattern."""
    grants = spark.createDataFrame([("https://cdn.example.org/*",)], "pattern string")
    return evidence.third_party(_evidence(spark, sf_dir), grants)


# -- paths

_PATHS_SQL = """
WITH parts AS (
  SELECT regexp_replace(url, '#.*$', '') AS url, regexp_extract(url, '^(https?)') AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
    regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query, url AS given FROM pages
), once AS (
  SELECT url, scheme, host, query, CASE WHEN path LIKE '%.html' THEN 'document' ELSE 'other' END AS resource_type, count(DISTINCT given) AS n_aliases,
    CASE WHEN regexp_extract(path, '([^/]*)$', 1) = '' THEN 'resource' ELSE regexp_extract(path, '([^/]*)$', 1) END AS base_name
  FROM parts GROUP BY ALL
), named AS (
  SELECT *, 'assets/origins/' || scheme || '/dns-' || host || '/default/' || CASE resource_type WHEN 'document' THEN 'documents' ELSE 'other' END AS directory,
    CASE WHEN query = '' THEN NULL ELSE left(sha256(query), 12) END AS query_hash,
    CASE WHEN query = '' THEN base_name ELSE regexp_extract(base_name, '^([^.]*)') || '--q-' || left(sha256(query), 12) || regexp_extract(base_name, '(\\..*)?$') END AS queried
  FROM once
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY lower(directory || '/' || queried)) AS n_same, left(sha256(resource_type || chr(0) || url), 12) AS digits FROM named
)
"""


def _page_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_url(table(spark, sf_dir, "pages").select("url"), "url", "u")
    return pages.select("url", F.coalesce(media.type_of_extension(media.extension_of(F.col("u"))), F.lit("other")).alias("resource_type"))


@query(_PATHS_SQL + """
SELECT url, resource_type, n_aliases, directory, base_name, query_hash, CASE WHEN n_same > 1 THEN digits END AS collision_hash,
  CASE WHEN n_same > 1 THEN regexp_extract(queried, '^([^.]*)') || '--c-' || digits || regexp_extract(queried, '(\\..*)?$') ELSE queried END AS file_name
FROM counted
""")
def pth_page_paths(spark, sf_dir):
    """PTH-1, PTH-2, DED-4, FN-22 to FN-27: an archive path for every page URL, all in one archive."""
    return paths.path_mappings(_page_resources(spark, sf_dir)).drop("path")


@query(_PATHS_SQL + "SELECT host, count(*) AS n_resources, sum(n_aliases)::BIGINT AS n_aliases, count(CASE WHEN n_same > 1 THEN 1 END) AS n_collisions FROM counted GROUP BY host")
def pth_hosts(spark, sf_dir):
    """The flagship: the archive's paths summed up by host."""
    mapped = paths.path_mappings(_page_resources(spark, sf_dir))
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    return mapped.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n_resources"), F.sum("n_aliases").alias("n_aliases"), F.count("collision_hash").alias("n_collisions"))


# -- what a capture leaves out and rewrites

_SECRETS = {
    "page_id": "page_id",
    "value": """CASE page_id % 5 WHEN 0 THEN concat('https://api.example.com/v', CAST(page_id AS STRING), '?token=abc&page=2&apiKey=9#t') WHEN 1 THEN 'data:text/plain,secret'
      WHEN 2 THEN 'blob:https://a.example.com/0-1' WHEN 3 THEN 'ftp://h/x' ELSE 'http://user:pw@example.com/' END""",
}


@query("""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://api.example.com/v' || page_id || '?token=REDACTED&page=2&apiKey=REDACTED' END AS manifest_url,
  CASE page_id % 5 WHEN 0 THEN 'https://api.example.com/v' || page_id || '?token=REDACTED&page=2&apiKey=REDACTED' WHEN 1 THEN 'data:REDACTED' WHEN 2 THEN 'blob:https://a.example.com/REDACTED' WHEN 3 THEN 'ftp:REDACTED' ELSE 'http://REDACTED' END AS report_url
FROM pages
""")
def fn_redacted_urls(spark, sf_dir):
    """FN-16, FN-19, FN-20, FN-21: URLs as manifests and reports may show them."""
    rows = with_url(_derived(table(spark, sf_dir, "pages"), _SECRETS), "value", "u")
    return rows.select("page_id", privacy.redacted_url(F.col("u")).alias("manifest_url"), privacy.diagnostic_url(F.col("u")).alias("report_url"))


@query("""
SELECT page_id, page_id % 6 + page_id % 7 + 2 * (page_id % 2) AS removed, page_id % 6 AS n_extension_injection, page_id % 7 AS n_tracking_runtime, page_id % 2 AS n_payment_runtime, page_id % 2 AS n_nonportable_iframe FROM pages
""")
def agg_cleanup(spark, sf_dir):
    """AGG-5, FN-17, RWR-12: elements that a capture removes, by reason (pages derived from page ids)."""
    return policy.cleanup_counts(elements(_rich_pages(spark, sf_dir)))


@query(_EVIDENCE_SQL + """
, r AS (SELECT page_id, target AS url, min(r * 100 + source_ordinal) AS first, min(source_ordinal) AS k FROM n GROUP BY ALL
), o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY first, url) AS ordinal FROM r)
SELECT page_id AS job_id, page_id || ':document' AS id, url, 'document' AS type, 'queued' AS state FROM pages
UNION ALL
SELECT page_id, page_id || ':resource:' || ordinal, url, CASE k WHEN 0 THEN 'document' WHEN 1 THEN 'image' WHEN 2 THEN 'script' WHEN 3 THEN 'document' WHEN 4 THEN 'other' WHEN 5 THEN 'stylesheet' WHEN 6 THEN 'font' ELSE 'image' END,
  CASE WHEN k IN (0, 3, 4, 5) OR (k = 2 AND page_id % 2 = 0) OR page_id % 3 = 0 THEN 'skipped' ELSE 'queued' END FROM o
""")
def flt_queued_records(spark, sf_dir):
    """FET-12, FLT-2, FLT-3: the records of every page's capture, and which it skips (settings derived from page ids)."""
    rows = _evidence(spark, sf_dir)
    nodes = evidence.nodes(rows).select("page_id", "ordinal", "url", "resource_type", "class.kind", F.lit(False).alias("only_beacons"))
    settings = table(spark, sf_dir, "pages").select(F.col("page_id").alias("job_id"), "page_id", F.col("url").alias("page_url"), (F.col("page_id") % 2 != 0).alias("include_scripts"), F.lit(True).alias("include_media"), (F.col("page_id") % 3 != 0).alias("include_third_party"))
    return policy.queued_records(nodes, settings)


@query("""
SELECT page_id AS text_id, 'p{background:url("../assets/' || (page_id % 5) || '.png")} q{fill:url(/n' || page_id || '.svg)}' AS text, 1::BIGINT AS n_rewritten, 1::BIGINT AS n_unmapped FROM pages
""")
def rwr_css(spark, sf_dir):
    """RWR-1, RWR-5, FN-29, FN-30: style sheets with their saved references replaced (texts derived from page ids)."""
    pages = table(spark, sf_dir, "pages")
    text = F.concat(F.lit("p{background:url(/i/"), (F.col("page_id") % 5).cast("string"), F.lit(".png)} q{fill:url(/n"), F.col("page_id").cast("string"), F.lit(".svg)}"))
    texts = pages.select(F.lit(1).cast("long").alias("job_id"), F.col("page_id").alias("text_id"), F.lit("css/s.css").alias("source_path"), F.lit("https://h.example.com/").alias("base_url"), text.alias("text"))
    saved = spark.range(5).select(F.lit(1).cast("long").alias("job_id"), F.concat(F.lit("https://h.example.com/i/"), F.col("id").cast("string"), F.lit(".png")).alias("url"), F.lit(None).cast("array<string>").alias("aliases"), F.concat(F.lit("assets/"), F.col("id").cast("string"), F.lit(".png")).alias("path"))
    return rewrite.rewrite_css(texts, rewrite.lookup(saved)).drop("job_id")


@query("""
SELECT page_id, replace(replace(html, '<head>', '<head><meta http-equiv="Content-Security-Policy" content="default-src ''self''">'), '<script>', '<script type="application/x-disabled-script">') AS html, 0::BIGINT AS n_rewritten, 0::BIGINT AS n_unmapped FROM pages
""")
def rwr_offline_pages(spark, sf_dir):
    """RWR-2, RWR-3, RWR-7, RWR-9, RWR-11: every page made safe to open offline: policy installed, scripts inert."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.lit(1).cast("long").alias("job_id"), F.lit("index.html").alias("source_path"), F.col("url").alias("base_url"))
    saved = rewrite.lookup(spark.createDataFrame([], "job_id long, url string, aliases array<string>, path string"))
    return offline_pages.rewrite_html(elements(pages), pages, saved, policy="default-src 'self'", freeze_scripts=True).select("page_id", "html", "n_rewritten", "n_unmapped")


#: Each link of a page made into references of every kind; ways of capital letters are saved.
_LINK = r'<a href="(/[^"]*)">'
_LINKED = '<a style="background:url({0})" href="{0}"><img src="{0}" srcset="{0} 1x, /none 2x"><svg><image href="{0}" fill="url({0})"/></svg><style>a{{background:url({0})}}</style><script>fetch("{0}")</script><textarea><img src="{0}"></textarea>'
_LINKED_SAVED = (
    '<a style="background:url(&quot;assets{0}&quot;)" href="{0}"><img src="assets{0}" srcset="assets{0} 1x, /none 2x"><svg><image href="assets{0}" fill="url(&quot;assets{0}&quot;)"/></svg><style>a{{background:url("assets{0}")}}</style>'
    '<script>fetch("./assets{0}")</script><textarea><img src="{0}"></textarea>'
)


@query(f"""
WITH derived AS (
  SELECT page_id, regexp_replace(regexp_replace(html, '<a href="(/[A-Z][A-Za-z]*)">', {_in_sql(_LINKED_SAVED.format(chr(92) + "1"))}, 'g'), '{_LINK}', {_in_sql(_LINKED.format(chr(92) + "1"))}, 'g') AS html,
         len(regexp_extract_all(html, '<a href="/[A-Z][A-Za-z]*">')) AS n, len(regexp_extract_all(html, '{_LINK}')) AS n_links FROM pages
)
SELECT page_id, replace(html, '<head>', '<head>' || {_in_sql(offline_pages.GUARD)} || '<meta http-equiv="Content-Security-Policy" content="default-src ''self''">') AS html,
       2 * n AS n_rewritten, 2 * (n_links - n) AS n_unmapped, n AS n_srcset, 3 * n AS n_css, n AS n_script
FROM derived
""")
def rwr_whole_pages(spark, sf_dir):
    """RWR-1 to RWR-7, RWR-10: references of every kind in every page rewritten at once, with guard and policy (elements are put around the pages' own links)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace("html", _LINK, _LINKED.format("$1")).alias("html"), F.col("page_id").alias("job_id"), F.lit("index.html").alias("source_path"), F.col("url").alias("base_url"))
    ways = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array_distinct(F.expr("""regexp_extract_all(html, '<a href="(/[A-Z][A-Za-z]*)">', 1)"""))).alias("way"))
    saved = ways.select(F.col("page_id").alias("job_id"), F.concat(F.regexp_extract("url", "^https?://[^/?#]*", 0), "way").alias("url"), F.lit(None).cast("array<string>").alias("aliases"), F.concat(F.lit("assets"), "way").alias("path"))
    return offline_pages.rewrite_html(elements(pages), pages, rewrite.lookup(saved), policy="default-src 'self'", guard=True)


# -- fetches

_ATTEMPTS = {
    "resource_id": "CAST(floor(event_id / 4) AS BIGINT)",
    "attempt": "CAST(1 + event_id % 4 AS BIGINT)",
    "status": "CASE (event_id * 7 + user_id) % 6 WHEN 0 THEN 200 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 500 ELSE 204 END",
    "timed_out": "(event_id + user_id) % 9 = 0",
    "thrown": "(event_id + user_id) % 17 = 0",
    "retry_after_ms": "CASE WHEN user_id % 3 = 0 THEN CAST(1000 * (user_id % 40) AS BIGINT) END",
}


@query(f"""
WITH a AS (SELECT {_sql(_ATTEMPTS)} FROM events), j AS (
  SELECT *, NOT timed_out AND NOT thrown AND status BETWEEN 200 AND 299 AS good, NOT thrown AND (timed_out OR status IN (408, 425, 429, 500, 502, 503, 504)) AS again FROM a
), l AS (
  SELECT *, min(CASE WHEN good OR NOT again OR attempt > 2 THEN attempt END) OVER (PARTITION BY resource_id) AS last FROM j
), u AS (
  SELECT *, CASE WHEN attempt < last OR last IS NULL THEN least(30000, greatest(500 * 2 ** (attempt - 1), coalesce(retry_after_ms, 0)))::BIGINT ELSE 0 END AS delay FROM l WHERE last IS NULL OR attempt <= last
), s AS (
  SELECT resource_id, max(attempt) AS attempts, arg_max(good, attempt) AS good, arg_max(again, attempt) AS again, arg_max(status, attempt) AS status, arg_max(timed_out, attempt) AS timed, max(last) AS last, sum(delay)::BIGINT AS delay_ms FROM u GROUP BY resource_id
)
SELECT resource_id, attempts, CASE WHEN good THEN 'succeeded' WHEN last IS NULL THEN 'pending' ELSE 'failed' END AS outcome, CASE WHEN NOT timed THEN status END AS status,
  NOT good AND last IS NOT NULL AND again AS exhausted, NOT good AND last IS NOT NULL AND timed AS timed_out, delay_ms FROM s
""")
def fet_retries(spark, sf_dir):
    """FET-3, FET-7: recorded attempts replayed under the retry rule (attempts derived from events)."""
    return fetch.retry_outcomes(_derived(table(spark, sf_dir, "events"), _ATTEMPTS))


_SIZES = {"job_id": "o_custkey % 100", "index": "o_orderkey", "bytes": "CAST(floor(o_totalprice) AS BIGINT)"}


@query(f"""
WITH RECURSIVE r AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY index) AS n FROM (SELECT {_sql(_SIZES).replace("AS index", "AS index")} FROM orders)
), f AS (
  SELECT job_id, 0::BIGINT AS n, 0::BIGINT AS index, 0::BIGINT AS bytes, 0::BIGINT AS used, '' AS outcome FROM (SELECT DISTINCT job_id FROM r)
  UNION ALL
  SELECT r.job_id, r.n, r.index, r.bytes, f.used + CASE WHEN r.bytes <= 400000 AND f.used + r.bytes <= 5000000 THEN r.bytes ELSE 0 END,
    CASE WHEN r.bytes > 400000 THEN 'file-limit' WHEN f.used + r.bytes > 5000000 THEN 'total-limit' ELSE 'saved' END
  FROM f JOIN r ON r.job_id = f.job_id AND r.n = f.n + 1
)
SELECT job_id, index, bytes, outcome FROM f WHERE n > 0
""")
def fet_byte_budget(spark, sf_dir):
    """FET-4, FET-5, STA-6: what fits a job's byte budget, in order (sizes derived from orders)."""
    return fetch.within_budget(_derived(table(spark, sf_dir, "orders"), _SIZES), 400_000, 5_000_000)


_RESULTS = {
    "job_id": "l_orderkey",
    "state": "CASE l_partkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'aborted' WHEN 2 THEN 'not-started' ELSE 'saved' END",
    "bytes": "CASE WHEN l_partkey % 7 > 2 THEN CAST(floor(l_extendedprice) AS BIGINT) END",
    "is_primary": "l_linenumber = 1",
    "interruption": "CASE WHEN l_suppkey % 29 = 0 THEN 'cancel' WHEN l_suppkey % 31 = 0 THEN 'pause' END",
}


@query(f"""
WITH r AS (SELECT {_sql(_RESULTS)} FROM lineitem)
SELECT job_id, count(CASE WHEN state = 'saved' THEN 1 END) AS n_saved, count(CASE WHEN state = 'failed' THEN 1 END) AS n_failed, count(CASE WHEN state = 'aborted' THEN 1 END) AS n_aborted,
  count(CASE WHEN state = 'not-started' THEN 1 END) AS n_not_started, sum(CASE WHEN state = 'saved' THEN bytes ELSE 0 END)::BIGINT AS saved_bytes,
  CASE WHEN bool_or(is_primary AND state = 'failed') THEN 'failed' WHEN bool_or(coalesce(interruption = 'cancel', false)) THEN 'cancelled' WHEN bool_or(coalesce(interruption = 'pause', false)) THEN 'paused'
    WHEN count(CASE WHEN state <> 'saved' THEN 1 END) > 0 THEN 'completed-with-errors' ELSE 'completed' END AS status
FROM r GROUP BY job_id
""")
def fet_batches(spark, sf_dir):
    """AGG-3, AGG-4, FET-9: counts and status of download batches (results derived from lineitem)."""
    return fetch.batch_summaries(_derived(table(spark, sf_dir, "lineitem"), _RESULTS))


_RECORDS = {
    "job_id": "o_custkey % 50",
    "id": "concat('job:resource:', CAST(o_orderkey AS STRING))",
    "is_primary": "o_orderkey % 40 = 0",
    "state": "CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'saved' END",
    "original_url": "concat('https://h', CAST(o_custkey % 9 AS STRING), '.example.com/r', CAST(o_orderkey % 60 AS STRING))",
    "final_url": "CASE WHEN o_orderkey % 3 = 0 THEN concat('https://H', CAST(o_custkey % 9 AS STRING), '.example.com:443/r', CAST(o_orderkey % 20 AS STRING), '#f') WHEN o_orderkey % 97 = 0 THEN 'https://bad host/' END",
    "bytes": "CAST(floor(o_totalprice) AS BIGINT)",
    "path": "concat('assets/r', CAST(o_orderkey % 60 AS STRING), CASE WHEN o_orderkey % 4 = 0 THEN '.css' WHEN o_orderkey % 4 = 1 THEN '.html' ELSE '.png' END)",
}


@query(f"""
WITH r AS (SELECT {_sql(_RECORDS)}, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'https://h' || (o_custkey % 9) || '.example.com/r' || (o_orderkey % 20) WHEN o_orderkey % 97 = 0 THEN NULL
    ELSE 'https://h' || (o_custkey % 9) || '.example.com/r' || (o_orderkey % 60) END AS ended FROM orders
), t AS (
  SELECT *, state = 'saved' AND NOT is_primary AS take FROM r
), w AS (
  SELECT *, take AND ended IS NULL AS bad, CASE WHEN take THEN ended END AS k FROM t
), n AS (
  SELECT *, row_number() OVER (PARTITION BY job_id, k ORDER BY id) AS rn FROM w
)
SELECT job_id, id, CASE WHEN bad OR (k IS NOT NULL AND rn > 1) THEN 'failed' ELSE state END AS state,
  CASE WHEN bad THEN 'final-url' WHEN k IS NOT NULL AND rn > 1 THEN 'duplicate-final-url' END AS error FROM n
""")
def ded_reconciled(spark, sf_dir):
    """DED-5: records that ended at one URL become one (records derived from orders)."""
    records = _derived(table(spark, sf_dir, "orders"), _RECORDS).withColumn("sources", F.array(F.lit("dom")))
    return fetch.reconciled(records).drop("sources")


_TRACES = {
    "resource_id": "o_orderkey",
    "original_url": "'https://a.example.com/'",
    "final_url": "CASE o_orderkey % 7 WHEN 3 THEN 'https://z.example.com/' ELSE 'https://c.example.com/' END",
    "complete": "o_orderkey % 7 <> 5",
    "b": "CASE o_orderkey % 7 WHEN 1 THEN 'http://192.168.0.1/' WHEN 2 THEN 'https://denied.example.org/' ELSE 'https://b.example.com/' END",
    "second": "CASE o_orderkey % 7 WHEN 4 THEN 'https://gap.example.com/' ELSE 'same' END",
}


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _derived(table(spark, sf_dir, "orders"), _TRACES)
    hop = lambda a, b: F.struct(a.alias("from_url"), b.alias("to_url"))
    return t.withColumn("hops", F.array(hop(F.col("original_url"), F.col("b")), hop(F.when(F.col("second") == "same", F.col("b")).otherwise(F.col("second")), F.lit("https://c.example.com/"))))


@query("SELECT o_orderkey AS resource_id, CASE o_orderkey % 7 WHEN 3 THEN 'wrong-end' WHEN 4 THEN 'gap' WHEN 5 THEN 'hops-of-an-incomplete-trace' END AS fault FROM orders")
def fet_redirect_faults(spark, sf_dir):
    """FET-6, SNK-2: continuity of redirect traces (traces derived from orders)."""
    return fetch.redirect_faults(_traces(spark, sf_dir))


@query("""
SELECT o_orderkey AS resource_id, CASE WHEN o_orderkey % 7 = 3 THEN 'final' ELSE 'redirect' END AS stage, CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE 0 END::INT AS redirect_index,
  CASE o_orderkey % 7 WHEN 1 THEN 'local-network' ELSE 'permission-denied' END AS reason
FROM orders WHERE o_orderkey % 7 IN (1, 2, 3)
""")
def flt_blocked_responses(spark, sf_dir):
    """FLT-6: the first URL of a response's way that policy blocks."""
    grants = spark.createDataFrame([(f"https://{h}.example.com/*",) for h in "abc"], "pattern string")
    return fetch.blocked_responses(_traces(spark, sf_dir), grants)


# -- jobs

_STEPS = ("preparing", "discovering", "fetching", "rewriting", "packaging", "completed", "paused", "fetching", "cancelling", "cancelled", "failed", "retrying")
_JOB_EVENTS = {
    "job_id": "user_id",
    "seq": "event_id",
    "wanted": "CASE (event_id * 5 + user_id) % 12 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(_STEPS)) + " END",
}
_ALLOWED = " OR ".join(f"(f.status = '{k}' AND r.wanted IN ({', '.join(repr(x) for x in v)}))" for k, v in jobs.TRANSITIONS.items() if v)


@query(f"""
WITH RECURSIVE r AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM (SELECT {_sql(_JOB_EVENTS)} FROM events)
), f AS (
  SELECT job_id, 0::BIGINT AS n, 'idle' AS status, NULL::VARCHAR AS resume_status, 0 AS n_applied, 0 AS n_rejected FROM (SELECT DISTINCT job_id FROM r)
  UNION ALL
  SELECT job_id, n, CASE WHEN good THEN wanted ELSE status END, CASE WHEN NOT good THEN resume_status WHEN wanted = 'paused' THEN status END, n_applied + good::INT, n_rejected + (NOT good)::INT FROM (
    SELECT f.job_id, r.n, f.status, f.resume_status, f.n_applied, f.n_rejected, r.wanted,
      CASE WHEN f.status = 'paused' THEN r.wanted = 'cancelling' OR r.wanted IS NOT DISTINCT FROM f.resume_status ELSE ({_ALLOWED}) END AS good
    FROM f JOIN r ON r.job_id = f.job_id AND r.n = f.n + 1)
)
SELECT job_id, arg_max(status, n) AS status, arg_max(resume_status, n) FILTER (n = m) AS resume_status, arg_max(n_applied, n) AS n_applied, arg_max(n_rejected, n) AS n_rejected
FROM (SELECT *, max(n) OVER (PARTITION BY job_id) AS m FROM f) WHERE n = m GROUP BY job_id
""")
def sta_job_replay(spark, sf_dir):
    """STA-1, STA-4: job states folded from events (wanted states derived from events)."""
    return jobs.replay(_derived(table(spark, sf_dir, "events"), _JOB_EVENTS))


@query("SELECT o_orderkey AS id, o_orderdate AS updated_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def topk_job_history(spark, sf_dir):
    """TOPK-1, SRC-7: the jobs that changed last (a report of twenty)."""
    return jobs.history(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at")))


@query(f"""
WITH r AS (SELECT {_sql(_RECORDS)} FROM orders), k AS (
  SELECT job_id, original_url AS url, path AS type, row_number() OVER (PARTITION BY job_id ORDER BY is_primary DESC, original_url, path, id) AS rank, count(*) OVER (PARTITION BY job_id) AS n FROM r WHERE state = 'failed'
)
SELECT job_id, rank::INT AS rank, url, type, greatest(n - 10, 0) AS n_omitted FROM k WHERE rank <= 10
""")
def topk_failures(spark, sf_dir):
    """TOPK-2, RES-1: the first ten failures of each job, and how many more there are."""
    records = _derived(table(spark, sf_dir, "orders"), _RECORDS)
    return jobs.failures(records.select("job_id", "id", "state", F.col("is_primary").alias("is_primary_visual"), F.col("original_url").alias("url"), F.col("path").alias("type")), most=10)


@query("""
WITH s AS (SELECT CAST(floor(event_id / 3) AS BIGINT) AS session_id, (event_id * 13 + user_id) % 9000 AS at_ms, CASE event_type WHEN 'click' THEN 'result' WHEN 'view' THEN 'navigation' WHEN 'error' THEN 'tab-closed' ELSE 'other' END AS kind FROM events),
f AS (SELECT session_id, min(CASE WHEN kind <> 'other' AND at_ms < 6000 THEN at_ms * 10 + CASE kind WHEN 'navigation' THEN 0 WHEN 'result' THEN 1 ELSE 2 END END) AS f FROM s GROUP BY session_id)
SELECT session_id, CASE WHEN f IS NULL THEN 'timeout' WHEN f % 10 = 0 THEN 'navigation' WHEN f % 10 = 1 THEN 'result' ELSE 'tab-closed' END AS outcome, CASE WHEN f IS NULL THEN 6000 ELSE f // 10 END AS at_ms FROM f
""")
def sta_session_outcomes(spark, sf_dir):
    """STA-5: which of result, navigation, closing and time-out came first (sessions of three events, derived from their ids)."""
    rows = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "result").when(F.col("event_type") == "view", "navigation").when(F.col("event_type") == "error", "tab-closed").otherwise("other")
    return jobs.session_outcomes(rows.select(F.expr("CAST(floor(event_id / 3) AS BIGINT)").alias("session_id"), ((F.col("event_id") * 13 + F.col("user_id")) % 9000).alias("at_ms"), kind.alias("kind")), wait_ms=1000)


# -- archives


@query(f"""
WITH r AS (SELECT {_sql(_RECORDS)} FROM orders)
SELECT job_id, CASE state WHEN 'saved' THEN 'resources' WHEN 'failed' THEN 'failures' ELSE 'skipped' END AS manifest, count(*) AS n, sum(CASE WHEN state = 'saved' THEN bytes ELSE 0 END)::BIGINT AS bytes FROM r GROUP BY job_id, state
""")
def snk_manifest_totals(spark, sf_dir):
    """SNK-1, SNK-3, AGG-10: records by manifest, with totals."""
    return archives.manifest_rows(_derived(table(spark, sf_dir, "orders"), _RECORDS))


@query(f"""
WITH r AS (SELECT {_sql(_RECORDS)} FROM orders), o AS (SELECT DISTINCT job_id, original_url, coalesce(final_url, '') AS final_url, path FROM r WHERE state = 'saved')
SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY original_url, final_url, path)::INT AS position FROM o
""")
def snk_original_urls(spark, sf_dir):
    """DED-7, SORT-1: the map of original URLs of every job."""
    return archives.original_urls(_derived(table(spark, sf_dir, "orders"), _RECORDS))


@query(f"""
WITH r AS (SELECT DISTINCT job_id, path FROM (SELECT {_sql(_RECORDS)} FROM orders))
SELECT job_id, CASE WHEN path LIKE '%.html' THEN 'documents' WHEN path LIKE '%.css' THEN 'stylesheets' ELSE 'assets' END AS area, count(*) AS n FROM r GROUP BY ALL
""")
def agg_entry_counts(spark, sf_dir):
    """AGG-11, SNK-5: archive entries by area."""
    return archives.entry_counts(_derived(table(spark, sf_dir, "orders"), _RECORDS).select("job_id", "path").distinct())


_REFERENCES = {
    "job_id": "l_orderkey % 200",
    "source_path": "'pages/deep/index.html'",
    "value": """CASE l_partkey % 10 WHEN 0 THEN '../../assets/a.png' WHEN 1 THEN '../../assets/none.png?x#y' WHEN 2 THEN '#top' WHEN 3 THEN '' WHEN 4 THEN concat('https://x.example.com/', CAST(l_suppkey % 5 AS STRING))
      WHEN 5 THEN 'data:,' WHEN 6 THEN 'mailto:a@b' WHEN 7 THEN '/assets/a.png' WHEN 8 THEN 'chrome-extension://id/x.js' ELSE '../../../assets/a.png' END""",
}


@query(f"""
WITH r AS (SELECT {_sql(_REFERENCES)}, l_partkey % 10 AS k FROM lineitem)
SELECT job_id, count(CASE WHEN k = 0 THEN 1 END) AS n_local_present, count(CASE WHEN k IN (1, 7, 9) THEN 1 END) AS n_local_missing, count(CASE WHEN k = 4 THEN 1 END) AS n_external,
  count(CASE WHEN k = 8 THEN 1 END) AS n_extension, count(CASE WHEN k = 5 THEN 1 END) AS n_embedded, count(CASE WHEN k = 2 THEN 1 END) AS n_fragment, count(CASE WHEN k = 6 THEN 1 END) AS n_unsupported,
  count(CASE WHEN k = 3 THEN 1 END) AS n_invalid, count(DISTINCT CASE WHEN k = 4 THEN value END) AS n_external_urls, count(CASE WHEN k NOT IN (0, 2, 5) THEN 1 END) = 0 AS passed
FROM r GROUP BY job_id
""")
def aud_offline_integrity(spark, sf_dir):
    """AUD-1, AUD-2, AGG-12, EXT-10: references of archives against their entries (derived from lineitem)."""
    rows = _derived(table(spark, sf_dir, "lineitem"), _REFERENCES)
    entries = rows.select("job_id").distinct().withColumn("path", F.lit("assets/a.png"))
    return archives.audit_summary(archives.audited(rows, entries))


@query(f"""
WITH r AS (SELECT {_sql(_RECORDS)} FROM orders), refs AS (
  SELECT job_id, CASE WHEN bytes % 2 = 0 THEN 'html' ELSE 'css' END AS channel, original_url AS url, state FROM r
), summed AS (
  SELECT job_id, url, count(*) AS n, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels, bool_or(state = 'saved') AS saved, bool_or(state = 'failed') AS failed, bool_or(state = 'skipped') AS skipped FROM refs GROUP BY ALL
)
SELECT job_id, url, n, channels, CASE WHEN failed THEN 'failed' WHEN skipped THEN 'skipped' ELSE 'missing' END AS reason FROM summed WHERE NOT saved
""")
def agg_uncaptured(spark, sf_dir):
    """AGG-6, AGG-8, RWR-1: references to what was not saved, by URL."""
    records = _derived(table(spark, sf_dir, "orders"), _RECORDS)
    channel = F.when(F.col("bytes") % 2 == 0, "html").otherwise("css")
    by_url = records.select("job_id", channel.alias("channel"), F.col("original_url").alias("value"))
    states = records.select("job_id", F.col("original_url").alias("url"), "state")
    return archives.uncaptured(by_url, states.filter("state = 'saved'"), states)


@query(f"""
WITH r AS (SELECT {_sql(_RECORDS)}, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'code' || (o_orderkey % 2) END AS error,
    CASE WHEN o_orderkey % 3 = 0 THEN 'https://h' || (o_custkey % 9) || '.example.com/r' || (o_orderkey % 20) END AS ended FROM orders
), said AS (
  SELECT job_id, url, list(DISTINCT state) AS states, list_sort(list(DISTINCT error) FILTER (error IS NOT NULL)) AS codes FROM (SELECT job_id, state, error, original_url AS url FROM r UNION ALL SELECT job_id, state, error, ended FROM r WHERE ended IS NOT NULL) GROUP BY ALL
), refs AS (
  SELECT job_id, original_url AS url, ['html-attribute', 'css-ast', 'srcset'][(o_orderkey % 3 + 1)::INT] AS channel, (o_orderkey % 3 + 1)::INT AS rank, 'pages/' || (o_orderkey % 4) || '.html' AS source_path, o_orderkey AS element_no, o_orderkey % 2 AS part FROM r
), missing AS (
  SELECT f.* FROM refs f LEFT JOIN said s ON s.job_id = f.job_id AND s.url = f.url AND list_contains(s.states, 'saved') WHERE s.url IS NULL
), summed AS (
  SELECT job_id, url, count(*) AS n, array_to_string(list_filter(['html-attribute', 'css-ast', 'srcset'], lambda c: list_contains(list(channel), c)), ',') AS channels,
    array_to_string(list_transform((list({{'r': rank, 'p': source_path, 'e': element_no, 'c': channel}} ORDER BY rank, source_path, element_no, part))[1:3], lambda s: s.c || ' ' || s.p || ' ' || s.e), ',') AS sources
  FROM missing GROUP BY ALL
)
SELECT m.job_id, m.url, CASE WHEN list_contains(states, 'failed') THEN 'download-failed' WHEN list_contains(states, 'skipped') THEN 'resource-skipped' ELSE 'missing-mapping' END AS reason, n, channels,
  array_to_string(list_filter(['failed', 'skipped'], lambda x: list_contains(states, x)), ',') AS states, coalesce(array_to_string(codes, ','), '') AS error_codes, sources
FROM summed m LEFT JOIN said USING (job_id, url)
""")
def agg_dependencies(spark, sf_dir):
    """AGG-6, AGG-8, SORT-3: what was not saved, with the states and error codes of both its URLs and its first three sources (records derived from orders)."""
    orders = table(spark, sf_dir, "orders")
    records = orders.selectExpr(*[f"{e} AS {c}" for c, e in _RECORDS.items()], "CASE WHEN o_orderkey % 5 = 0 THEN concat('code', CAST(o_orderkey % 2 AS STRING)) END AS error", "o_orderkey")
    channel = F.try_element_at(F.array(*map(F.lit, archives.CHANNELS)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    references = records.select("job_id", channel.alias("channel"), F.concat(F.lit("pages/"), (F.col("o_orderkey") % 4).cast("string"), F.lit(".html")).alias("source_path"), F.col("o_orderkey").alias("element_no"), (F.col("o_orderkey") % 2).alias("part"), F.lit("src").alias("name"), F.col("original_url").alias("value"))
    found = archives.dependencies(references, records, most=3)
    shown = F.transform("sources", lambda s: F.concat_ws(" ", s["channel"], s["source_path"], s["element_no"].cast("string")))
    return found.select("job_id", "url", "reason", "n", *[F.array_join(c, ",").alias(c) for c in ("channels", "states", "error_codes")], F.array_join(shown, ",").alias("sources"))


@query("""
WITH c AS (SELECT page_id AS file_id, html, unnest(range(0, greatest(strlen(html), 1), 1000)) AS "offset" FROM pages)
SELECT file_id, "offset"::INT AS "offset", least(1000, strlen(html) - "offset")::INT AS n_bytes, "offset" + 1000 >= strlen(html) AS is_last FROM c
""")
def chunk_transfer(spark, sf_dir):
    """CHUNK-1, FN-38: pages cut in pieces of 1,000 bytes for transfer."""
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.encode("html", "UTF-8").alias("data"))
    return archives.chunks(files, 1000).select("file_id", "offset", F.octet_length("data").alias("n_bytes"), "is_last")


@query("""
SELECT page_id % 10 AS job_id, 'pages/' || page_id || '.html' AS path, strlen(html) AS bytes, sha256(html) AS sha256 FROM pages
""")
def snk_zip_round_trip(spark, sf_dir):
    """SNK-4, SNK-6, SRC-5, FN-26, FN-28: pages packed into archives, read back and hashed; every CRC agrees."""
    pages = table(spark, sf_dir, "pages")
    entries = pages.select((F.col("page_id") % 10).alias("job_id"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("data"))
    back = archives.unzipped(archives.zipped(entries)).filter(F.crc32("data") == F.col("crc32"))
    return back.select("job_id", "path", F.octet_length("data").cast("long").alias("bytes"), F.sha2("data", 256).alias("sha256"))


# -- timings, scripts, reports, stores

_TIMINGS = {
    "page_id": "user_id",
    "name": "concat('https://T', CAST(event_id % 12 AS STRING), '.example.com:443/a#', CAST(event_id AS STRING))",
    "entry_type": "CASE WHEN event_id % 10 = 0 THEN 'mark' ELSE 'resource' END",
    "initiator_type": "CASE event_id % 4 WHEN 0 THEN ' IMG ' WHEN 1 THEN 'fetch' WHEN 2 THEN 'unheard' ELSE 'css' END",
    "start_ms": "CASE WHEN event_id % 13 = 0 THEN -1.0e0 ELSE value END",
    "duration_ms": "CAST(event_id % 100 AS DOUBLE)",
    "transfer_size": "event_id",
    "encoded_size": "event_id",
    "decoded_size": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id END",
}


@query(f"""
WITH t AS (SELECT {_sql(_TIMINGS)}, CASE event_id % 4 WHEN 0 THEN 'img' WHEN 1 THEN 'fetch' WHEN 2 THEN 'other' ELSE 'css' END AS initiator, 'https://t' || (event_id % 12) || '.example.com/a' AS url FROM events),
n AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY start_ms, initiator, duration_ms, transfer_size) AS rn FROM t WHERE entry_type = 'resource' AND start_ms >= 0 AND decoded_size IS NOT NULL
)
SELECT page_id, url, initiator, start_ms, duration_ms, transfer_size, encoded_size, decoded_size FROM n WHERE rn = 1
""")
def ded_timings(spark, sf_dir):
    """DED-1, FLT-1, FN-4, FN-5, SRC-3: the first valid timing of each URL (timings derived from events)."""
    return timing.first_timings(_derived(table(spark, sf_dir, "events"), _TIMINGS))


@query("""
SELECT page_id AS job_id, 'https://s.example.com/a' || (page_id % 3) || '.js' AS url, 1 AS round FROM pages
UNION ALL SELECT page_id, 'https://s.example.com/lib/x.wasm', 2 FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'https://s.example.com/a2.js', 2 FROM pages WHERE page_id % 3 = 1
UNION ALL SELECT page_id, 'https://s.example.com/img/p.png', 3 FROM pages WHERE page_id % 3 = 1
UNION ALL SELECT page_id, 'https://s.example.com/img/p.png', 2 FROM pages WHERE page_id % 3 = 2
""")
def fet_script_closure(spark, sf_dir):
    """FET-11, EXT-8, DED-9: what scripts lead to, round by round (scripts derived from page ids)."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("job_id"))
    start = pages.select("job_id", F.lit("https://s.example.com/main.js").alias("url"), F.concat(F.lit("import './a"), (F.col("job_id") % 3).cast("string"), F.lit(".js'; // './no.js'")).alias("text"))
    bodies = ("fetch('lib/x.wasm'); import('./a0.js')", 'import y from "./a2.js"', 'i.src = "/img/p.png"')
    found = pages.select("job_id", F.posexplode(F.array(*map(F.lit, bodies))).alias("k", "text")).select("job_id", F.concat(F.lit("https://s.example.com/a"), F.col("k").cast("string"), F.lit(".js")).alias("url"), "text")
    return fetch.script_closure(start, found)


_CHANGES = {
    "job_id": "l_orderkey % 100",
    "document_path": "concat('pages/', CAST(l_suppkey % 7 AS STRING), '.html')",
    "kind": "CASE l_partkey % 4 WHEN 0 THEN 'base-removal' WHEN 1 THEN 'css-source-rewrite' WHEN 2 THEN 'csp-policy-adjustment' ELSE 'html-reference-rewrite' END",
    "element_no": "l_orderkey",
    "part": "l_linenumber",
}


@query(f"""
WITH c AS (SELECT {_sql(_CHANGES)}, CASE l_partkey % 4 WHEN 0 THEN 1 WHEN 3 THEN 2 WHEN 1 THEN 4 ELSE 10 END AS r FROM lineitem)
SELECT job_id, document_path, kind, count(*) AS n, min(sequence)::BIGINT AS first, max(sequence)::BIGINT AS last
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY document_path, r) AS sequence FROM c) GROUP BY ALL
""")
def snk_change_sequences(spark, sf_dir):
    """SNK-9, AGG-9: changes of archives in their order, by document and kind (changes derived from lineitem)."""
    rows = reports.sequenced(_derived(table(spark, sf_dir, "lineitem"), _CHANGES))
    return rows.groupBy("job_id", "document_path", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("sequence").cast("long").alias("first"), F.max("sequence").cast("long").alias("last"))


_MESSAGES = {
    "page_id": "page_id",
    "name": "CASE page_id % 3 WHEN 0 THEN 'TypeError' WHEN 1 THEN 'RangeError' ELSE 'DOMException' END",
    "message": "CASE page_id % 4 WHEN 0 THEN 'Bad MIME in manifest' WHEN 1 THEN 'Manifest of zip' WHEN 2 THEN 'the archive path' ELSE NULL END",
    "code": "CASE page_id % 3 WHEN 0 THEN 'tab-closed' WHEN 1 THEN 'storage-conflict' ELSE 'never heard of' END",
}


@query(f"""
WITH m AS (SELECT {_sql(_MESSAGES)}, html FROM pages)
SELECT page_id, CASE WHEN name = 'DOMException' THEN 'Error' ELSE name END || '.' || CASE page_id % 4 WHEN 0 THEN 'MimeType' WHEN 1 THEN 'Manifest' WHEN 2 THEN 'ArchivePath' ELSE 'Unknown' END AS category, code <> 'tab-closed' AS retryable,
  CASE WHEN strlen(html) < 1024 THEN strlen(html) || ' B' ELSE format('{{:.1f}} KiB', round(strlen(html) / 1024, 1)) END AS size, 'page-' || page_id || '-20240103.zip' AS file_name
FROM m
""")
def fn_report_texts(spark, sf_dir):
    """FN-34, FN-36, FN-37, FN-39: error categories, size labels and file names of reports."""
    rows = table(spark, sf_dir, "pages").select(F.octet_length("html").alias("bytes"), *[F.expr(e).alias(c) for c, e in _MESSAGES.items()])
    name = text.archive_file_name(F.lit(""), "page", F.concat(F.lit("www."), F.col("page_id").cast("string")), F.lit("2024-01-03").cast("date"))
    return rows.select("page_id", text.package_fault(F.col("name"), F.col("message")).alias("category"), text.is_retryable_error(F.col("code")).alias("retryable"), text.byte_label(F.col("bytes")).alias("size"), name.alias("file_name"))


@query(f"""
WITH r AS (SELECT {_sql(_RECORDS)} FROM orders)
SELECT job_id, id, state FROM r WHERE job_id >= 10 UNION ALL SELECT job_id, 'new', 'queued' FROM r WHERE job_id < 10 GROUP BY job_id
""")
def sto_replaced_records(spark, sf_dir):
    """STO-1, STO-2: the records of ten jobs replaced, all others kept."""
    records = _derived(table(spark, sf_dir, "orders"), _RECORDS).select("job_id", "id", "state")
    new = records.filter("job_id < 10").select("job_id").distinct().select("job_id", F.lit("new").alias("id"), F.lit("queued").alias("state"))
    return store.replaced(records, new)
