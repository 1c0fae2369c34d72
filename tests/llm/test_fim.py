import hashlib
import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftarc.llm import fim, queries

SCHEMA = "doc_id long, text string, n string, output long"
TEXTS = ["", None, "one", "a\nb\nc\n", "\n\n", "x <P> y\nz", "<S", "<\n<S\n<M\nP>\n", "ä\U0001f600\n é\r\n\x0b\x85 z\n", "no end\nhere", "same\ntext\n", "same\ntext\n", "lang\n" * 50_000]


def brute(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 100:
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_brute_force(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS * 4)] + [(None, "a\nb", None, None), (3, "\n", "", 0), (3, "\n", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, (tuple(r)[:-1] for r in got))) == sorted(repr((i, *brute(i, t))) for i, t, *_ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sorted(map(repr, ((r.doc_id, r.back) for r in got))) == sorted(repr((i, t or "")) for i, t, *_ in rows)


def test_an_empty_table_and_other_rates(spark):
    docs = spark.createDataFrame([(i, f"w{i} x\ny") for i in range(400)], "doc_id long, text string")
    assert fim.transform(docs.limit(0)).count() == 0
    forms = {r.form: r["count"] for r in fim.transform(docs, rate=50, spm_rate=0).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 140 < forms["plain"] < 260


@given(text=st.text(st.sampled_from("ab \n\t\r\x0b\x85é\U0001f600"), max_size=40))
def test_units(text):
    points = fim.code_points(text)
    pieces = lambda units: [fim.encoded(p) for p in np.split(points, fim.unit_ends(points, units)[:-1])] if text else []
    assert pieces("line") == re.findall(r"[^\n]*\n|[^\n]+", text)
    assert pieces("char") == list(text)
    assert pieces("word") == re.findall(r"[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+|$))|[\x20\x09-\x0D]+$", text) or re.match(r"[\x20\x09-\x0D]", text)
    assert "".join(pieces("word")) == text


def test_the_query_against_brute_force(spark):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = [(i, *b[:4], digest(b[4]), digest(t or "")) for i, t, b in ((d.doc_id, d.text, brute(d.doc_id, d.text)) for d in docs)]
    got = queries.op12_fill_in_middle(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
