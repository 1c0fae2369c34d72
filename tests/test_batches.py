import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftarc.functions.batches import each, handed_on, pieces
from weftarc.functions.urls import parsed
from weftarc.operators.rewrite import spliced
from weftarc.sources.html import elements, elements_in_turn, elements_of

PAGE = "<title>t</title><style>p{margin:0}</style><ul>" + '<li class="x"><a href="/way">word</a></li>' * 100


def test_pieces_have_all_rows_in_order():
    columns = pa.array(["a" * 10, None, "b" * 5000, "", "c"] * 50), pa.array([None, "d", None, None, "e"] * 50, pa.large_string())
    found = list(pieces(columns, 1000))
    assert [at for at, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))] and sum(n for _, n in found) == 250
    assert len(found) >= 50
    for rows in (columns, tuple(c.slice(3, 100) for c in columns), tuple(c.slice(0, 0) for c in columns)):
        assert each(lambda a, b: f"{a}{b}", pa.string(), *rows).to_pylist() == [f"{a}{b}" for a, b in zip(*(c.to_pylist() for c in rows), strict=True)]


@pytest.mark.parametrize(
    ("of", "columns", "most"),
    [
        (elements_of.func, (pa.array([PAGE] * 240),), 20),
        (parsed.func, (pa.array(["https://example.org/some/way?query=1"] * 8000), pa.nulls(8000, pa.string())), 3),
    ],
)
def test_a_batch_is_not_held_as_python_values(of, columns, most):
    """Megabytes at once, without Arrow's own."""
    of(*(c.slice(0, 10) for c in columns))
    tracemalloc.start()
    assert len(of(*columns)) == len(columns[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < most << 20, peak >> 20


def test_what_is_handed_on_is_the_same():
    columns = pa.array(["a" * 10, None, "b" * 300_000, "", "c"] * 20), pa.array([None, "d", None, None, "e"] * 20, pa.large_string())
    batches = [columns, tuple(c.slice(0, 0) for c in columns), tuple(c.slice(3, 50) for c in columns)]
    of = lambda a, b: f"{a}{b}"
    done = list(handed_on(of, pa.string(), iter(batches)))
    assert len(done) > 10 and pa.concat_arrays(done).to_pylist() == [v for b in batches for v in each(of, pa.string(), *b).to_pylist()]
    assert list(handed_on(of, pa.string(), iter([]))) == list(handed_on(of, pa.string(), iter([batches[1]]))) == []


def most_held(results) -> tuple[int, int]:
    """Rows of all results, and the most bytes that Arrow holds besides what it held before."""
    before, rows, most = pa.total_allocated_bytes(), 0, 0
    for part in results:
        most = max(most, pa.total_allocated_bytes() - before)
        rows += len(part)
        del part
    return rows, most


def test_elements_of_a_batch_are_not_held_at_once():
    batch = pa.array([PAGE] * 1000)
    whole = elements_of.func(batch).nbytes
    rows, most = most_held(elements_in_turn.func(iter([batch, batch])))
    assert rows == 2000 and most < whole / 8, (most, whole)


def test_pages_are_read_in_pieces(spark):
    pages = spark.createDataFrame([(k, "https://example.org/", PAGE * (k % 3) or None) for k in range(300)], "page_id long, url string, html string")
    found = elements(pages)
    assert "elements_in_turn" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.page_id: r.n for r in found.filter("tag = 'li'").groupBy("page_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: 100 * (k % 3) for k in range(300) if k % 3}
    assert elements(pages.filter("page_id < 0")).count() == 0


def test_spliced_texts_of_a_batch_are_not_held_at_once():
    texts, span = pa.array([PAGE, None] * 1500), pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("new", pa.string())])
    spans = pa.array([[{"start": 0, "stop": 7, "new": "<b>"}], None] * 1500, pa.list_(span))
    rows, most = most_held(spliced.func(iter([(texts, spans)] * 2)))
    assert rows == 6000 and most < texts.nbytes / 8, (most, texts.nbytes)
    assert pa.concat_arrays(spliced.func(iter([(texts, spans)]))).to_pylist() == ["<b>" + PAGE[7:], None] * 1500
