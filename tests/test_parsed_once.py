import pytest
from pyspark.sql import functions as F

from weftarc.operators import archives, rewrite


def _tables(spark):
    refs = spark.createDataFrame(
        [(1, "html", "https://a.example/x")] * 30 + [(1, "css", "https://A.example/x#f")] * 20 + [(1, "css", "https://a.example/y")] * 5 + [(1, "css", None), (1, "css", "data:,x"), (2, "html", "https://a.example/y")], "job_id long, channel string, value string"
    )
    states = spark.createDataFrame([(1, "https://a.example/x", "failed"), (1, "https://a.example/y", "saved")], "job_id long, url string, state string")
    return refs, states


def _dependencies(spark):
    refs, states = _tables(spark)
    channel = F.when(F.col("channel") == "css", "css-ast").otherwise("html-attribute")
    refs = refs.select("job_id", channel.alias("channel"), F.lit("p").alias("source_path"), F.lit(1).alias("element_no"), F.lit(0).alias("part"), F.lit("src").alias("name"), "value")
    records = states.select("job_id", F.col("url").alias("original_url"), F.lit(None).cast("string").alias("final_url"), "state", F.lit("e").alias("error"))
    return archives.dependencies(refs, records, most=3)


def _uncaptured(spark):
    refs, states = _tables(spark)
    return archives.uncaptured(refs, states.filter("state = 'saved'"), states)


@pytest.mark.parametrize("of", [_uncaptured, _dependencies])
def test_each_value_is_parsed_once(spark, of):
    """Spark must not move the filter on a URL's parts below the aggregation that leaves each value once."""
    lines = of(spark)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [lines[k + 1] for k, line in enumerate(lines) if "ArrowEvalPython" in line]
    assert below and all("Aggregate" in line for line in below), below


def test_repeated_references_count(spark):
    want = [(1, "https://a.example/x", 50), (2, "https://a.example/y", 1)]
    assert sorted((r.job_id, r.url, r.n, r.channels, r.reason) for r in _uncaptured(spark).collect()) == [(*want[0], "css,html", "failed"), (*want[1], "html", "missing")]
    got = sorted(_dependencies(spark).collect())
    assert [(r.job_id, r.url, r.n) for r in got] == want and got[0].channels == ["html-attribute", "css-ast"] and [s.channel for s in got[0].sources] == ["html-attribute"] * 3


def test_spliced_is_applied_of_outermost(spark):
    spans = [[(2, 4, "é"), (0, 0, "<"), (2, 6, "wide"), (3, 5, "in"), (6, 6, "b"), (6, 6, "a")], [], None, [(5, 9, "end")], [(0, 1, "")]]
    df = spark.createDataFrame([(k, "日本語 text, more", s) for k, s in enumerate(spans)], f"k int, t string, s {rewrite.SPANS}")
    both = df.select(rewrite.spliced("t", "s").alias("got"), F.coalesce(rewrite.applied(F.col("t"), rewrite.outermost(F.array_sort("s"))), "t").alias("want")).collect()
    assert [r.got for r in both] == [r.want for r in both]


def test_splicing_goes_through_a_text_once():
    """The spans of a long text are not merged anew for each of them."""
    n = 200_000
    assert rewrite.merged_text("ab" * n, [{"start": 2 * k, "stop": 2 * k + 1, "new": "c"} for k in reversed(range(n))]) == "cb" * n
