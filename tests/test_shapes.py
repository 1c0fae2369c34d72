import json

from weftarc.operators import shapes


def faults(spark, *documents):
    rows = spark.createDataFrame([(k, d if d is None or isinstance(d, str) else json.dumps(d)) for k, d in enumerate(documents)], "id long, doc string")
    found: dict = {k: [] for k in range(len(documents))}
    for r in shapes.shape_faults(rows, shapes.MANIFEST, "doc").collect():
        found[r.id].append((r.path, r.fault))
    return [sorted(v) for v in found.values()]


def test_every_kind_of_fault(spark):
    one = {"ordinal": 1, "path": "a/b", "type": "image", "bytes": 3}
    of = lambda *resources, **more: {"version": 1, "count": len(resources), "total_bytes": sum(r.get("bytes") or 0 for r in resources if isinstance(r, dict)), "resources": list(resources)} | more
    got = faults(
        spark, of(), of(one, one | {"ordinal": 2, "bytes": None, "cached": True}), None, "{", "[1]", of(one, version=2), of(one, count=2), of(one, total_bytes=4.5), of(one, extra=1), {k: v for k, v in of(one).items() if k != "count"},
        of(one, resources={}), of(one | {"type": "font"}), of(one | {"path": "/a"}), of(one | {"path": 7}), of(one | {"ordinal": 3}), of(one | {"cached": "yes"}), of(one | {"bytes": -1}), of(one, 5, count=2), of(one | {"path": None}), of(one, version="1"),
    )
    assert got == [
        [], [], [("$", "not-json")], [("$", "not-json")], [("$", "not-an-object")], [("$.version", "out-of-range")], [("$.count", "differs")], [("$.total_bytes", "differs"), ("$.total_bytes", "not-whole")], [("$.extra", "unknown-key")],
        [("$.count", "missing")], [("$.count", "differs"), ("$.resources", "not-a-list"), ("$.total_bytes", "differs")], [("$.resources[0].type", "not-a-choice")], [("$.resources[0].path", "not-of-the-pattern")], [("$.resources[0].path", "not-a-text")],
        [("$.resources[0].ordinal", "not-dense")], [("$.resources[0].cached", "not-a-flag")], [("$.resources[0].bytes", "out-of-range"), ("$.total_bytes", "out-of-range")], [("$.resources[1]", "not-an-object")], [("$.resources[0].path", "null")], [("$.version", "not-a-number")],
    ]


def test_other_columns_and_an_empty_table(spark):
    rows = spark.createDataFrame([("{}", "x", 1)], "doc string, path2 string, `a b` int")
    assert {tuple(r) for r in shapes.shape_faults(rows, shapes.Object({"k": shapes.Flag()}), "doc").collect()} == {("x", 1, "$.k", "missing")}
    assert shapes.shape_faults(rows.limit(0), shapes.MANIFEST, "doc").count() == 0
