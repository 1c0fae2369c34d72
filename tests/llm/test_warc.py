import base64
import hashlib

from weftarc.llm import warc
from weftarc.llm.scratch import new_path

SCHEMA = "id long, url string, payload string"


def archived(spark, rows, **params):
    captures = spark.createDataFrame(rows, SCHEMA)
    places = warc.write_archives(captures, new_path(spark, "warc"))
    return warc.CaptureIndex(places, new_path(spark, "index"), **params), captures


def test_round_trip_against_brute_force(spark):
    rows = [(i, f"http://h{i % 7}.example.com/p{i % 50}\t%{i % 3}", ["same", "x" * i, "", None, "é\r\n\r\n<p>"][i % 5]) for i in range(200)]
    rows += [(200, None, "same"), (201, "no scheme \\ \n", "tail"), (None, "http://a/", "same"), (199, "http://a/", "é\r\n\r\n<p>")]
    index, captures = archived(spark, rows, block_lines=3, index_lines=40)
    assert len(index.files) > 1
    got = index.lookup(captures.select(warc.surt(captures.url).alias("surt"))).collect()
    best = {}
    for n, _, p in rows:
        if n is not None:
            best[p or ""] = max(best.get(p or "", n), n)
    want = []
    for n, url, p in rows:
        body = (p or "").encode()
        revisit = n != best[p or ""]
        of = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((n, url, len(body), of, "revisit" if revisit else "response", best[p or ""] if revisit else None, None if revisit else body))
    key = lambda r: tuple(map(repr, r))
    found = [(r.id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(found, key=key) == sorted(want, key=key)


def test_lookup_of_some_keys(spark):
    rows = [(i, f"https://www.example.org/{i // 3}", f"b{i}") for i in range(60)]
    index, _ = archived(spark, rows, block_lines=4)
    keys = spark.createDataFrame([("org,example,www)/4",), ("org,example,www)/4",), ("org,example)/none",), ("",), (None,)], "surt string")
    assert sorted(r.id for r in index.lookup(keys).collect()) == [12, 13, 14]


def test_no_captures(spark):
    index, captures = archived(spark, [])
    assert index.files == [] and index.lookup(spark.createDataFrame([("x",)], "surt string")).count() == 0


def test_record_is_one_gzip_member_of_the_format():
    import gzip

    raw = gzip.decompress(warc.record(5, "http://a/", 2, warc.digest(b"hi"), None, b"hi"))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\nhi\r\n\r\n")


def test_headers_are_the_urls_and_every_record_has_its_own_name(spark, monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "FILE_BYTES", 600)
    rows = [(7, "http://a.example.com/x%20y", "body")] * 3 + [(9, "http://b.example.com/%2F", "body"), (1, "http://c.example.com/", None)]
    captures = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA + ", sha1 string")
    places = warc.write_archives(captures, new_path(spark, "warc")).collect()
    heads = [gzip.decompress(warc.files.read_range(p.file, p.offset, p.length)).split(b"\r\n\r\n")[0].decode().split("\r\n") for p in places]
    field = lambda name: [next((x.split(": ", 1)[1] for x in h if x.startswith(name + ": ")), None) for h in heads]
    assert len(set(field("WARC-Record-ID"))) == 5 and sorted(field("WARC-Target-URI")) == sorted(r[1] for r in rows)
    assert sorted(map(str, field("WARC-Refers-To-Target-URI"))) == ["None"] * 2 + ["http://b.example.com/%2F"] * 3
    for file in {p.file for p in places}:  # a file is nothing but its members, one after another
        own = sorted((p.offset, p.length) for p in places if p.file == file)
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]


def test_a_very_long_payload(spark):
    long = "<p>é</p>" * 1_000_000
    index, captures = archived(spark, [(1, "http://a/", long), (2, "http://b/", long)])
    got = {r.id: (r.record_type, r.payload_bytes) for r in index.lookup(captures.select(warc.surt(captures.url).alias("surt"))).collect()}
    assert got == {2: ("response", 9_000_000), 1: ("revisit", 9_000_000)}
