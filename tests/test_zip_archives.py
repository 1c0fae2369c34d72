import io
import zipfile

import pytest
from pyspark.sql import functions as F

from weftarc.operators import archives
from weftarc.operators import zip_archives as z

ROWS = [(1, "index.html", b"<p>" * 5000), (1, "assets/é.png", bytes(range(256)) * 9), (1, "a/empty", b""), (1, "b", None), (2, "only", b"x"), (3, "Z", b"1"), (3, "a", b"2")]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ROWS, "job_id long, path string, data binary")


def whole(pieces):
    return {(r.job_id, r.part): bytes(r.archive) for r in z.cells(pieces).collect()}


def test_other_readers_take_what_is_written(entries):
    files = whole(z.pieces(entries))
    assert sorted(files) == [(1, 0), (2, 0), (3, 0)] and files == whole(z.pieces(entries.repartition(7)))
    for (job, _), data in files.items():
        with zipfile.ZipFile(io.BytesIO(data)) as f:
            assert f.testzip() is None
            assert [(i.filename, f.read(i)) for i in f.infolist()] == sorted((p, d or b"") for j, p, d in ROWS if j == job)


def test_pieces_are_files(entries, tmp_path):
    listed = z.saved(z.pieces(entries), str(tmp_path)).collect()
    assert {(r.job_id, r.part): open(r.file, "rb").read() for r in listed} == whole(z.pieces(entries))
    assert all(r.bytes == len(open(r.file, "rb").read()) for r in listed)


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_read_back_by_ranges(entries, size):
    pieces = z.pieces(entries)
    want = sorted((j, p, d or b"") for j, p, d in ROWS)
    for blocks in (z.blocks(z.cells(pieces), size), z.blocks_of_pieces(pieces, size)):
        got = z.entries_of(blocks, size).collect()
        assert sorted((r.job_id, r.path, bytes(r.data)) for r in got) == want and not any(r.fault for r in got)


def test_what_others_write_is_read(spark):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as f:
        f.writestr("stored.txt", "as it is")
        f.writestr(zipfile.ZipInfo("packed.txt"), "p" * 999, zipfile.ZIP_DEFLATED)
        f.comment = b"PK\x05\x06 a comment that looks like an end"
    got = z.entries_of(z.blocks(spark.createDataFrame([(1, 0, sink.getvalue())], "job_id long, part int, archive binary"))).collect()
    assert sorted((r.path, bytes(r.data), r.fault) for r in got) == [("packed.txt", b"p" * 999, None), ("stored.txt", b"as it is", None)]


def number(data, at, width):
    return int.from_bytes(data[at : at + width], "little")


def put(data, at, value, width):
    return data[:at] + value.to_bytes(width, "little") + data[at + width :]


def test_faults(spark):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("a.txt", "alpha" * 30)
        f.writestr("b.txt", "beta" * 30)
    good = sink.getvalue()
    end = len(good) - 22
    first, second = number(good, end + 16, 4), number(good, end + 16, 4) + 46 + 5
    b = number(good, second + 42, 4)
    both = lambda data, local, central, value, width: put(put(data, b + local, value, width), second + central, value, width)
    packed = number(good, second + 20, 4)
    broken = {
        "no-end-record": good[:-1], "zip64": put(good, end + 10, 0xFFFF, 2), "several-disks": put(good, end + 4, 1, 2), "directory-place": put(good, end + 12, 3, 4), "directory": put(good, first, 0, 4),
        "flags": put(good, second + 8, 1, 2), "method": put(good, second + 10, 12, 2), "path": put(good, second + 46, 0xFF, 1), "repeated-path": put(good, second + 46, ord("A"), 1),
        "overlap": both(good, 18, 20, packed + 1, 4), "gap": both(good, 18, 20, packed - 1, 4), "headers-differ": put(good, b + 14, 7, 4), "data": put(good, b + 35, 0xFF, 1), "crc": both(good, 14, 16, 7, 4),
    }
    names = list(broken)
    rows = [(k, 0, broken[n]) for k, n in enumerate(names)] + [(90, 0, b""), (91, 0, put(good, second + 42, 0, 4)), (92, 0, put(good, second + 20, 0xFFFFFFFF, 4)), (93, 0, good[:first] + b"junk" + put(good[first:], len(good) - first - 6, first + 4, 4))]
    found: dict = {}
    for r in z.entries_of(z.blocks(spark.createDataFrame(rows, "job_id long, part int, archive binary"))).collect():
        found.setdefault(r.job_id, set()).add(r.fault)
        assert (r.data is None) == (r.fault is not None)
    for k, n in enumerate(names):
        assert n in found[k], (n, found[k])
    assert found[90] == {"no-end-record"} and "overlap" in found[91] and "zip64" in found[92] and "gap" in found[93]
    assert set(z.FAULTS) - set(names) == {"length"}
    with pytest.raises(Exception, match="archive 0: no-end-record"):
        archives.unzipped(spark.createDataFrame(rows[:1], "job_id long, part int, archive binary")).collect()


def test_limits(spark):
    twice = spark.createDataFrame([(1, "a", b"1"), (1, "a", b"2")], "job_id long, path string, data binary")
    with pytest.raises(Exception, match="comes twice"):
        z.pieces(twice).collect()
    assert z.pieces(twice.limit(0)).count() == 0 and z.entries_of(z.blocks_of_pieces(z.pieces(twice.limit(0)))).count() == 0
    many = spark.range(500).select(F.lit(1).cast("long").alias("job_id"), F.concat(F.lit("p/"), "id").alias("path"), F.encode(F.repeat(F.col("id").cast("string"), 40), "UTF-8").alias("data"))
    packed = z.cells(z.pieces(many, part_bytes=8000)).cache()
    assert packed.count() > 4 and archives.unzipped(packed).filter(F.crc32("data") == F.col("crc32")).select("path").distinct().count() == 500
