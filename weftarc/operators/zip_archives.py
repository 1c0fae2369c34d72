"""ZIP archives as tables: members packed by many tasks, places by prefix sums, archives read by ranges.

An archive is a table of pieces (job_id, part, offset, data) that one after another are its bytes. Members are compressed where their
data are; only their sizes come together, to make offsets and the central directory. So an archive of any size is neither one task nor
one cell, and equal entries give equal bytes. What one archive may hold by its format (65,534 entries, 4 GiB) bounds what
windows and directories go through at once; a job with more has more parts, its paths dealt over them by a hash.

Reading needs no more than blocks (job_id, part, block, data) of a fixed size: the end record is sought backwards in the last 64 KiB, the
central directory is read as rows, and the ranges that they name are cut out of the blocks, each block being sent to its
ranges once. Every rule that is broken is a fault of its entry, or of the archive.

Edge cases: an empty table gives no archives; a job without entries has none. Null data count as empty. Paths that come twice in
an archive are an error when writing and a fault when reading. An archive without entries is read as no rows. job_id is not null.
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from weftarc.functions.tables import written

# Signatures, sizes and marks of the format; the time of every member is the first that it knows.
LOCAL, CENTRAL, END = 0x04034B50, 0x02014B50, 0x06054B50
LOCAL_BYTES, CENTRAL_BYTES, END_BYTES, MAX_COMMENT = 30, 46, 22, 0xFFFF
VERSION, DEFLATED, UTF8_FLAG, FIRST_DAY = 20, 8, 0x0800, 33
KNOWN_FLAGS = 0x0806
NO_SHORT, NO_LONG = 0xFFFF, 0xFFFFFFFF

LEVEL = 6
#: Entries, and bytes before compression, of one archive; on average, as paths are dealt by a hash.
PART_ENTRIES, PART_BYTES = 60_000, 2 << 30
BLOCK_BYTES = 1 << 20
ARCHIVE = ("job_id", "part")
FAULTS = (
    "no-end-record", "zip64", "several-disks", "directory-place", "directory", "flags", "method", "path", "repeated-path", "overlap", "gap", "headers-differ", "data", "length", "crc",
)


def little_endian(value: Column, width: int) -> Column:
    """A number as ``width`` bytes, the lowest first."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(width - 1, -1, -1)]))


def number_at(data: Column, at: int, width: int) -> Column:
    """The number in ``width`` bytes from ``at`` on, the lowest first; null beyond the end."""
    digits = F.hex(F.substring(data, at + 1, width))
    whole = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(width - 1, -1, -1)])
    return F.when(F.octet_length(data) >= at + width, F.conv(whole, 16, 10).cast("long"))


def _fields(*fields: tuple[int | Column, int]) -> Column:
    return F.concat(*[little_endian(F.lit(v) if isinstance(v, int) else v, width) for v, width in fields])


def _joined(pieces: Column) -> Column:
    """Binary values of an array one after another."""
    return F.unhex(F.array_join(F.transform(pieces, lambda p: F.hex(p)), ""))


@F.arrow_udf(T.BinaryType())
def deflated(data: pa.Array) -> pa.Array:
    def one(value: bytes) -> bytes:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
        return packer.compress(value) + packer.flush()

    return pa.array([one(d.as_buffer()) if d.is_valid else one(b"") for d in data], pa.binary())


@F.arrow_udf(T.BinaryType())
def inflated(packed: pa.Array, size: pa.Array) -> pa.Array:
    """The data of ``size`` bytes that were packed; null if there are more or fewer, or they cannot be unpacked."""

    def one(value: bytes | None, n: int | None) -> bytes | None:
        if value is None or n is None:
            return None
        unpacker = zlib.decompressobj(-15)
        try:
            out = unpacker.decompress(value, n + 1)
        except zlib.error:
            return None
        return out if unpacker.eof and len(out) == n and not unpacker.unused_data else None

    return pa.array([one(p, n) for p, n in zip(packed.to_pylist(), size.to_pylist(), strict=True)], pa.binary())


# -- writing


def pieces(entries: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """job_id, part, offset, data: the archives of entries (job_id, path, data), members sorted by path."""
    size = F.sum(F.coalesce(F.octet_length("data"), F.lit(0)) + F.octet_length("path"))
    n_parts = entries.groupBy("job_id").agg(F.greatest(F.ceil(size / part_bytes), F.ceil(F.count(F.lit(1)) / PART_ENTRIES), F.lit(1)).cast("int").alias("n_parts"))
    dealt = entries.select("job_id", "path", "data").join(n_parts, "job_id").withColumn("part", F.pmod(F.xxhash64("path"), F.col("n_parts")).cast("int"))
    members = written(
        dealt.select(
            *ARCHIVE, "path", deflated("data").alias("packed"), F.crc32(F.coalesce("data", F.lit(b""))).alias("crc"), F.coalesce(F.octet_length("data"), F.lit(0)).cast("long").alias("size"),
            F.encode("path", "UTF-8").alias("name"), F.when(F.col("path").rlike(r"^[\x00-\x7f]*\z"), 0).otherwise(UTF8_FLAG).alias("flags"),
        ),
        "zip-members",
    )
    n_name, n_packed = F.octet_length("name").cast("long"), F.octet_length("packed").cast("long")
    sizes = members.select(*ARCHIVE, "path", (LOCAL_BYTES + n_name + n_packed).alias("in_file"), (CENTRAL_BYTES + n_name).alias("in_directory"))
    by_path = Window.partitionBy(*ARCHIVE).orderBy("path")
    every = Window.partitionBy(*ARCHIVE)
    twice = F.raise_error(F.concat(F.lit("a path comes twice in an archive: "), F.col("path")))
    start = F.sum("in_file").over(by_path) - F.col("in_file")
    places = sizes.select(
        *ARCHIVE, F.when(F.lag("path").over(by_path) == F.col("path"), twice).otherwise(F.col("path")).alias("path"), start.alias("offset"),
        (F.sum("in_file").over(every) + F.sum("in_directory").over(by_path) - F.col("in_directory")).alias("listed_at"),
    )
    placed = members.join(places, [*ARCHIVE, "path"])
    shared = [("flags", 2), (DEFLATED, 2), (0, 2), (FIRST_DAY, 2), ("crc", 4), (n_packed, 4), ("size", 4), (n_name, 2), (0, 2)]
    shared = [(F.col(v) if isinstance(v, str) else v, w) for v, w in shared]
    local = F.concat(_fields((LOCAL, 4), (VERSION, 2), *shared), F.col("name"), F.col("packed"))
    central = F.concat(_fields((CENTRAL, 4), (VERSION, 2), (VERSION, 2), *shared, (0, 2), (0, 2), (0, 2), (0, 4), (F.col("offset"), 4)), F.col("name"))
    both = placed.select(*ARCHIVE, F.inline(F.array(F.struct(F.col("offset"), local.alias("data")), F.struct(F.col("listed_at").alias("offset"), central.alias("data")))))
    sums = sizes.groupBy(*ARCHIVE).agg(F.sum("in_file").alias("files"), F.sum("in_directory").alias("directory"), F.count(F.lit(1)).alias("n"))
    end = _fields((END, 4), (0, 2), (0, 2), (F.col("n"), 2), (F.col("n"), 2), (F.col("directory"), 4), (F.col("files"), 4), (0, 2))
    return both.unionByName(sums.select(*ARCHIVE, (F.col("files") + F.col("directory")).alias("offset"), end.alias("data")))


def cells(archive_pieces: DataFrame) -> DataFrame:
    """job_id, part, archive: archives of up to 1 GiB as one value each."""
    whole = archive_pieces.groupBy(*ARCHIVE).agg(F.array_sort(F.collect_list(F.struct("offset", "data"))).alias("all"))
    return whole.select(*ARCHIVE, _joined(F.transform("all", lambda p: p["data"])).alias("archive"))


def saved(archive_pieces: DataFrame, folder: str) -> DataFrame:
    """job_id, part, file, bytes: archives written to files in a folder that all executors share, piece by piece.

    A task that is run again writes another file; only files that are listed are whole.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sink, n, name = None, None, 0, ""

        def closed() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_pydict({"job_id": pa.array([now[0]], kind), "part": pa.array([now[1]], pa.int32()), "file": [name], "bytes": pa.array([n], pa.int64())})

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("job_id").type
            for job, part, data in zip(batch["job_id"].to_pylist(), batch["part"].to_pylist(), batch["data"], strict=True):
                if now != (job, part):
                    if now is not None:
                        yield closed()
                    now, n, name = (job, part), 0, f"{folder}/{uuid.uuid4().hex}.zip"
                    filesystem, path = fs.FileSystem.from_uri(name)
                    filesystem.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = filesystem.open_output_stream(path, compression=None)
                sink.write(data.as_buffer())
                n += len(data.as_buffer())
        if now is not None:
            yield closed()

    kind = archive_pieces.schema["job_id"].dataType.simpleString()
    ordered = archive_pieces.repartition(*ARCHIVE).sortWithinPartitions(*ARCHIVE, "offset")
    return ordered.mapInArrow(write, f"job_id {kind}, part int, file string, bytes long")


# -- reading


def blocks(archives: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """job_id, part, block, data of archives that are one value each (job_id, part, archive)."""
    n = F.greatest(F.ceil(F.octet_length("archive") / size), F.lit(1)).cast("int")
    cut = archives.select(*ARCHIVE, "archive", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    return cut.select(*ARCHIVE, "block", F.substring("archive", F.col("block") * size + 1, F.lit(size)).alias("data"))


def blocks_of_pieces(archive_pieces: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """job_id, part, block, data of archives in pieces."""
    stop = F.col("offset") + F.octet_length("data")
    cut = archive_pieces.filter(F.octet_length("data") > 0).select("*", F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor((stop - 1) / size))).alias("block"))
    begin = F.greatest(F.col("block") * size, F.col("offset"))
    part = F.substring("data", (begin - F.col("offset") + 1).cast("int"), (F.least((F.col("block") + 1) * size, stop) - begin).cast("int"))
    pieces_ = cut.select(*ARCHIVE, F.col("block").cast("int").alias("block"), F.struct(begin.alias("at"), part.alias("data")).alias("p"))
    return pieces_.groupBy(*ARCHIVE, "block").agg(_joined(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["data"])).alias("data"))


def ranges_read(of: DataFrame, ranges: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """``ranges`` (job_id, part, no, start, stop) with their data out of blocks; each block meets the list of its own ranges once."""
    asked = ranges.filter("stop > start").select(*ARCHIVE, "no", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / size).cast("int"), F.floor((F.col("stop") - 1) / size).cast("int"))).alias("block"))
    lists = asked.groupBy(*ARCHIVE, "block").agg(F.collect_list(F.struct("no", "start", "stop")).alias("asked"))
    met = of.join(lists, [*ARCHIVE, "block"]).select(*ARCHIVE, "block", "data", F.explode("asked").alias("r"))
    base = F.col("block").cast("long") * size
    begin = F.greatest(F.col("r.start"), base)
    part = F.substring("data", (begin - base + 1).cast("int"), (F.least(F.col("r.stop"), base + size) - begin).cast("int"))
    cut = met.select(*ARCHIVE, F.col("r.no").alias("no"), F.struct(begin.alias("at"), part.alias("data")).alias("p"))
    whole = cut.groupBy(*ARCHIVE, "no").agg(_joined(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["data"])).alias("data"))
    return ranges.join(whole, [*ARCHIVE, "no"], "left").withColumn("data", F.coalesce("data", F.lit(b"")))


_END = pa.struct([("at", pa.int64()), *[(k, pa.int32()) for k in ("disk", "directory_disk", "n_here", "n")], ("size", pa.int64()), ("offset", pa.int64())])


@F.arrow_udf(from_arrow_type(_END))
def end_record(tail: pa.Array, total: pa.Array) -> pa.Array:
    """The last end record whose comment ends with the archive; null without one."""

    def one(data: bytes, total: int) -> dict | None:
        at = len(data) - END_BYTES
        while at >= 0:
            at = data.rfind(END.to_bytes(4, "little"), 0, at + 4)
            if at < 0:
                return None
            number = lambda k, w: int.from_bytes(data[at + k : at + k + w], "little")  # noqa: B023, E731
            if at + END_BYTES + number(20, 2) == len(data):
                return {"at": total - len(data) + at, "disk": number(4, 2), "directory_disk": number(6, 2), "n_here": number(8, 2), "n": number(10, 2), "size": number(12, 4), "offset": number(16, 4)}
            at -= 1
        return None

    return pa.array([one(d, t) for d, t in zip(tail.to_pylist(), total.to_pylist(), strict=True)], _END)


_LISTED = pa.list_(pa.struct([("no", pa.int32()), ("flags", pa.int32()), ("method", pa.int32()), ("crc", pa.int64()), ("packed_size", pa.int64()), ("size", pa.int64()), ("disk", pa.int32()), ("offset", pa.int64()), ("name", pa.binary()), ("path", pa.string()), ("key", pa.string())]))


@F.arrow_udf(from_arrow_type(_LISTED))
def directory(data: pa.Array, n: pa.Array) -> pa.Array:
    """The entries of central directories, each with the key under which its path must be the only one; null for one that is not sound."""

    def one(data: bytes, n: int) -> list[dict] | None:
        at, out = 0, []
        for no in range(n):
            number = lambda k, w: int.from_bytes(data[at + k : at + k + w], "little")  # noqa: B023, E731
            n_name, stop = number(28, 2), at + CENTRAL_BYTES + number(28, 2) + number(30, 2) + number(32, 2)
            if stop > len(data) or number(0, 4) != CENTRAL:
                return None
            name = data[at + CENTRAL_BYTES : at + CENTRAL_BYTES + n_name]
            try:
                path = name.decode("utf-8" if number(8, 2) & UTF8_FLAG else "ascii")
            except UnicodeDecodeError:
                path = None
            out.append({
                "no": no, "flags": number(8, 2), "method": number(10, 2), "crc": number(16, 4), "packed_size": number(20, 4), "size": number(24, 4), "disk": number(34, 2), "offset": number(42, 4),
                "name": name, "path": path, "key": None if path is None else unicodedata.normalize("NFC", path).lower(),
            })
            at = stop
        return out if at == len(data) else None

    return pa.array([one(d, k) for d, k in zip(data.to_pylist(), n.to_pylist(), strict=True)], _LISTED)


def entries_of(of: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """job_id, part, path, data, crc32, fault of archives in blocks of ``size`` bytes: a row for each entry, with the first of FAULTS that it has.

    A fault of the archive itself is a row without a path, and the only one of that archive. Entries with a fault have no data.
    """
    length = F.col("block").cast("long") * size + F.octet_length("data")
    totals = of.groupBy(*ARCHIVE).agg(F.max(length).alias("stop"))
    tails = ranges_read(of, totals.select(*ARCHIVE, F.lit(0).alias("no"), F.greatest(F.lit(0), F.col("stop") - END_BYTES - MAX_COMMENT).cast("long").alias("start"), "stop"), size)
    ends = tails.select(*ARCHIVE, end_record("data", "stop").alias("e"))
    e = F.col("e")
    fault = (
        F.when(e.isNull(), "no-end-record").when((e["n"] == NO_SHORT) | (e["size"] == NO_LONG) | (e["offset"] == NO_LONG), "zip64")
        .when((e["disk"] != 0) | (e["directory_disk"] != 0) | (e["n_here"] != e["n"]), "several-disks").when(e["offset"] + e["size"] != e["at"], "directory-place")
    )
    ends = written(ends.withColumn("fault", fault), "zip-ends")
    listed = ranges_read(of, ends.filter("fault is null").select(*ARCHIVE, F.lit(0).alias("no"), F.col("e.offset").alias("start"), F.col("e.at").alias("stop")), size)
    listed = listed.join(ends.select(*ARCHIVE, "e"), list(ARCHIVE)).select(*ARCHIVE, F.col("e.offset").alias("listed_at"), directory("data", "e.n").alias("all"))
    listed = written(listed, "zip-directories")
    broken = ends.filter("fault is not null").select(*ARCHIVE, "fault").unionByName(listed.filter("all is null").select(*ARCHIVE, F.lit("directory").alias("fault")))
    rows = listed.select(*ARCHIVE, "listed_at", F.inline("all"))
    in_place = Window.partitionBy(*ARCHIVE).orderBy("offset", "no")
    rows = rows.withColumn("next", F.coalesce(F.lead("offset").over(in_place), "listed_at")).withColumn("is_first", F.row_number().over(in_place) == 1).withColumn("n_same", F.count(F.lit(1)).over(Window.partitionBy(*ARCHIVE, "key")))
    flags = F.col("flags").bitwiseAND(NO_SHORT - KNOWN_FLAGS)
    early = (
        F.when((F.col("packed_size") == NO_LONG) | (F.col("size") == NO_LONG) | (F.col("offset") == NO_LONG), "zip64").when(F.col("disk") != 0, "several-disks").when(flags != 0, "flags")
        .when(~F.col("method").isin(0, DEFLATED), "method").when(F.col("path").isNull() | (F.col("path") == "") | F.endswith("path", F.lit("/")), "path").when(F.col("n_same") > 1, "repeated-path")
        .when(F.col("offset") >= F.col("next"), "overlap").when(F.col("is_first") & (F.col("offset") > 0), "gap")
    )
    rows = written(rows.withColumn("early", early), "zip-entries")
    met = ranges_read(of, rows.select(*ARCHIVE, "no", F.col("offset").alias("start"), F.when(F.col("early").isNull(), F.col("next")).otherwise(F.col("offset")).alias("stop")), size).select(*ARCHIVE, "no", F.col("data").alias("raw"))
    raw = F.col("raw")
    said = [(6, 2, "flags"), (8, 2, "method"), (14, 4, "crc"), (18, 4, "packed_size"), (22, 4, "size")]
    n_name = number_at(raw, 26, 2)
    same = (number_at(raw, 0, 4) == LOCAL) & (F.substring(raw, F.lit(LOCAL_BYTES + 1), n_name.cast("int")) == F.col("name"))
    for at, width, column in said:
        same = same & (number_at(raw, at, width) == F.col(column).cast("long"))
    begin = LOCAL_BYTES + n_name + number_at(raw, 28, 2)
    stop = F.col("offset") + begin + F.col("packed_size")
    late = F.when(~F.coalesce(same, F.lit(False)), "headers-differ").when(stop > F.col("next"), "overlap").when(stop < F.col("next"), "gap")
    both = rows.join(met, [*ARCHIVE, "no"]).withColumn("late", F.coalesce("early", late)).withColumn("packed", F.when(F.col("late").isNull(), F.substring(raw, (begin + 1).cast("int"), F.col("packed_size").cast("int"))))
    both = both.withColumn("data", F.when(F.col("method") == DEFLATED, inflated(F.when(F.col("method") == DEFLATED, F.col("packed")), "size")).otherwise(F.col("packed")))
    last = F.coalesce("late", F.when(F.col("data").isNull(), "data").when(F.octet_length("data") != F.col("size"), "length").when(F.crc32("data") != F.col("crc"), "crc"))
    found = both.withColumn("fault", last).select(*ARCHIVE, "path", F.when(F.col("fault").isNull(), F.col("data")).alias("data"), F.col("crc").alias("crc32"), "fault")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("data", "binary"), ("crc32", "long"))]
    return found.unionByName(broken.select(*ARCHIVE, *none, "fault"))
