"""WARC archives and a two-level capture index.

Writing: captures become gzip members of WARC files; of captures with equal payloads one is a response and
the others are revisits without a payload. Indexing: the captures' keys, URLs with the host reversed
(``org,example)/path``), are sorted into blocks of ``BLOCK_LINES`` lines, each a compressed member of an index
file; beside every index file lies its sparse directory with the first key and place of each block, and one
short table has the first key of every file. Reading: sought keys are dealt by ranges like the index; a task
searches the files' first keys, then a directory, then the one or few blocks that can hold a key, all by
binary search, and reads just the byte ranges of the blocks and records found.

Scale: payloads are shuffled once, by digest, so that a revisit knows its response; the rest moves keys and
places only. A task keeps one file, one directory and one block at a time, and its rows come sorted, so each
block is read once or twice. The table of files grows with the files, not the captures (``INDEX_LINES`` each).
A task begins a new archive after ``FILE_BYTES``; records are read by as many tasks as their bytes ask for
(``READ_TASK_BYTES``). Files are written in the shared folder under new names and count only if their task ended
well.

Edge cases: a null or empty payload is a payload of no bytes, and a null URL has the empty key. Null ids are
written and read back as null and never are a response that others refer to, unless all are null. Repeated
rows are records of their own: all that have the response's id are responses. No rows give no files. URLs are
written as they are, but that a header is one line: a URL with line ends has %0D and %0A for them there, and the
whole of it in a field of its own, from which it is read back.
Columns of the input other than id, url and payload are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftarc.llm import files
from weftarc.llm.scratch import new_path, stored

BLOCK_LINES = 512
INDEX_LINES = 2_000_000
LEVEL = 6
FILE_BYTES = 1 << 30
READ_TASK_BYTES = 64 << 20
#: Payloads of fewer bytes are responses, whatever others there are.
LEAST_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"  # captures come without a time of their own

PLACE = "surt string, file string, offset long, length long"
RECORD = "id long, surt string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def surt(url: Column) -> Column:
    """``org,example,www)/path?query`` of a URL; without ``://`` the URL itself; null is empty."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.when(at > 0, F.concat(F.array_join(F.reverse(F.split(F.translate(host, _UPPER, _LOWER), r"\.")), ","), F.lit(")"), tail)).otherwise(url)


# -- records


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(n: int | None, url: str | None, size: int, of: str, refers_to: int | None, payload: bytes | None, name: str = "", refers_to_url: str | None = None) -> bytes:
    """A response record, or a revisit if there is no ``payload``, as one gzip member; ``name`` is the record's own.

    Captures' ids are in fields of their own, as repeated captures are records of different names.
    """
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{of}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    fields = {"Capture-ID": n, "WARC-Target-URI": url}
    if url is not None and _one_line(url) != url:
        fields["Capture-URL"] = url.replace("%", "%25")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        fields |= {"Refers-To-Capture-ID": refers_to, "WARC-Refers-To-Target-URI": refers_to_url, "WARC-Refers-To-Date": DATE}
    head += [f"{k}: {_one_line(str(v))}" for k, v in fields.items() if v is not None]
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    data = deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http)
    if not revisit:
        data += deflate.compress(payload)
    return data + deflate.compress(b"\r\n\r\n") + deflate.flush()


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def parse(member: bytes) -> dict:
    """The record of a gzip member: its headers, the payload's length by the HTTP header, and the payload of a response."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    kind, of = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != of):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is not what was written")
    url = fields.get("WARC-Target-URI")
    if "Capture-URL" in fields:
        url = fields["Capture-URL"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "id": number("Capture-ID"), "url": url, "payload_bytes": size, "payload_digest": of,
        "record_type": kind, "refers_to": number("Refers-To-Capture-ID"), "payload": payload if kind == "response" else None,
    }


# -- writing


def with_roles(captures: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Columns id, url, payload (string) get ``refers_to`` and ``revisit``: of equal payloads the largest id is the response."""
    keyed = captures.select("id", "url", F.coalesce("payload", F.lit("")).alias("payload"))
    keyed = keyed.withColumn("sha1", F.sha1(F.encode("payload", "UTF-8")))
    groups = keyed.groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("response"), F.max_by("url", "id").alias("response_url"))
    shared = stored(groups.filter("n > 1").drop("n"), "warc-shared-payloads")
    revisit = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")) & (F.octet_length("payload") >= least_bytes)
    return keyed.join(shared, "sha1", "left").withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit"), F.col("response"))).drop("response")


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """WARC files of bounded size for each task, and a row for each record in them."""
    uri, out, at = None, None, 0
    for batch in batches:
        places = []
        for n, url, payload, refers_to, response_url, revisit in zip(*(batch[k] for k in ("id", "url", "payload", "refers_to", "response_url", "revisit")), strict=True):
            if out is None or at >= FILE_BYTES:
                if out is not None:
                    out.close()
                uri, at = files.new_file(folder, "warc.gz"), 0
                out = files.open_output(uri)
            body = payload.as_py().encode()
            data = record(n.as_py(), url.as_py(), len(body), digest(body), refers_to.as_py(), None if revisit.as_py() else body, f"{uri}#{at}", response_url.as_py())
            out.write(data)
            places.append((uri, at, len(data)))
            at += len(data)
        names = zip(*places, strict=True) if places else ((),) * 3
        yield pa.RecordBatch.from_arrays([batch["surt"], *(pa.array(c, t) for c, t in zip(names, (pa.string(), pa.int64(), pa.int64()), strict=True))], names=["surt", "file", "offset", "length"])
    if out is not None:
        out.close()


def write_archives(captures: DataFrame, folder: str, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Writes the records of ``captures`` (id long, url, payload strings); returns where each is: surt, file, offset, length."""
    rows = with_roles(captures, least_bytes).withColumn("surt", surt(F.col("url")))
    return stored(rows.select("id", "url", "payload", "refers_to", "response_url", "revisit", "surt").mapInArrow(lambda it: _write(it, folder), PLACE), "warc-places")


# -- the index


def _write_index(batches: Iterator[pa.RecordBatch], folder: str, block_lines: int) -> Iterator[pa.RecordBatch]:
    """An index file of compressed blocks for each range of keys, and its directory."""
    uri, out, at, lines, directory, n, first = None, None, 0, [], [], 0, None

    def flush() -> int:
        member = gzip.compress("\n".join("\t".join((_line(k), f, str(o), str(s))) for k, f, o, s in lines).encode(), mtime=0)
        out.write(member)
        directory.append((lines[0][0], at, len(member), len(lines)))
        lines.clear()
        return at + len(member)

    for batch in batches:
        if out is None and len(batch):
            uri = files.new_file(folder, "index.gz")
            out = files.open_output(uri)
            first = batch["surt"][0].as_py()
        for row in zip(*(batch[k].to_pylist() for k in ("surt", "file", "offset", "length")), strict=True):
            lines.append(row)
            n += 1
            if len(lines) == block_lines:
                at = flush()
    if out is None:
        return
    if lines:
        at = flush()
    out.close()
    with files.open_output(f"{uri}.directory") as sink, pa.ipc.new_file(sink, _DIRECTORY) as writer:
        writer.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*directory, strict=True), _DIRECTORY.types, strict=True)], schema=_DIRECTORY))
    yield pa.RecordBatch.from_pydict({"first": [first], "uri": [uri], "n": [n]})


_DIRECTORY = pa.schema([("first", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("n", pa.int64())])


def _line(key: str) -> str:
    return key.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")


def _key(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n"}.get(m[1], m[1]), line)


class CaptureIndex:
    """Sorted keys in compressed blocks, a sparse directory for each file, and the files' first keys."""

    def __init__(self, places: DataFrame, folder: str, block_lines: int = BLOCK_LINES, index_lines: int = INDEX_LINES):
        n, size = places.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        ranges = max(1, -(-n // index_lines), min(64, -(-n // 4096)))
        # captures of one URL may be very many: they are spread by their place too
        dealt = places.repartitionByRange(ranges, "surt", "file", "offset").sortWithinPartitions("surt", "file", "offset")
        written = dealt.mapInArrow(lambda it: _write_index(it, folder, block_lines), "first string, uri string, n long")
        self.ranges, self.readers = ranges, max(ranges, -(-size // READ_TASK_BYTES))
        self.files = sorted((r["first"].encode(), r["uri"]) for r in written.collect())  # a row for each file

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The records (RECORD) of all captures of each key of ``keys`` (surt); a key that is given twice is sought once."""
        index = list(self.files)
        sought = keys.select(F.coalesce("surt", F.lit("")).alias("surt")).distinct()
        dealt = sought.repartitionByRange(self.ranges, "surt").sortWithinPartitions("surt")
        places = dealt.mapInArrow(lambda it: _seek(it, index), PLACE)
        # records of one key may be very many: the places found are dealt anew before their records are read
        return places.repartition(self.readers, "file", F.col("offset")).sortWithinPartitions("file", "offset").mapInArrow(_read, RECORD)


def _seek(batches: Iterator[pa.RecordBatch], index: list[tuple[bytes, str]]) -> Iterator[pa.RecordBatch]:
    """Places of sorted keys. Bytes are compared, as Spark sorts them."""
    firsts = [f for f, _ in index]
    opened: dict = {}

    def directory(uri: str):
        if opened.get("directory") != uri:
            source = files.open_input(f"{uri}.directory")
            table = pa.ipc.open_file(source).read_all()
            opened.update(directory=uri, firsts=[x.encode() for x in table["first"].to_pylist()], blocks=list(zip(*(table[k].to_pylist() for k in ("offset", "length")), strict=True)))
        return opened["firsts"], opened["blocks"]

    def block(uri: str, k: int, where: tuple[int, int]):
        if opened.get("block") != (uri, k):
            lines = [x.split("\t") for x in gzip.decompress(files.read_range(uri, *where)).decode().split("\n")]
            opened.update(block=(uri, k), keys=[_key(x[0]).encode() for x in lines], lines=lines)
        return opened["keys"], opened["lines"]

    for batch in batches:
        out: list[tuple] = []
        for text in batch["surt"].to_pylist():
            key = text.encode()
            # captures of a key may begin in the file and block before the first that starts with it
            for i in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)):
                uri = index[i][1]
                starts, blocks = directory(uri)
                for k in range(max(0, bisect_left(starts, key) - 1), bisect_right(starts, key)):
                    keys, lines = block(uri, k, blocks[k])
                    out += [(text, f, int(o), int(n)) for _, f, o, n in lines[bisect_left(keys, key) : bisect_right(keys, key)]]
                    if len(out) >= 10_000:
                        yield _places(out)
                        out = []
        if out:
            yield _places(out)


def _places(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["surt", "file", "offset", "length"])


_RECORD = pa.schema([("id", pa.int64()), ("surt", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_READ_BYTES = 8 << 20


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records at sorted places, some megabytes of payload at a time."""
    rows, size = [], 0
    for batch in batches:
        for place in batch.to_pylist():
            found = parse(files.read_range(place["file"], place["offset"], place["length"])) | {"surt": place["surt"]}
            rows.append(found)
            size += len(found["payload"] or b"") + 200
            if size > _READ_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)


def archive(captures: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> CaptureIndex:
    """Writes archives and index of ``captures`` (id long, url, payload strings) into the shared folder."""
    spark = captures.sparkSession
    places = write_archives(captures, new_path(spark, "warc"), least_bytes)
    return CaptureIndex(places, new_path(spark, "warc-index"))
