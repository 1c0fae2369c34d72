"""URL rules in a sorted digest array.

Rules are strings of a host and a path prefix (``example.com/en/``), each with a verdict. Their 64-bit xxhash
keys lie sorted in files of bounded size, with the full strings beside them. The files are sent once to each
machine, where the tasks map them into memory, so all tasks of a machine share the pages. The hosts of the rules lie
in the same array, each with the lengths of its rules' paths. Of every batch of URLs the different hosts are looked at
first: their suffixes at a dot are hashed and sought by a vectorised binary search. Only where such a host has rules are
the prefixes of a path that have their lengths sought in the same way. Where a key is found, the stored string
decides, so a collision of hashes never makes a match.

Scale: no shuffle of the URLs; one pass. A URL has at most as many candidates as its host and that host's parents have
lengths of rule paths. The rules are dealt by ranges of their keys over as many files as ``SHARD_RULES`` asks. A very long URL is
cut to prefixes of rule lengths only.

Edge cases: a null URL, or one without ``://``, has an empty host and path, which no rule fits. Of rules that
fit, the longest string wins, of equally long ones that with the longer host. A URL that no rule fits is
allowed. A rule that is given twice blocks if either does. Rules without a host or a ``/`` are refused; null
rules are left out. No rules at all, or no URLs, are fine. Columns named like the results are replaced;
repeated rows each get their verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from weftarc.llm import files
from weftarc.llm.scratch import new_path, stored

ALLOW, BLOCK = "allow", "block"
SHARD_RULES = 10_000_000
SEED = 42  # of Spark's xxhash64, which makes the keys of the rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCHEMA = pa.schema([("key", pa.int64()), ("rule", pa.large_string()), ("blocks", pa.bool_()), ("lengths", pa.large_list(pa.int32()))])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """(host, path): what is between the first ``://`` and the first of / ? #, A-Z lower-cased; from there to the first of ? #."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One mapped file for each partition: the sorted keys, strings and verdicts, uncompressed."""
    uri = n = None
    for batch in batches:
        if uri is None:
            uri, n = files.new_file(folder, "arrow"), 0
            out = files.open_output(uri)
            writer = pa.ipc.new_file(out, _SCHEMA)
        writer.write_batch(pa.RecordBatch.from_arrays([batch["key"], batch["rule"].cast(pa.large_string()), batch["blocks"], batch["lengths"].cast(_SCHEMA.field("lengths").type)], schema=_SCHEMA))
        n += len(batch)
    if uri is not None:
        writer.close()
        out.close()
        yield pa.RecordBatch.from_pydict({"uri": [uri], "n": pa.array([n], pa.int64())})


@lru_cache(maxsize=16)
def _mapped(name: str) -> list[tuple[np.ndarray, pa.Array, pa.Array, pa.Array]]:
    """The (keys, strings, verdicts, lengths) of the batches of a file, without a copy."""
    source = pa.ipc.open_file(pa.memory_map(SparkFiles.get(name)))
    return [(b.column(0).to_numpy(), b.column(1), b.column(2), b.column(3)) for b in map(source.get_batch, range(source.num_record_batches))]


def probe(keys: np.ndarray, strings: pa.Array, sought: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Of each sought key, the place of the entry whose string is the text too, or -1."""
    found = np.full(len(sought), -1, np.int64)
    at = np.searchsorted(keys, sought)
    open_ = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == sought)) if len(keys) else np.zeros(0, np.int64)
    while len(open_):  # as many rounds as different strings share a key
        same = pc.equal(pc.take(strings, pa.array(at[open_])), pc.take(texts, pa.array(open_))).to_numpy(zero_copy_only=False)
        found[open_[same]] = at[open_[same]]
        open_ = open_[~same]
        at[open_] += 1
        open_ = open_[at[open_] < len(keys)]
        open_ = open_[keys[at[open_]] == sought[open_]]
    return found


class RuleArray:
    """Rules in mapped files. ``rules``: a DataFrame of rule string, verdict string (allow or block)."""

    def __init__(self, rules: DataFrame, shard_rules: int = SHARD_RULES):
        spark = rules.sparkSession
        slash = F.locate("/", F.col("rule"))
        rules = rules.filter("rule is not null").select(
            F.concat(ascii_lower(F.substring("rule", F.lit(1), slash - 1)), F.expr("substring(rule, locate('/', rule))")).alias("rule"),
            F.when(slash <= 1, F.raise_error(F.concat(F.lit("no host and path: "), F.col("rule")))).otherwise(F.col("verdict") == BLOCK).alias("blocks"),
        )
        host = F.substring_index("rule", "/", 1)
        once = stored(
            rules.groupBy("rule").agg(F.max("blocks").alias("blocks")).select(
                "rule", "blocks", F.xxhash64("rule").alias("key"), host.alias("host"), (F.length("rule") - F.length(host)).alias("path_length")),
            "url-rules",
        )
        hosts = once.groupBy("host").agg(F.sort_array(F.collect_set("path_length")).alias("lengths"))  # as many as there are different lengths
        entries = once.select("key", "rule", F.coalesce("blocks", F.lit(False)).alias("blocks"), F.lit(None).cast("array<int>").alias("lengths")).unionByName(
            hosts.select(F.xxhash64("host").alias("key"), F.col("host").alias("rule"), F.lit(False).alias("blocks"), "lengths")
        )
        n, self.labels = once.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0))).first()
        folder = new_path(spark, "url-rule-array")
        shards = max(1, -(-n // shard_rules))
        dealt = entries.repartitionByRange(shards, "key").sortWithinPartitions("key")
        written = dealt.mapInArrow(lambda it: _write_shard(it, folder), "uri string, n long").collect()  # a row for each file
        for r in written:
            spark.sparkContext.addFile(r["uri"])
        self.names = sorted(r["uri"].rpartition("/")[2] for r in written)

    def matcher(self):
        """A column function of host and path: struct<rule, verdict> of the longest rule; null and allow where none fits."""
        names, labels = self.names, self.labels

        def sought(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]]:
            """(which of the texts are entries, their places, verdicts and lengths) of each file."""
            keys, strings = np.array([xxh64_intdigest(x, SEED) for x in texts], np.uint64).view(np.int64), pa.array(texts, pa.large_string())
            for name in names:
                for shard_keys, entries, verdicts, lengths in _mapped(name):
                    at = probe(shard_keys, entries, keys, strings)
                    some = np.flatnonzero(at >= 0)
                    yield some, at[some], verdicts, lengths

        @F.arrow_udf("struct<rule: string, verdict: string>")
        def match(host: pa.Array, path: pa.Array) -> pa.Array:
            hosts = host.to_pylist()
            of = {h: suffixes(h, labels) for h in set(hosts)}
            names_ = sorted({x for found in of.values() for x in found})
            known: dict[str, list[int]] = {}
            for some, at, _, lengths in sought(names_):
                known |= zip([names_[k] for k in some.tolist()], lengths.take(pa.array(at)).to_pylist(), strict=True)
            ruled = {h: [(x, known[x]) for x in found if x in known] for h, found in of.items()}
            rows, host_lengths, found = [], [], []
            for row, (h, p) in enumerate(zip(hosts, path.to_pylist(), strict=True)):
                for suffix, lengths in ruled[h]:
                    heads = [suffix + p[:n] for n in lengths if n <= len(p)]
                    rows += [row] * len(heads)
                    host_lengths += [len(suffix)] * len(heads)
                    found += heads
            rows, host_length, texts = np.array(rows, np.int64), np.array(host_lengths, np.int64), pa.array(found, pa.large_string())
            hit, blocks = np.zeros(len(found), bool), np.zeros(len(found), bool)
            for some, at, verdicts, _ in sought(found):
                hit[some] = True
                blocks[some] = pc.take(verdicts, pa.array(at)).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(hit)
            length = pc.utf8_length(texts).to_numpy()
            at = at[np.lexsort((-host_length[at], -length[at], rows[at]))]
            at = at[np.concatenate((np.ones(min(1, len(at)), bool), rows[at][1:] != rows[at][:-1]))]
            chosen = np.full(len(host), -1)
            chosen[rows[at]] = at
            blocked = chosen >= 0
            rule = pc.take(texts, pa.array(chosen, mask=~blocked)).cast(pa.string())
            blocked[blocked] = blocks[chosen[blocked]]
            return pa.StructArray.from_arrays([rule, pa.array(np.where(blocked, BLOCK, ALLOW), pa.string())], names=["rule", "verdict"])

        return match


def suffixes(host: str, labels: int) -> list[str]:
    """The host's last 1 to ``labels`` labels; no rule has more."""
    parts = host.rsplit(".", labels)
    parts = parts[-labels:] if len(parts) > labels else parts
    return [".".join(parts[i:]) for i in range(len(parts))]


def judge(urls: DataFrame, rules: RuleArray, url: str = "url") -> DataFrame:
    """``urls`` with host, path, rule (the longest that fits, or null) and verdict (the rule's; allow without one)."""
    host, path = host_and_path(F.col(f"`{url}`"))
    found = urls.withColumns({"host": host, "path": path})
    if not rules.names:
        return found.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(ALLOW)})
    name = "match"
    while name in found.columns:  # the caller may have such a column
        name += "_"
    found = found.withColumn(name, rules.matcher()(F.col("host"), F.col("path")))
    return found.withColumns({"rule": F.col(name)["rule"], "verdict": F.col(name)["verdict"]}).drop(name)
