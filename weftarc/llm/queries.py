"""The queries of the numbered operators, each over its whole table with the parameters meant for production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftarc.llm import bpe_codec, conversation_repair, decontaminate, fim, language_id, license_scan, packing, quality_rules, simhash, substring_dedup, token_counts, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back through the capture index of all URLs."""
    captures = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload"))
    index = warc.archive(captures)
    return index.lookup(captures.select(warc.surt(F.col("url")).alias("surt"))).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32(sha1: str) -> str:
    """Base32 of a column of 40 hex digits in DuckDB SQL: 8 characters for every 10 digits."""
    parts = [f"(('0x' || substr({sha1}, {k}, 10))::BIGINT >> {shift}) & 31" for k in (1, 11, 21, 31) for shift in range(35, -1, -5)]
    return " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({p}) + 1)::BIGINT, 1)" for p in parts)


OP1_SQL = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS response FROM payloads
)
SELECT page_id, strlen(payload) AS payload_bytes, {_base32("h")} AS payload_digest,
       CASE WHEN response IS NULL OR page_id IS NOT DISTINCT FROM response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN response IS NULL OR page_id IS NOT DISTINCT FROM response THEN NULL ELSE response END AS refers_to
FROM grouped
"""


URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page's URL."""
    rules = url_filter.RuleArray(spark.createDataFrame(URL_RULES, "rule string, verdict string"))
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP2_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), judged AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every whole text."""
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and its score of every whole text."""
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, with the agreeing words and where they begin."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every whole text, held against its language and source."""
    return quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), simhash.EXACT)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every whole text's ids and of the text that they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe_codec.round_trip(_table(spark, sf_dir, "documents"), path)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded_text", 256).alias("decoded_sha256"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of repeated sentences that documents lose, and the text that is left to them."""
    return substring_dedup.removals(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the repaired text of every conversation, after turns were damaged."""
    damaged = conversation_repair.damaged(_table(spark, sf_dir, "conversations"))
    return conversation_repair.by_conversation(conversation_repair.repair(damaged))


OP11_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT *, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k FROM conversations
), summed AS (  -- CRC-32 bit by bit
  SELECT *, xor(list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT for c in string_split(k, '')],
    lambda crc, byte: list_reduce([xor(crc, byte)] || range(8), lambda x, bit: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) % 20 AS fault
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM summed, range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, E' \t\n\x0b\x0c\r') AS bare
  FROM damaged
), again AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed
), turns AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair
  FROM again
), counted AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM turns GROUP BY conv_id
), follows(x, initial, y) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')
), fills(x, y) AS (VALUES ('', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')
), edits AS (
  SELECT x, 'D' AS code, NULL AS initial, x AS y, 3 AS cost FROM (VALUES (''), ('s'), ('u'), ('a')) v(x)
  UNION ALL SELECT x, 'K', initial, y, 0 FROM follows
  UNION ALL SELECT x, 'R', NULL, y, 2 FROM fills
  UNION ALL SELECT f.x, 'IK', g.initial, g.y, 2 FROM fills f JOIN follows g ON f.y = g.x
  UNION ALL SELECT f.x, 'IR', NULL, g.y, 4 FROM fills f JOIN fills g ON f.y = g.x
), layers AS (  -- the least of cost and audit in each state, after each turn
  SELECT conv_id, n, 0::BIGINT AS i, '' AS state, '000000' AS best FROM counted
  UNION ALL
  SELECT l.conv_id, l.n, l.i + 1, e.y, min(lpad((left(best, 6)::BIGINT + e.cost + CASE WHEN t.fault = 'truncated' AND e.code <> 'D' THEN 1 ELSE 0 END)::VARCHAR, 6, '0') || substr(best, 7) || e.code)
  FROM layers l JOIN turns t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i + 1
  JOIN edits e ON e.x = l.state AND (e.code = 'D' OR t.fault NOT IN ('blank', 'duplicate')) AND (e.initial IS NULL OR e.initial = t.initial)
  GROUP BY l.conv_id, l.n, l.i + 1, e.y
), ended AS (
  SELECT conv_id, min(lpad((left(best, 6)::BIGINT + CASE state WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END)::VARCHAR, 6, '0') || substr(best, 7) || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END) AS best
  FROM layers WHERE i = n GROUP BY conv_id
), letters AS (
  SELECT conv_id, p, substr(best, 6 + p, 1) AS edit FROM (SELECT *, unnest(range(1, length(best) - 5)) AS p FROM ended)
), numbered AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS k FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), kept AS (
  SELECT m.*, t.role, t.text, bool_or(edit = 'K' AND k = 1 AND t.initial = 's') OVER (PARTITION BY m.conv_id) AS has_s
  FROM numbered m LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM m.conv_id AND t.i = m.i AND edit <> 'I' WHERE edit <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - CASE WHEN has_s THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), E'\n' ORDER BY k) AS text
  FROM kept GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(left(best, 6)::BIGINT, 0) AS cost, coalesce(substr(best, 7), '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut at lines and rearranged, and the text that its output gives back."""
    cut = fim.transform(_table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH lined AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), chosen AS (
  SELECT *, ('0x' || substr(d, 1, 8))::BIGINT % (len(lines) + 1) AS a, ('0x' || substr(d, 9, 8))::BIGINT % (len(lines) + 1) AS b,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || substr(d, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || substr(d, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM lined
), cut AS (
  SELECT *, coalesce(array_to_string(lines[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(lines[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
         coalesce(array_to_string(lines[greatest(a, b) + 1:], ''), '') AS s
  FROM chosen
)
SELECT doc_id, len(lines)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all whole texts in windows that hold the sources in the corpus' own proportions."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_url_filters, op3_license_scans, op4_language_id, op5_decontamination,
        op6_quality_rules, op7_simhash, op8_token_counts, op9_bpe_codec, op10_substring_dedup,
        op11_conversation_repair, op12_fill_in_middle, op13_packing,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op2_url_filters": OP2_SQL, "op3_license_scans": license_scan.oracle_sql(), "op11_conversation_repair": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
