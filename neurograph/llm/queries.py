"""The operators' queries over their whole tables, with the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neurograph.llm import bpe, html_text, media, packing, quality_rules, sharding, simhash, substring, url_filters, warc
from neurograph.llm.common import read

RULES = [
    url_filters.ListRule("block", "com", "/en/"), url_filters.ListRule("allow", "example.com", "/en/7"), url_filters.ListRule("allow", "net", "/de/"),
    url_filters.ListRule("block", "example.net", "/de/8"), url_filters.ListRule("block", "org", "/es/"),
]
PACKING = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SHARDS, SLOTS = [f"shard-{k:02d}" for k in range(64)], 65_537


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by the base and by a decision list learned from ``labels``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    seen, stats, rule = quality_rules.judge(docs, quality_rules.train(docs, read(spark, sf_dir, "labels")))
    five = [F.col(f"{stats}.{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return seen.select("doc_id", *five, quality_rules.base_failed(stats).alias("base_failed"), F.col(rule).isNull().alias("kept"), F.col(rule).alias("rule"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL judged by the stated rules, else by associations mined from the URLs that those rules label, and that hold on hosts they weren't mined from."""
    url = F.col("url")
    pages = read(spark, sf_dir, "pages").select("page_id", url_filters.host(url).alias("host"), url_filters.path(url).alias("path"))
    rule, said = url_filters.stated(RULES, F.col("host"), F.col("path"))
    pages = pages.select("page_id", "host", "path", rule.alias("rule"), said.alias("label"), url_filters.tokens(F.col("host"), F.col("path")).alias("tokens"))
    seen, learned = url_filters.apply_rules(pages, "tokens", url_filters.learn(pages))
    return seen.select("page_id", "host", "path", "rule", F.coalesce("label", f"{learned}.verdict").alias("verdict"), *[F.when(F.col("rule").isNull(), F.col(f"{learned}.{c}")).alias(c) for c in ("because", "confidence")])


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored in an ISO media file and read back by its sample tables."""
    return media.media_digest(read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component at 2 or fewer differing bits."""
    found = simhash.components_of(simhash.fingerprints(read(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard."""
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and its ids decoded."""
    return bpe.digest(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def captures(pages: DataFrame) -> DataFrame:
    """A WARC index made of pages: a full response of each, and a later revisit whose validators match, differ or lack by turns."""
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    turn, at = F.pmod("page_id", F.lit(4)), F.col("page_id") * 3600

    def headers(*pairs: tuple[str, Column]) -> Column:
        return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda e: e["value"].isNotNull()))

    day = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    full = pages.select((F.col("page_id") * 2).alias("record_id"), "url", at.alias("ts"), F.lit("response").alias("kind"), headers(("ETag", F.when(turn != 1, etag)), ("Last-Modified", day), ("Content-Length", F.length("html").cast("string")), ("Cache-Control", F.lit("max-age=60"))).alias("headers"))
    again = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (at + 86_400 * (1 + F.pmod("page_id", F.lit(5)))).alias("ts"), F.lit("revisit").alias("kind"), headers(("etag", F.when(turn == 0, etag).when(turn == 2, F.lit('"other"'))), ("last-modified", F.when(turn == 1, day)), ("Content-Length", F.lit("0")), ("cache-control", F.lit("max-age=90")), ("X-Again", turn.cast("string"))).alias("headers"))
    return full.union(again)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the captures made of ``pages`` resolved to its earlier response."""
    found = warc.resolve(captures(read(spark, sf_dir, "pages")))
    entries = F.array_sort(F.transform(F.map_entries("merged_headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.select("record_id", "kind", "canonical_url", "status", "resolved_id", F.array_join(entries, "; ").alias("headers"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into windows of 2048, 1024, 512 and 256 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), *PACKING)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 50 words that start in an earlier document."""
    return substring.digest(read(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_text.extract(read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_url_filters, op3_media_columns, op4_simhash, op5_sharding, op6_bpe, op7_warc_revisits, op8_packing, op9_substring_dedup, op10_html_text)}

_WARC = """
WITH p AS (SELECT *, page_id % 4 AS turn, '"' || md5(coalesce(html, '')) || '"' AS tag, 'day ' || page_id AS day FROM pages),
r AS (
  SELECT page_id * 2 AS record_id, url, page_id * 3600 AS ts, 'response' AS kind, CASE WHEN turn <> 1 THEN tag END AS etag, day AS modified,
    CAST(length(html) AS VARCHAR) AS size, 'max-age=60' AS cache, CAST(NULL AS VARCHAR) AS again FROM p
  UNION ALL
  SELECT page_id * 2 + 1, url, page_id * 3600 + 86400 * (1 + page_id % 5), 'revisit', CASE turn WHEN 0 THEN tag WHEN 2 THEN '"other"' END,
    CASE WHEN turn = 1 THEN day END, '0', 'max-age=90', CAST(turn AS VARCHAR) FROM p),
b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM r),
c AS (SELECT *,
  list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'), lambda x: x <> '' AND string_split(x, '=')[1] NOT IN
    ('fbclid', 'gclid', 'ref', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'))) AS args FROM b),
k AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[.]', '')
  || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
  || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS canonical_url FROM c),
w AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN record_id END IGNORE NULLS) OVER
  (PARTITION BY canonical_url ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source FROM k),
s AS (SELECT w.*, f.etag AS f_etag, f.modified AS f_modified, f.size AS f_size, CASE
  WHEN w.canonical_url IS NULL THEN 'no-key' WHEN w.kind = 'response' THEN 'response' WHEN source IS NULL THEN 'no-response'
  WHEN f.etag = w.etag THEN 'resolved' WHEN f.etag <> w.etag THEN 'changed'
  WHEN f.modified = w.modified THEN 'resolved' WHEN f.modified <> w.modified THEN 'changed' ELSE 'unverified' END AS status
  FROM w LEFT JOIN r f ON f.record_id = w.source AND f.kind = 'response')
SELECT record_id, kind, canonical_url, status, CASE WHEN status = 'resolved' THEN source END AS resolved_id,
  CASE WHEN status = 'resolved' THEN array_to_string(list_sort(list_filter([
    'cache-control: ' || cache, 'content-length: ' || f_size, 'etag: ' || coalesce(etag, f_etag), 'last-modified: ' || coalesce(modified, f_modified),
    'x-again: ' || again], lambda x: x IS NOT NULL)), '; ') END AS headers
FROM s
"""

_SHARDING = f"""
SELECT doc_id, slot, 'shard-' || lpad(CAST(owners[CAST(slot + 1 AS INTEGER)] AS VARCHAR), 2, '0') AS shard
FROM (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15)) AS BIGINT) % {SLOTS} AS slot FROM documents),
  (SELECT [{",".join(map(str, sharding.fill(SHARDS, SLOTS)))}] AS owners)
"""

_SUBSTRING = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i : i + 49], ' ') AS window_text FROM t, unnest(range(1, len(words) - 48)) AS u(i) WHERE len(words) >= 50),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY window_text) AS first_doc FROM w),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM f WHERE first_doc < doc_id GROUP BY doc_id),
k AS (SELECT t.doc_id, words, coalesce(gone, []) AS gone FROM t LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  CASE WHEN len(gone) = 0 THEN sha256(array_to_string(words, ' ')) ELSE sha256((SELECT coalesce(string_agg(words[j], ' ' ORDER BY j), '')
    FROM unnest(range(1, len(words) + 1)) AS x(j) WHERE NOT list_contains(gone, j))) END AS kept_sha256
FROM k
"""

SQL = {"op5_sharding": _SHARDING, "op7_warc_revisits": _WARC, "op9_substring_dedup": _SUBSTRING}
