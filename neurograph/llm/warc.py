"""Operator 7, resolution of WARC "not modified" revisits.

A revisit takes the latest earlier full response of its canonical URL. If a validator (ETag, else Last-Modified) tells them apart, or neither
record has one in common, it isn't resolved. A resolved revisit has the response's headers, replaced by those of its own headers that a
304 may change.

The as-of join is a window over each URL's time line, cut where Spark's sampled range bounds over (URL, time, record id) cut all records into even parts:
each part's last response is found first (a grouped aggregate), the last one of any earlier part is carried over those few rows, and then a window
looks inside each part. So a URL with a third of all records, even of one second, is spread over a third of the parts. The parts are written before
they are read, as bounds may be drawn otherwise when a lost task runs again.

Defined results: records with a null URL, time or kind stay, unresolved (``no-key``), and so do records of other kinds than the two
(``other-kind``); ETags are compared weakly (``W/"x"`` is ``"x"``), as a 304 is; captures of equal time go by record id, a revisit never takes a
response of the same time and a larger id; repeated rows are all returned; null headers count as none; an empty table gives an empty result; extra columns
stay, and those called like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurograph.llm.common import materialize

#: Headers that a 304 doesn't replace, as they describe the stored body.
BODY_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "trailer", "transfer-encoding")
TRACKING = ("fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
OUTPUT = ("canonical_url", "status", "resolved_id", "merged_headers")


def canonical_url(url: Column) -> Column:
    """Lower-case host without ``www.`` or a default port, path without a closing slash, query sorted and without tracking, no scheme or fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    pairs = F.array_sort(F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*TRACKING)))
    query = F.array_join(pairs, "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def merged(stored: Column, own: Column) -> Column:
    """Stored headers, replaced and joined by the permitted ones of the revisit; names in lower case."""

    def lower(m: Column) -> Column:
        named = F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
        names = F.array_distinct(F.transform(named, lambda e: e["key"]))
        # of two names that differ in case only, the first counts
        return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.filter(named, lambda e: e["key"] == n)[0]["value"].alias("value"))))

    fresh = F.map_filter(lower(own), lambda k, v: ~k.isin(*BODY_HEADERS))
    old = F.map_filter(lower(stored), lambda k, v: ~F.map_contains_key(fresh, k))
    return F.map_concat(old, fresh)


def resolve(records: DataFrame, url: str = "url", at: str = "ts", key: str = "record_id", kind: str = "kind", headers: str = "headers") -> DataFrame:
    """``records`` with OUTPUT. ``kind`` is ``response`` or ``revisit``; ``ts`` is in seconds (bigint); ``headers`` map<string,string>.

    status: ``response``, ``resolved``, ``changed`` (validators differ), ``unverified`` (none in common), ``no-response``, ``other-kind`` or ``no-key``.
    """
    rest = [c for c in records.columns if c.lower() not in OUTPUT]
    rows = records.select(F.struct(*[records[c] for c in rest]).alias("r"))
    rows = rows.withColumn("u", canonical_url(F.col(f"r.{url}"))).withColumn("t", F.col(f"r.{at}").cast("bigint"))
    full = F.when(F.col(f"r.{kind}") == "response", F.struct(F.col("t").alias("t"), F.col(f"r.{key}").alias("i"), F.col(f"r.{headers}").alias("h")))
    known = F.col("u").isNotNull() & F.col("t").isNotNull() & F.coalesce(F.col(f"r.{kind}").isin("response", "revisit"), F.lit(False))
    dealt = rows.where(known).withColumn("i", F.col(f"r.{key}")).repartitionByRange("u", "t", "i").withColumn("bucket", F.spark_partition_id())
    keyed = materialize(dealt, "captures").withColumn("full", full)

    order = F.struct(F.col("t"), F.col(f"r.{key}"))
    ends = keyed.where("full is not null").groupBy("u", "bucket").agg(F.max_by("full", order).alias("end"))
    spans = keyed.groupBy("u", "bucket").agg(F.count("*").alias("n")).join(ends, ["u", "bucket"], "left")
    before = Window.partitionBy("u").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(F.col("u").alias("u2"), F.col("bucket").alias("b2"), F.last("end", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("u", "bucket").orderBy("t", F.col(f"r.{key}")).rowsBetween(Window.unboundedPreceding, -1)
    seen = keyed.withColumn("here", F.last("full", ignorenulls=True).over(inside)).join(carried, (F.col("u") == F.col("u2")) & (F.col("bucket") == F.col("b2")))
    seen = seen.withColumn("from", F.coalesce("here", "carried"))

    def validator(of: str, name: str) -> Column:
        return F.get(F.filter(F.map_entries(F.col(of)), lambda e: F.lower(e["key"]) == name), F.lit(0))["value"]

    verdict = F.when(F.col("from").isNull(), "no-response")
    for name in ("etag", "last-modified"):
        a, b = (F.regexp_replace(validator(of, name), "^W/", "") for of in ("from.h", f"r.{headers}"))
        verdict = verdict.when(a == b, "resolved").when(a != b, "changed")
    status = F.when(F.col(f"r.{kind}") == "response", "response").otherwise(verdict.otherwise("unverified"))
    seen = seen.withColumn("status", status)
    hit = F.col("status") == "resolved"
    out = seen.select("r.*", F.col("u").alias("canonical_url"), "status", F.when(hit, F.col("from.i")).alias("resolved_id"), F.when(hit, merged(F.col("from.h"), F.col(f"r.{headers}"))).alias("merged_headers"))
    lost, missing = rows.where(~known), F.col("u").isNull() | F.col("t").isNull() | F.col(f"r.{kind}").isNull()
    return out.unionByName(lost.select("r.*", F.col("u").alias("canonical_url"), F.when(missing, "no-key").otherwise("other-kind").alias("status"), F.lit(None).cast(records.schema[key].dataType).alias("resolved_id"), F.lit(None).cast("map<string,string>").alias("merged_headers")))
