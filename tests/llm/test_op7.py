import duckdb

from neurograph.llm import queries, warc

SF = "/root/testdata/sf0.01"
SCHEMA = "record_id bigint, url string, ts bigint, kind string, headers map<string,string>, status string"


def rows_of(spark, data, **options):
    return {r.record_id: r for r in warc.resolve(spark.createDataFrame([(*d, "x") for d in data], SCHEMA), **options).collect()}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    got = queries.op7_warc_revisits(spark, SF)
    want = con.sql(queries.SQL["op7_warc_revisits"])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = got.select(*cols).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.select(*cols).fetchall()))
    assert {r.status for r in rows} >= {"response", "resolved", "changed", "unverified"}


def test_as_of_over_parts(spark):
    """Into however many parts one URL's records are cut, the latest earlier response is found; also if all are of one second."""
    data = [(k, "http://a.b/c", 10 * k, "response" if k % 7 == 0 else "revisit", {"ETag": f"e{k // 7}"}) for k in range(60)]
    want, before = {k: None if k % 7 == 0 else k // 7 * 7 for k in range(60)}, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 7, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert {k: r.resolved_id for k, r in rows_of(spark, data).items()} == want
            assert {k: r.resolved_id for k, r in rows_of(spark, [(k, u, 5, *rest) for k, u, _, *rest in data]).items()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_hot_url_is_spread(spark):
    """One URL with a third of all records, in one hour: no part holds much more than an even share."""
    from pyspark.sql import functions as F

    rows = spark.range(30_000).select(F.col("id").alias("record_id"), F.when(F.col("id") % 3 == 0, "http://hot/").otherwise(F.concat(F.lit("http://h"), F.col("id") % 997)).alias("url"), (F.col("id") % 3600).alias("ts"), F.when(F.col("id") % 4 == 0, "response").otherwise("revisit").alias("kind"), F.create_map().cast("map<string,string>").alias("headers"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = rows.repartitionByRange("url", "ts", "record_id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(dealt) == 8 and max(r[1] for r in dealt) < 1.5 * 30_000 / 8


def test_other_kinds_and_weak_validators(spark):
    data = [(1, "http://a", 1, "response", {"ETag": 'W/"x"'}), (2, "http://a", 2, "revisit", {"etag": '"x"'}), (3, "http://a", 3, "request", {"etag": '"x"'}), (4, "http://a", 4, None, {})]
    assert {k: (r.status, r.resolved_id) for k, r in rows_of(spark, data).items()} == {1: ("response", None), 2: ("resolved", 1), 3: ("other-kind", None), 4: ("no-key", None)}


def test_validators_and_headers(spark):
    full = {"ETag": "a", "Last-Modified": "m", "Content-Type": "t", "X": "1"}
    data = [
        (1, "http://a/", 5, "response", full), (2, "HTTPS://A:443#f", 5, "revisit", {"etag": "a", "content-type": "no", "X": "2", "New": "n"}), (3, "http://a", 6, "revisit", {"ETag": "b", "Last-Modified": "m"}),
        (4, "http://www.a", 7, "revisit", {"last-modified": "m"}), (5, "http://a", 8, "revisit", None), (6, "http://a", 4, "revisit", {"etag": "a"}), (7, None, 4, "revisit", {}), (8, "http://a", None, "response", {}),
        (0, "http://a", 5, "revisit", {"etag": "a"}), (9, "http://a?utm_source=x&b=2&a=1", 9, "response", {}), (10, "http://a/?a=1&b=2", 9, "revisit", {"etag": "z"}),
    ]
    got = rows_of(spark, data)
    assert {k: r.status for k, r in got.items()} == {1: "response", 2: "resolved", 3: "changed", 4: "resolved", 5: "unverified", 6: "no-response", 7: "no-key", 8: "no-key", 0: "no-response", 9: "response", 10: "unverified"}
    assert got[2].merged_headers == {"etag": "a", "last-modified": "m", "content-type": "t", "x": "2", "new": "n"}
    assert got[9].canonical_url == got[10].canonical_url == "a?a=1&b=2"


def test_empty_and_repeats(spark):
    assert rows_of(spark, []) == {}
    df = spark.createDataFrame([(1, "http://a", 1, "response", {"etag": "a"}, "x")] * 2 + [(2, "http://a", 2, "revisit", {"etag": "a"}, "x")] * 2, SCHEMA)
    out = warc.resolve(df)
    assert out.count() == 4 and out.columns.count("status") == 1 and out.where("resolved_id = 1").count() == 2
