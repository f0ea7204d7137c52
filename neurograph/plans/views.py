"""Graph and series views over the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neurograph.model import Network
from neurograph.operators.order import with_next

TRADE = "trade AS (SELECT 'c' || o_custkey AS pre, 's' || l_suppkey AS post, l_returnflag AS connection_type, l_quantity AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
NODES = """nodes AS (SELECT 'c' || c_custkey AS name, 'customer' AS category, CAST(c_nationkey AS VARCHAR) AS nation, CAST(n_regionkey AS VARCHAR) AS region FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 's' || s_suppkey, 'supplier', CAST(s_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR) FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
NATION = f"""{TRADE}, {NODES}, nat AS (SELECT a.nation AS pre, b.nation AS post, connection_type, count(*) AS n, sum(weight) AS weight
  FROM trade JOIN nodes a ON pre = a.name JOIN nodes b ON post = b.name GROUP BY ALL)"""
SPARSE = f"""{NATION}, dense AS (SELECT pre, post, sum(weight) AS weight FROM nat GROUP BY ALL),
  sparse AS (SELECT pre, post, weight FROM dense WHERE weight > (SELECT avg(weight) FROM dense))"""
USER = """hops AS (SELECT CAST(user_id AS VARCHAR) AS pre, CAST(lead(user_id) OVER (ORDER BY ts, event_id) AS VARCHAR) AS post, event_type AS connection_type, value FROM events),
  users AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS name, CASE user_id % 3 WHEN 0 THEN 'sensory' WHEN 1 THEN 'interneuron' ELSE 'motorneuron' END AS type FROM events),
  steps AS (SELECT pre, post, connection_type, count(*) AS weight FROM hops WHERE post IS NOT NULL GROUP BY ALL),
  follows AS (SELECT DISTINCT pre, post FROM hops WHERE post IS NOT NULL AND pre <> post)"""
SAMPLES = """samples AS (SELECT user_id AS neuron, CAST(0 AS BIGINT) AS trial, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t, value,
  CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS stim FROM events)"""
SERIES = "series AS (SELECT label AS recording, vec_id AS series, CAST(unnest(range(0, 64)) AS BIGINT) AS t, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def text(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def trade(spark: SparkSession, sf: str) -> Network:
    """Customers and suppliers; an edge for each line of an order."""
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_quantity")
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    edges = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), text("o_custkey")).alias("pre"), F.concat(F.lit("s"), text("l_suppkey")).alias("post"), F.col("l_returnflag").alias("connection_type"), F.col("l_quantity").alias("weight"))
    nation = read(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    kinds = [("customer", "c", "c_custkey", "c_nationkey"), ("supplier", "s", "s_suppkey", "s_nationkey")]
    a, b = (
        read(spark, sf, t).select(k, n).join(nation, F.col(n) == F.col("n_nationkey")).select(F.concat(F.lit(p), text(k)).alias("name"), F.lit(t).alias("category"), text(n).alias("nation"), text("n_regionkey").alias("region"))
        for t, p, k, n in kinds
    )
    return Network("trade", a.union(b), edges)


def user_hops(spark: SparkSession, sf: str) -> DataFrame:
    """(pre, post, connection_type, value): from each event's user to that of the next event."""
    e = read(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    linked = with_next(e, "user_id", ["ts", "event_id"])
    return linked.select(text("user_id").alias("pre"), text("next").alias("post"), F.col("event_type").alias("connection_type"), "value")


def users(spark: SparkSession, sf: str) -> Network:
    hops = user_hops(spark, sf)
    m = F.col("user_id") % 3
    kind = F.when(m == 0, "sensory").when(m == 1, "interneuron").otherwise("motorneuron")
    nodes = read(spark, sf, "events").select("user_id").distinct().select(text("user_id").alias("name"), kind.alias("type"))
    steps = hops.where("post is not null").groupBy("pre", "post", "connection_type").agg(F.count("*").cast("double").alias("weight"))
    return Network("users", nodes, steps)


def followed(spark: SparkSession, sf: str) -> DataFrame:
    """(pre, post) of all users who follow another, as often as they do."""
    return user_hops(spark, sf).where("post is not null and pre <> post").select("pre", "post")


def follows(spark: SparkSession, sf: str) -> DataFrame:
    """(pre, post) of all users who follow another."""
    return followed(spark, sf).distinct()


def samples(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf, "events").select(F.col("user_id").alias("neuron"), F.lit(0).cast("bigint").alias("trial"), (F.row_number().over(w) - 1).cast("bigint").alias("t"), "value", F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("stim"))


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as series of 64 samples; those of a label are one recording."""
    e = read(spark, sf, "embeddings").select(F.col("label").alias("recording"), F.col("vec_id").alias("series"), F.posexplode("embedding").alias("t", "value"))
    return e.select("recording", "series", F.col("t").cast("bigint").alias("t"), F.col("value").cast("double").alias("value"))
