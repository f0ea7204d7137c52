"""Aggregates over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_statistics(edges: DataFrame) -> DataFrame:
    """One row: count, mean, min and max of the weights (0 without edges), and a map of counts by type."""
    types = edges.groupBy("connection_type").count().agg(F.map_from_entries(F.collect_list(F.struct("connection_type", "count"))).alias("types"))
    w = edges.agg(F.count("*").alias("count"), *[F.coalesce(f("weight"), F.lit(0.0)).alias(n) for f, n in ((F.avg, "mean_weight"), (F.min, "min_weight"), (F.max, "max_weight"))])
    return w.crossJoin(types)  # one row each


def type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("connection_type").agg(F.count("*").alias("n"))


def pair_counts(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges by the types of their ends, from (name, type)."""
    return with_types(edges, types).groupBy("pre_type", "post_type").agg(F.count("*").alias("n"))


def with_types(edges: DataFrame, types: DataFrame) -> DataFrame:
    a, b = (types.select(F.col("name").alias(s), F.col("type").alias(f"{s}_type")) for s in ("pre", "post"))
    return edges.join(a, "pre").join(b, "post")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, in_degree, out_degree, degree): parallel edges count each; nodes without edges have zeros. One pass over the edges."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("pre").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("post").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    counted = ends.groupBy("name").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    i, o = F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0))
    return nodes.select("name").join(counted, "name", "left").select("name", i.alias("in_degree"), o.alias("out_degree"), (i + o).alias("degree"))


def hierarchical_alignment(edges: DataFrame, types: DataFrame) -> DataFrame:
    """(forward - backward) / (forward + backward) over edges between sensory, inter- and motor neurons; 0 if there are none."""
    pair = F.concat_ws(">", "pre_type", "post_type")
    ahead = F.count_if(pair.isin("sensory>interneuron", "sensory>motorneuron", "interneuron>motorneuron"))
    back = F.count_if(pair.isin("interneuron>sensory", "motorneuron>sensory", "motorneuron>interneuron"))
    counted = with_types(edges, types).agg(ahead.alias("forward"), back.alias("backward"))
    return counted.withColumn("alignment", F.coalesce(F.try_divide(F.col("forward") - F.col("backward"), F.col("forward") + F.col("backward")), F.lit(0.0)))


def summary_network(edges: DataFrame) -> DataFrame:
    """(pre, post, weight): how many networks link them."""
    return edges.groupBy("pre", "post").agg(F.countDistinct("network").alias("weight"))


def having_all(rows: DataFrame, item: str, value: str, wanted: list) -> DataFrame:
    """Items that occur with every one of ``wanted``."""
    got = rows.where(F.col(value).isin(wanted)).groupBy(item).agg(F.countDistinct(value).alias("_k"))
    return got.where(F.col("_k") == len(set(wanted))).select(item)


def shares(rows: DataFrame, *keys: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of ``keys``, their share, within ``by`` if given, and its term -p ln p of the entropy. The totals are aggregated again, not windowed."""
    return shares_of(rows.groupBy(*by, *keys).agg(F.count("*").alias("n")), by)


def shares_of(counted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The same of counts ``n`` that are there already."""
    total = counted.groupBy(*by).agg(F.sum("n").alias("_total")) if by else counted.agg(F.sum("n").alias("_total"))
    joined = counted.join(total, list(by)) if by else counted.crossJoin(total)
    p: Column = F.col("n") / F.col("_total")
    return joined.withColumn("share", p).withColumn("entropy", -p * F.ln(p)).drop("_total")
