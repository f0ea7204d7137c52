"""Several networks together: consensus, overlap, mappings between graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurograph.model import Network


def stack(networks: list[Network]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all networks with a ``network`` column. Names must differ."""
    if len({n.name for n in networks}) != len(networks):
        raise AssertionError("networks must have different names")
    nodes = edges = None
    for n in networks:
        a, b = (x.withColumn("network", F.lit(n.name)) for x in (n.neurons.select("name"), n.connections))
        nodes, edges = (a, b) if nodes is None else (nodes.union(a), edges.unionByName(b, allowMissingColumns=True))
    return nodes, edges


def consensus(nodes: DataFrame, edges: DataFrame, k: int, key: tuple[str, ...] = ("pre", "post", "connection_type")) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that all ``k`` networks have, with the mean weight: one aggregate, however many networks."""
    common = nodes.groupBy("name").agg(F.countDistinct("network").alias("_k")).where(F.col("_k") == k).select("name")
    joint = edges.groupBy(*key).agg(F.countDistinct("network").alias("_k"), F.avg("weight").alias("weight")).where(F.col("_k") == k).drop("_k")
    return common, joint


def join_networks(networks: list[Network], name: str = "joined", key: tuple[str, ...] = ("pre", "post", "connection_type")) -> Network:
    return Network(name, *consensus(*stack(networks), len(networks), key))


def overlap(pairs: DataFrame, reference: DataFrame, member: str, group: str) -> DataFrame:
    """For each group the share of its distinct members that are in ``reference``."""
    known = reference.select(F.col(member).alias("_m")).distinct().withColumn("_in", F.lit(1))
    seen = pairs.select(group, member).distinct().join(known, F.col(member) == F.col("_m"), "left")
    return seen.groupBy(group).agg(F.count("*").alias("n_members"), F.count("_in").alias("n_shared")).withColumn("fraction", F.col("n_shared") / F.col("n_members"))


def cardinality(mapping: DataFrame) -> DataFrame:
    """(n_keys, n_values) of a mapping (src, dst)."""
    return mapping.agg(F.countDistinct("src").alias("n_keys"), F.count("dst").alias("n_values"))


def graph_map(mapping: DataFrame, source: Network, target: Network) -> Network:
    """``source`` whose nodes have ``map``, the node of ``target`` that (src, dst) names. ValueError if an end isn't in its graph."""
    for side, net in (("src", source), ("dst", target)):
        if mapping.select(F.col(side).alias("name")).join(net.neurons, "name", "left_anti").limit(1).count():
            raise ValueError(f"{side} has nodes that aren't in {net.name}")
    return source.with_(neurons=source.neurons.join(mapping.select(F.col("src").alias("name"), F.col("dst").alias("map")), "name", "left"))


def edge_map(mapping: DataFrame, source: Network) -> Network:
    """Edges with ``map`` from (pre, post, to_pre, to_post); the ends of mapped edges get theirs, too."""
    to = mapping.select("pre", "post", F.struct("to_pre", "to_post").alias("map"))
    ends = mapping.select(F.inline(F.array(F.struct(F.col("pre").alias("name"), F.col("to_pre").alias("map")), F.struct(F.col("post").alias("name"), F.col("to_post").alias("map"))))).groupBy("name").agg(F.min("map").alias("map"))
    return source.with_(connections=source.connections.join(to, ["pre", "post"], "left"), neurons=source.neurons.join(ends, "name", "left"))
