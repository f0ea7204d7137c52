"""Filters and sub-networks. Everything is lazy, so each result is a view of its network."""

from __future__ import annotations

import operator
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurograph.model import Network


def matches(wanted: Mapping[str, object], condition: str = "AND") -> Column:
    """Equality of attributes, all or any of them; a null attribute never matches."""
    if condition not in ("AND", "OR"):
        raise ValueError("condition must be AND or OR")
    return reduce(operator.and_ if condition == "AND" else operator.or_, [F.coalesce(F.col(k) == F.lit(v), F.lit(False)) for k, v in wanted.items()])


def have(df: DataFrame, key: str, *identity: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(*identity, key)


def induced(net: Network, neurons: DataFrame) -> Network:
    """The nodes given, and the edges with both ends among them."""
    a, b = neurons.select(F.col("name").alias("pre")), neurons.select(F.col("name").alias("post"))
    return net.with_(neurons=neurons, connections=net.connections.join(a, "pre", "left_semi").join(b, "post", "left_semi").select(*net.connections.columns))


def where(net: Network, neurons_have: Mapping[str, object] | None = None, connections_have: Mapping[str, object] | None = None, condition: str = "AND") -> Network:
    """Nodes and edges by their attributes; then only edges with both ends kept."""
    nodes = net.neurons.where(matches(neurons_have, condition)) if neurons_have else net.neurons
    out = induced(net, nodes)
    return out.with_(connections=out.connections.where(matches(connections_have, condition))) if connections_have else out


def subnetwork(net: Network, names: list[str] | None = None, connections: DataFrame | None = None) -> Network:
    """Induced by nodes, or by edges (then their ends are the nodes, with all attributes); KeyError for unknown names."""
    if names is not None and connections is not None:
        raise AssertionError("either names or connections")
    if names is not None:
        some = net.neurons.where(F.col("name").isin(names))
        if missing := set(names) - {r[0] for r in some.select("name").collect()}:
            raise KeyError(f"not in the network: {sorted(missing)}")
        return induced(net, some)
    if connections is not None:
        keys = [c for c in ("pre", "post", "uid", "connection_type") if c in connections.columns and c in net.connections.columns]
        edges = net.connections.join(connections.select(*keys).distinct(), keys, "left_semi").select(*net.connections.columns)
        ends = edges.select(F.explode(F.array("pre", "post")).alias("name"))
        return net.with_(neurons=net.neurons.join(ends, "name", "left_semi"), connections=edges)
    return net


def by_type(df: DataFrame, value: str, column: str = "connection_type") -> DataFrame:
    return df.where(F.col(column) == value)


def by_property(df: DataFrame, key: str, value: object) -> DataFrame:
    """By a column, or by an entry of ``props``."""
    return df.where(F.col(key) == F.lit(value)) if key in df.columns else df.where(F.col("props")[key] == F.lit(str(value)))


def by_function(df: DataFrame, f) -> DataFrame:
    """Rows for which the column that ``f`` makes of the table holds."""
    if not callable(f):
        raise ValueError("f must be callable")
    return df.where(F.coalesce(f(df), F.lit(False)))


def is_left(name: Column) -> Column:
    return F.coalesce(name.endswith("L") & ~name.isin("ADL", "AVL"), F.lit(False))


def within(df: DataFrame, limits: Mapping[str, tuple[float, float]], flip: tuple[str, ...] = ("LR", "DV")) -> DataFrame:
    """Positions inside inclusive limits; axes of ``flip`` count negated."""
    for axis, (lo, hi) in limits.items():
        x = -F.col(f"position.{axis}") if axis in flip else F.col(f"position.{axis}")
        df = df.where(x.between(lo, hi))
    return df


def expresses_all(expression: DataFrame, genes: list[str]) -> DataFrame:
    """Neurons of (neuron, gene, expressed) that express every gene of the list."""
    got = expression.where(F.col("gene").isin(genes) & F.col("expressed")).groupBy("neuron").agg(F.countDistinct("gene").alias("k"))
    return got.where(F.col("k") == len(set(genes))).select("neuron")


def family_counts(expression: DataFrame, prefix: str) -> DataFrame:
    """(neuron, n_genes, genes) of expressed genes whose names begin with ``prefix``, most first."""
    hit = expression.where(F.col("expressed") & F.col("gene").startswith(prefix))
    return hit.groupBy("neuron").agg(F.count("*").alias("n_genes"), F.array_sort(F.collect_list("gene")).alias("genes")).orderBy(F.desc("n_genes"), "neuron")


def unique_markers(expression: DataFrame, inside: Column) -> DataFrame:
    """Genes expressed in every neuron where ``inside`` holds and in no other."""
    e = F.col("expressed")
    marks = expression.groupBy("gene").agg(F.bool_and(F.when(inside, e)).alias("all_in"), F.bool_or(F.when(~inside, e)).alias("any_out"))
    return marks.where("all_in and not coalesce(any_out, false)").select("gene")


def by_name(connections: DataFrame) -> DataFrame:
    """``connections`` with ``names``, the pair of their ends' names."""
    return connections.withColumn("names", F.struct("pre", "post"))
