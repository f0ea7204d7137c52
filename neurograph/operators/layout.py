"""The tables behind plots: places of nodes, widths and kinds of edges. Drawing itself is left to the caller."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurograph.model import Network
from neurograph.operators.stats import with_types


def grouped_places(nodes: DataFrame, *groups: str) -> DataFrame:
    """``nodes`` with ``place``, counted from 0 by name within each of ``groups``."""
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy("name")) - 1)


def shells(nodes: DataFrame, centre: list[str]) -> DataFrame:
    """``nodes`` with ``shell``: 0 for the nodes of the centre, 1 for all others."""
    return nodes.withColumn("shell", F.when(F.col("name").isin(centre), 0).otherwise(1))


def edge_widths(edges: DataFrame, base: float = 2.0) -> DataFrame:
    """``edges`` with ``width``, 1 + log(weight) to the base; null for weights that aren't positive."""
    return edges.withColumn("width", F.when(F.col("weight") > 0, 1 + F.log(F.col("weight")) / F.log(F.lit(base))))


def layered_edges(edges: DataFrame, types: DataFrame, anatomical: DataFrame | None = None) -> DataFrame:
    """Edges with the types of their ends, ``across`` (between two layers), and whether ``anatomical`` (pre, post) has them."""
    out = with_types(edges, types).withColumn("across", F.col("pre_type") != F.col("post_type"))
    if anatomical is None:
        return out.withColumn("anatomical", F.lit(True))
    known = anatomical.select("pre", "post").distinct().withColumn("anatomical", F.lit(True))
    return out.join(known, ["pre", "post"], "left").withColumn("anatomical", F.coalesce("anatomical", F.lit(False)))


def positions(net: Network, axes: tuple[str, ...] = ("AP", "DV"), reverse: tuple[str, ...] = (), fixed: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """(name, one column for each axis): LR and DV are negated, axes of ``reverse`` once more; ``fixed`` has places of single nodes. ValueError if one has no place."""
    out = net.neurons.select("name", *[F.col(f"position.{a}").cast("double").alias(a) for a in axes])
    for name, place in (fixed or {}).items():
        out = out.withColumns({a: F.when(F.col("name") == name, F.lit(float(place[a]))).otherwise(F.col(a)) for a in axes if a in place})
    sign = {a: -1.0 if (a in ("LR", "DV")) != (a in reverse) else 1.0 for a in axes}
    out = out.select("name", *[(F.col(a) * sign[a]).alias(a) for a in axes])
    if out.where(" or ".join(f"{a} is null" for a in axes)).limit(1).count():
        raise ValueError("a neuron has no position")
    return out


def highlighted(nodes: DataFrame, names: list[str]) -> DataFrame:
    """``nodes`` with ``highlight``; AssertionError for names that aren't among them."""
    if nodes.where(F.col("name").isin(names)).select("name").distinct().count() != len(set(names)):
        raise AssertionError("a highlighted node isn't in the network")
    return nodes.withColumn("highlight", F.col("name").isin(names))
