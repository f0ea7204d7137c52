"""Connected components of a table of links, by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurograph.llm.common import forget, materialize


#: A node of over one in HUBS of all links is a hub.
HUBS = 1000


def _star(edges: DataFrame, small: bool, links: int) -> DataFrame:
    """One round. Large star: each node links its larger neighbours to the smallest node that it knows.
    Small star: each node links its smaller neighbours, and itself, to the smallest of them.

    ``edges`` has at most ``links`` rows, so there are fewer than 2 * HUBS hubs: these are broadcast, and their rows
    aren't dealt by node; any other node's are one task's.
    """
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    known = near.groupBy("u").agg(F.min("v").alias("w"), F.count("*").alias("n")).select(F.col("u").alias("u2"), F.least("u", "w").alias("w"), "n")
    hub, same = F.col("n") > links / HUBS, F.col("u") == F.col("u2")
    hubs, rest = known.where(hub).select("u2", "w"), known.where(~hub).select("u2", "w")
    joined = near.join(F.broadcast(hubs), same).select("u", "v", "w").union(near.join(F.broadcast(hubs.select("u2")), same, "left_anti").join(rest, same).select("u", "v", "w"))
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("w").alias("b")).union(known.select(F.col("u2").alias("a"), F.col("w").alias("b")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("w").alias("b"))
    return out.where("a <> b").distinct()


def components(links: DataFrame, label: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), component the smallest node reachable.

    Nulls and links of a node to itself are left out. An empty table gives an empty result. Rounds grow with the logarithm of the longest
    chain; the state is one row per node and link, never gathered in one place. A round's table goes once the next one is written.
    """
    edges = materialize(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark, size = None, edges.count()
    for _ in range(most_rounds):
        large = materialize(_star(edges, False, size), label)
        forget(edges)
        edges = materialize(_star(large, True, size), label)
        forget(large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark, size = now, now[0]
    else:
        raise RuntimeError("the components didn't settle")
    out = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), label)
    forget(edges)
    return out
