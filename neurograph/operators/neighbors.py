"""Neighbourhoods of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurograph.model import Network


def touching(name: str, direction: str = "both") -> Column:
    out, into = F.col("pre") == name, F.col("post") == name
    if direction not in ("both", "in", "out"):
        raise ValueError("direction must be both, in or out")
    return {"both": out | into, "in": into, "out": out}[direction]


def connections_of(net: Network, name: str, paired: str | None = None, direction: str = "both", kind: str | None = None) -> DataFrame:
    """A node's edges, a self-loop once; only those with ``paired``, or of a type."""
    found = net.connections.where(touching(name, direction))
    if paired is not None:
        found = found.where((F.col("pre") == paired) | (F.col("post") == paired)) if paired != name else found.where("pre = post")
    return found if kind is None else found.where(F.col("connection_type") == kind)


def outgoing(net: Network, name: str, paired: str | None = None) -> DataFrame:
    return connections_of(net, name, paired, "out")


def incoming(net: Network, name: str, paired: str | None = None) -> DataFrame:
    return connections_of(net, name, paired, "in")


def connected(net: Network, name: str, direction: str = "both", above: float = 1, kind: str | None = None) -> DataFrame:
    """Ends, the node itself included, of its edges of a weight above ``above``."""
    found = connections_of(net, name, None, direction, kind).where(F.col("weight") > above)
    return found.select(F.explode(F.array("pre", "post")).alias("name")).distinct()


def all_connected(net: Network, above: float = 1) -> DataFrame:
    """The same of every node at once: (name, neighbor)."""
    e = net.connections.where(F.col("weight") > above)
    pairs = F.array(*[F.struct(F.col(a).alias("name"), F.col(b).alias("neighbor")) for a in ("pre", "post") for b in ("pre", "post")])
    return e.select(F.inline(pairs)).distinct()


def connects_to(net: Network, a: str, b: str) -> bool:
    return bool(connections_between(net, a, b, directed=False).limit(1).count())


def connections_between(net: Network, a: str, b: str, directed: bool = True) -> DataFrame:
    there = (F.col("pre") == a) & (F.col("post") == b)
    return net.connections.where(there if directed else there | (F.col("pre") == b) & (F.col("post") == a))


def group_connections(net: Network, members: DataFrame) -> DataFrame:
    """(member, edge columns) of each member's edges; a self-loop once."""
    m = members.select(F.col("name").alias("member"))
    both = net.connections.withColumn("member", F.explode(F.array_distinct(F.array("pre", "post"))))
    return both.join(m, "member", "left_semi")
