"""Building and changing networks: nodes, edges, attributes, weights."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurograph.model import CHEMICAL, GAP, Network


def create_neurons(labels: DataFrame, **attributes) -> DataFrame:
    """Nodes from (name[, ord]) with attributes: a scalar goes to all, a mapping by name (missing ones null), a sequence in the order of ``ord``.

    Raises ValueError on a repeated name, a key that is no name, or a sequence of another length.
    """
    if labels.groupBy("name").count().where("count > 1").limit(1).count():
        raise ValueError("a name occurs twice")
    out, spark = labels, labels.sparkSession
    for key, value in attributes.items():
        if value is None or isinstance(value, (int, str, float, bool)):
            out = out.withColumn(key, F.lit(value))
            continue
        if isinstance(value, Mapping):
            rows = spark.createDataFrame(list(value.items()), ["name", key])
            if rows.join(labels, "name", "left_anti").limit(1).count():
                raise ValueError(f"{key} has keys that are no names")
            out = out.join(rows, "name", "left")
        elif isinstance(value, (list, tuple)):
            if "ord" not in labels.columns:
                raise ValueError("a sequence needs labels with an order")
            if labels.count() != len(value):
                raise ValueError(f"{key} has another length than the labels")
            out = out.join(spark.createDataFrame(list(enumerate(value)), ["ord", key]), "ord", "left")
        else:
            raise NotImplementedError(f"{key}: {type(value).__name__}")
    return out


def check_endpoints(net: Network, connections: DataFrame) -> DataFrame:
    """``connections``, or TypeError if an end isn't a node of ``net``."""
    ends = connections.select(F.explode(F.array("pre", "post")).alias("name")).distinct()
    if ends.join(net.neurons, "name", "left_anti").limit(1).count():
        raise TypeError("an end of a connection isn't in the network")
    return connections


def create_connections(net: Network, connections: DataFrame) -> Network:
    return net.with_(connections=net.connections.unionByName(check_endpoints(net, connections), allowMissingColumns=True))


def setup_connections(net: Network, rows: DataFrame, kind: str, input_type: str = "edge") -> Network:
    """Adds edges from (pre, post, weight and further properties), all of one type. Only rows that are edges are read; NotImplementedError otherwise."""
    if input_type == "adjacency":
        return create_connections(net, explode_adjacency(rows, "adjacency", kind))
    if input_type != "edge":
        raise NotImplementedError(f"input type {input_type!r}")
    return create_connections(net, rows.withColumn("connection_type", F.lit(kind)))


def neurons_from(net: Network, other: Network, data: bool = True) -> Network:
    """``net`` with the nodes of ``other`` that it lacks, with their attributes or by name only."""
    new = other.neurons.join(net.neurons.select("name"), "name", "left_anti")
    return net.with_(neurons=net.neurons.unionByName(new if data else new.select("name"), allowMissingColumns=True))


def connections_from(net: Network, other: Network) -> Network:
    """``net`` with the edges of ``other`` and their attributes; TypeError if an end isn't in ``net``."""
    return create_connections(net, other.connections)


def remove_neurons(net: Network, names: DataFrame) -> Network:
    """Nodes and all their edges go; TypeError if a name is unknown."""
    if names.join(net.neurons, "name", "left_anti").limit(1).count():
        raise TypeError("a name isn't in the network")
    return drop_nodes(net, names)


def drop_nodes(net: Network, names: DataFrame) -> Network:
    n = names.select(F.col("name").alias("gone"))
    edges = net.connections.join(n, F.col("pre") == F.col("gone"), "left_anti").join(n, F.col("post") == F.col("gone"), "left_anti")
    return net.with_(neurons=net.neurons.join(n, F.col("name") == F.col("gone"), "left_anti"), connections=edges)


def remove_connections(net: Network, pairs: DataFrame) -> Network:
    """For each (pre, post) row one parallel edge goes, the one of the largest uid first."""
    order = Window.partitionBy("pre", "post").orderBy(F.desc("uid"))
    wanted = pairs.groupBy("pre", "post").agg(F.count("*").alias("_n"))
    ranked = net.connections.withColumn("_k", F.row_number().over(order)).join(wanted, ["pre", "post"], "left")
    return net.with_(connections=ranked.where(F.col("_n").isNull() | (F.col("_k") > F.col("_n"))).select(*net.connections.columns))


def remove_all_connections(net: Network) -> Network:
    return net.with_(connections=net.connections.limit(0))


def remove_unconnected(net: Network) -> Network:
    """Without nodes that no edge touches; a self-loop touches its node."""
    ends = net.connections.select(F.explode(F.array("pre", "post")).alias("name"))
    return net.with_(neurons=net.neurons.join(ends, "name", "left_semi"))


def explode_adjacency(rows: DataFrame, adjacency: str, kind: str, positive: bool = False, **extra) -> DataFrame:
    """Edges of rows (pre, ``adjacency`` map<post, weight>): a missing weight counts 1; weights of 0 are no edges; only positive ones count if ``positive``."""
    out = rows.select("pre", F.explode(adjacency).alias("post", "weight")).withColumn("weight", F.coalesce("weight", F.lit(1.0)).cast("double"))
    out = out.where("weight > 0" if positive else "weight <> 0").withColumn("connection_type", F.lit(kind))
    return out.withColumns({k: F.lit(v) for k, v in extra.items()}) if extra else out


def chemical(rows: DataFrame, adjacency: str) -> DataFrame:
    return explode_adjacency(rows, adjacency, CHEMICAL, True, color="orange", uid=0)


def gap_junctions(rows: DataFrame, adjacency: str) -> DataFrame:
    return explode_adjacency(rows, adjacency, GAP, True, color="gray", uid=1)


def number_parallel(connections: DataFrame, *order: str) -> DataFrame:
    """uid 0, 1, ... within (pre, post); gap junctions have 1."""
    w = Window.partitionBy("pre", "post").orderBy(*order)
    return connections.withColumn("uid", F.when(F.col("connection_type") == GAP, 1).otherwise(F.row_number().over(w) - 1).cast("int"))


def set_property(df: DataFrame, key: str, value: Column, where: Column | None = None) -> DataFrame:
    """Adds or overwrites an attribute, only where ``where`` holds if that is given."""
    if where is None:
        return df.withColumn(key, value)
    return df.withColumn(key, F.when(where, value).otherwise(F.col(key) if key in df.columns else F.lit(None)))


def update_weights(connections: DataFrame, weight: float, delta: bool = False, where: Column | None = None) -> DataFrame:
    """Sets the weight, or adds to it. ValueError if ``weight`` isn't a number."""
    if isinstance(weight, bool) or not isinstance(weight, (int, float)):
        raise ValueError("the weight must be a number")
    new = F.col("weight") + weight if delta else F.lit(float(weight))
    return set_property(connections, "weight", new, where)


def update_weights_by(connections: DataFrame, f: Callable[[DataFrame], Column]) -> DataFrame:
    """The weight becomes the column that ``f`` makes of the edges: an expression, or a pandas UDF's call."""
    if not callable(f):
        raise ValueError("f must be callable")
    return connections.withColumn("weight", f(connections).cast("double"))


def overwrite_weights(connections: DataFrame, weights: DataFrame) -> DataFrame:
    """Every edge gets the weight that (pre, post, new_weight) has for it, null where it has none."""
    kept = [c for c in connections.columns if c != "weight"]
    return connections.select(*kept).join(weights.select("pre", "post", F.col("new_weight").alias("weight")), ["pre", "post"], "left")
