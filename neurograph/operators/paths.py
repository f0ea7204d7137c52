"""Paths: bounded simple paths, breadth-first search, and operations on paths held as arrays of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurograph.sources.tables import written


def simple_paths(edges: DataFrame, sources: DataFrame, max_length: int, targets: DataFrame | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """All simple paths of 1 to ``max_length`` edges from nodes (name) of ``sources``: (source, target, length, nodes[, edges]).

    With ``targets`` only paths that end there; a path isn't followed beyond its target. Parallel edges make paths of their own if ``columns``
    (kept as structs in ``edges``) has what tells them apart, otherwise each row of ``edges`` counts.
    """
    keep = F.struct("pre", "post", *columns).alias("edge")
    step = edges.select(F.col("pre").alias("_pre"), F.col("post").alias("_post"), keep) if columns else edges.select(F.col("pre").alias("_pre"), F.col("post").alias("_post"))
    kind = step.select(F.array("edge")).schema[0].dataType if columns else None
    start = sources.select(F.col("name").alias("source"), F.col("name").alias("target"), F.array("name").alias("nodes"))
    front = start.withColumn("edges", F.array().cast(kind)) if columns else start
    ends = targets.select(F.col("name").alias("_end"), F.lit(True).alias("_hit")).distinct() if targets is not None else None
    found = None
    for length in range(1, max_length + 1):
        grown = front.join(step, F.col("target") == F.col("_pre")).where(~F.array_contains("nodes", F.col("_post")))
        made = [F.col("source"), F.col("_post").alias("target"), F.array_append("nodes", F.col("_post")).alias("nodes")]
        front = grown.select(*made, *([F.array_append("edges", F.col("edge")).alias("edges")] if columns else []))
        here = front.withColumn("length", F.lit(length))
        if ends is not None:
            marked = front.join(ends, F.col("target") == F.col("_end"), "left")
            here = marked.where("_hit").drop("_end", "_hit").withColumn("length", F.lit(length))
            front = marked.where("_hit is null").drop("_end", "_hit")
        found = here if found is None else found.unionByName(here)
    return found


def reverse_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"pre": F.col("post"), "post": F.col("pre")})


def distances(edges: DataFrame, sources: DataFrame, most: int = 1_000) -> DataFrame:
    """(source, name, distance): fewest edges from each source to each node that it reaches, itself at 0.

    Each round joins the frontier with the edges and leaves out what was seen; rounds are written, and end with an empty frontier.
    """
    step = edges.select(F.col("pre").alias("_pre"), F.col("post").alias("_post")).distinct()
    seen = front = sources.select(F.col("name").alias("source"), "name", F.lit(0).alias("distance")).distinct()
    for d in range(1, most + 1):
        new = front.join(step, F.col("name") == F.col("_pre")).select("source", F.col("_post").alias("name")).distinct()
        front = written(new.join(seen.select("source", "name"), ["source", "name"], "left_anti").withColumn("distance", F.lit(d)), "frontier")
        if front.isEmpty():
            return seen
        seen = seen.union(front)
    raise RuntimeError("the search didn't end")


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, name) of every node that some path of one edge or more leads to."""
    step = edges.select(F.col("pre").alias("_pre"), F.col("post").alias("_post")).distinct()
    first = sources.select(F.col("name").alias("source")).join(step, F.col("source") == F.col("_pre")).select("source", F.col("_post").alias("name")).distinct()
    seen = front = written(first, "reach")
    while not front.isEmpty():
        new = front.join(step, F.col("name") == F.col("_pre")).select("source", F.col("_post").alias("name")).distinct()
        front = written(new.join(seen, ["source", "name"], "left_anti"), "reach")
        seen = seen.union(front)
    return seen


def flow_demand(nodes: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """(name, demand): sources share out the sinks' number, so that demands add up to 0 when each source counts -|sinks| and each sink +|sources|."""
    ns, nt = sources.agg(F.count("*").alias("ns")), sinks.agg(F.count("*").alias("nt"))
    s, t = sources.select("name", F.lit(True).alias("s")), sinks.select("name", F.lit(True).alias("t"))
    out = nodes.select("name").join(s, "name", "left").join(t, "name", "left").crossJoin(ns).crossJoin(nt)
    return out.select("name", F.when(F.col("s"), -F.col("nt")).when(F.col("t"), F.col("ns")).otherwise(0).alias("demand"))


# Paths as array columns of edges.


def is_continuous(edges: Column) -> Column:
    """Each edge begins where the one before ends; an empty path is fine."""
    tail = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 1, F.lit(0)))
    return F.coalesce(F.forall(F.zip_with(F.slice(edges, F.lit(1), F.greatest(F.size(edges) - 1, F.lit(0))), tail, lambda a, b: a["post"] == b["pre"]), lambda x: x), F.lit(True))


def path_weights(edges: Column) -> dict[str, Column]:
    """length, total, mean, min and max weight; zeros for an empty path."""
    w = F.transform(edges, lambda e: e["weight"])
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    zero = F.lit(0.0)
    return {"length": F.size(edges), "total_weight": total, "mean_weight": F.coalesce(F.try_divide(total, F.size(edges)), zero), "min_weight": F.coalesce(F.array_min(w), zero), "max_weight": F.coalesce(F.array_max(w), zero)}


def reverse_path(edges: Column) -> Column:
    return F.reverse(F.transform(edges, lambda e: e.withField("pre", e["post"]).withField("post", e["pre"])))


def concat_paths(a: Column, b: Column) -> Column:
    """Both, if the second begins where the first ends or one is empty; else an error."""
    fits = (F.size(a) == 0) | (F.size(b) == 0) | (F.try_element_at(a, F.lit(-1))["post"] == F.try_element_at(b, F.lit(1))["pre"])
    return F.when(F.assert_true(fits, F.lit("the second path must begin where the first ends")).isNull(), F.concat(a, b))


def path_nodes(edges: Column) -> Column:
    return F.when(F.size(edges) == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array(F.get(edges, F.lit(0))["pre"]), F.transform(edges, lambda e: e["post"])))


def path_types(edges: Column) -> Column:
    return F.transform(edges, lambda e: e["connection_type"])
