"""Folding: nodes of a class become one node, parallel edges are kept or summed."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurograph.model import Network

#: Endings that tell neurons of a class apart.
SUFFIXES = ("D", "V", "L", "R", "DL", "DR", "VL", "VR", "01", "02", "03", "04", "05", "06", "07", "08", "09", "10", "11", "12", "13")


def merge_map(classes: DataFrame, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """(name, class, first): which node each member becomes, from (name, class, ord).

    Members in exceptions keep their names; an exempt first member of several leaves its whole class as it is. A class of one renames it.
    """
    if not exceptions:
        w = Window.partitionBy("class").orderBy("ord", "name")
        return classes.withColumn("first", F.row_number().over(w) == 1).select("name", "class", "first")
    exempt, all_of, w = F.col("name").isin(*exceptions), Window.partitionBy("class"), Window.partitionBy("class").orderBy("ord", "name")
    ranked = classes.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(all_of)).withColumn("held", F.max(F.when(F.col("k") == 1, exempt)).over(all_of))
    free = ranked.where((F.col("n") == 1) | (~F.col("held") & ~exempt))
    # a class whose other members are all exempt isn't contracted, so its first keeps its name
    merged = free.withColumn("m", F.count("*").over(all_of)).where((F.col("n") == 1) | (F.col("m") > 1))
    return merged.select("name", "class", (F.col("k") == 1).alias("first"))


def fold_network(net: Network, classes: DataFrame, data: str = "clean", exceptions: tuple[str, ...] = (), self_loops: bool = True, name: str | None = None) -> Network:
    """Folds by (name, class, ord). ``collect`` keeps parallel edges, ``clean`` sums them for each (pre, post, connection_type) with what they came from.

    Nodes in no class stay. The first member's attributes stay. Without ``self_loops`` edges between different members of a class go, but a member's
    edge to itself stays.
    """
    if data not in ("collect", "clean"):
        raise ValueError("data must be collect or clean")
    into = merge_map(classes, exceptions)
    pre, post = (into.select(F.col("name").alias(f"_{s}_name"), F.col("class").alias(f"_{s}")) for s in ("pre", "post"))
    edges = net.connections.join(pre, F.col("pre") == F.col("_pre_name"), "left").join(post, F.col("post") == F.col("_post_name"), "left")
    if not self_loops:
        edges = edges.where(~F.coalesce(F.col("_pre") == F.col("_post"), F.lit(False)) | (F.col("pre") == F.col("post")))
    rest = [c for c in net.connections.columns if c not in ("pre", "post")]
    edges = edges.select(F.col("pre").alias("old_pre"), F.col("post").alias("old_post"), F.coalesce("_pre", "pre").alias("pre"), F.coalesce("_post", "post").alias("post"), *rest)
    nodes = net.neurons.join(into.withColumnRenamed("name", "_name"), F.col("name") == F.col("_name"), "left").where(F.coalesce("first", F.lit(True)))
    nodes = nodes.withColumn("name", F.coalesce("class", "name")).select(*net.neurons.columns)
    out = Network(name or f"{net.name}_folded", nodes, edges)
    return out if data == "collect" else out.with_(connections=contract(edges))


def contract(edges: DataFrame, provenance: bool = False) -> DataFrame:
    """One edge for each (pre, post, connection_type): summed weight, how many, and what it came from if ``provenance``."""
    made = [F.sum("weight").alias("weight"), F.count("*").alias("n")]
    if provenance:
        made.append(F.collect_list(F.struct("old_pre", "old_post", "weight")).alias("contraction_data"))
    return edges.groupBy("pre", "post", "connection_type").agg(*made)


def suffix_class(name: Column) -> Column:
    """A name without the longest ending of SUFFIXES whose stem is long enough: over two characters, or two if the stem ends or the ending begins
    with a digit or the stem is MC."""
    out = name
    for size in (1, 2):  # the later, longer one wins
        options = "|".join(s for s in SUFFIXES if len(s) == size)
        stem, end = F.regexp_extract(name, f"^(.*)({options})$", 1), F.regexp_extract(name, f"^(.*)({options})$", 2)
        fits = (F.length(stem) > 2) | (F.length(stem) == 2) & (stem.rlike("[0-9]$") | end.rlike("^[0-9]") | (stem == "MC"))
        out = F.when(end.isNotNull() & (end != "") & fits, stem).otherwise(out)
    return out


def by_suffix(net: Network, **options) -> Network:
    return fold_network(net, net.neurons.select("name", suffix_class(F.col("name")).alias("class"), F.col("name").alias("ord")), **options)


def left_right_classes(neurons: DataFrame) -> DataFrame:
    """(name, class, ord): names that end in L lose it (AVL doesn't) and take their R twin along."""
    left = neurons.where(F.col("name").endswith("L") & (F.col("name") != "AVL")).select("name", F.regexp_replace("name", "L$", "").alias("class"))
    twins = neurons.select("name").join(left.select(F.concat("class", F.lit("R")).alias("name"), "class"), "name")
    return left.withColumn("ord", F.lit(0)).unionByName(twins.withColumn("ord", F.lit(1)))


def join_left_right(net: Network) -> Network:
    return fold_network(net, left_right_classes(net.neurons), data="collect")


def dorso_ventral_classes(neurons: DataFrame) -> DataFrame:
    """(name, class, ord): xD with xV to x (RID isn't one), xDL with xVL to xL, xDR with xVR to xR."""
    one = F.regexp_extract("name", "^(.*)D$", 1)
    two = F.regexp_extract("name", "^(.*)D([LR])$", 1)
    side = F.regexp_extract("name", "^(.*)D([LR])$", 2)
    d = neurons.select("name", F.when(F.col("name").rlike("D$") & (F.col("name") != "RID"), F.struct(F.concat(one, F.lit("V")).alias("twin"), one.alias("class"))).when(F.col("name").rlike("D[LR]$"), F.struct(F.concat(two, F.lit("V"), side).alias("twin"), F.concat(two, side).alias("class"))).alias("s"))
    d = d.where("s is not null").select("name", "s.twin", "s.class")
    pairs = d.join(neurons.select(F.col("name").alias("twin")).distinct(), "twin")
    return pairs.select(F.inline(F.array(F.struct("name", "class", F.lit(0).alias("ord")), F.struct(F.col("twin").alias("name"), "class", F.lit(1).alias("ord")))))


def fold_dorso_ventral(net: Network) -> Network:
    return fold_network(net, dorso_ventral_classes(net.neurons), data="collect")
