"""Null models of networks, and significance against them. Draws are hashes of (seed, key): the same on any cluster."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurograph.sources.tables import written


def draw(seed: int, *keys: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def ranked(df: DataFrame, order: list[Column], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive numbers within ``by`` in the order of ``order``, whose first column must be a hash: ranks within its top bits, and the sizes of the parts
    before. There are as many parts as shuffle partitions, and 64 at least, so the window over a group's parts is small. Rows that were exploded pass for
    small, and would be broadcast: so the join is told to sort, as its window has done already."""
    parts = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.withColumn("_part", F.shiftrightunsigned(order[0], 64 - (parts - 1).bit_length()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n")).select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    return inside.hint("merge").join(offsets, [*by, "_part"]).withColumn(name, F.col("_rank") + F.col("_off")).drop("_part", "_rank", "_off")


def configuration_model(edges: DataFrame, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, pre, post): the edges' targets dealt out anew within ``by``, all degrees kept; loops and parallel edges may arise. Two numberings joined.

    ``edges`` may have (pre, post, uid); rows must be distinct by these for the draws to be.
    """
    ids = [c for c in ("pre", "post", "uid", "connection_type") if c in edges.columns and c not in by]
    own = edges.groupBy(*by, *ids).agg(F.count("*").alias("_m")).withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))))
    a = ranked(own.select(*by, "pre", draw(seed, *by, *ids, "_c").alias("_h")), [F.col("_h"), F.col("pre")], "_k", by).select(*by, "_k", "pre")
    b = ranked(own.select(*by, "post", draw(seed + 7919, *by, *ids, "_c").alias("_h")), [F.col("_h"), F.col("post")], "_k", by).select(*by, "_k", "post")
    return a.hint("merge").join(b, [*by, "_k"]).select(*by, "pre", "post")


def edge_swap(edges: DataFrame, seed: int, rounds: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, pre, post) of a simple graph with the degrees of ``edges`` (distinct pairs, no loops) within each group of ``by``: in each round edges are paired at
    random, and a pair swaps targets if neither new edge is a loop, was there, or is made twice. ``rounds`` is ln(number of edges) by default."""
    now = written(edges.select(*by, "pre", "post").where("pre <> post").distinct(), "swap")
    rounds = max(1, int(math.log(max(2, now.count())))) if rounds is None else rounds
    if isinstance(rounds, bool) or not isinstance(rounds, int):
        raise ValueError("rounds must be an integer")
    for r in range(rounds):
        numbered = ranked(now.withColumn("_h", draw(seed + r, *by, "pre", "post")), [F.col("_h"), F.col("pre"), F.col("post")], "_k", by).select(*by, "pre", "post", F.expr("(_k - 1) div 2").alias("p"), ((F.col("_k") - 1) % 2).alias("s"))
        a, b = numbered.where("s = 0").select(*by, "p", F.col("pre").alias("a"), F.col("post").alias("b")), numbered.where("s = 1").select(*by, "p", F.col("pre").alias("c"), F.col("post").alias("d"))
        pairs = a.join(b, [*by, "p"], "left")
        made = pairs.where("c is not null").select(*by, "p", F.inline(F.array(F.struct(F.col("a").alias("pre"), F.col("d").alias("post")), F.struct(F.col("c").alias("pre"), F.col("b").alias("post")))))
        there = now.withColumn("there", F.lit(True))
        known = made.join(there, [*by, "pre", "post"], "left").withColumn("old", F.col("there").isNotNull() | (F.col("pre") == F.col("post")))
        first = known.groupBy(*by, "pre", "post").agg(F.min("p").alias("q"))
        bad = known.join(first, [*by, "pre", "post"]).where(F.col("old") | (F.col("p") != F.col("q"))).select(*by, "p").distinct().withColumn("bad", F.lit(True))
        kept = pairs.join(bad, [*by, "p"], "left")
        swap = F.col("c").isNotNull() & F.col("bad").isNull()
        both = F.array(F.struct(F.col("a").alias("pre"), F.when(swap, F.col("d")).otherwise(F.col("b")).alias("post")), F.struct(F.col("c").alias("pre"), F.when(swap, F.col("b")).otherwise(F.col("d")).alias("post")))
        now = written(kept.select(*by, F.inline(both)).where("pre is not null"), "swap", now)
    return now


def random_edges(nodes: DataFrame, m: int, seed: int, replicates: int = 1) -> DataFrame:
    """(replicate, pre, post) of G(n, m): ``m`` distinct pairs without loops. Pairs are drawn by number, a few too many, and the first ``m`` distinct ones of
    least hash stay."""
    n, by = nodes.count(), ("replicate",)
    if m > n * (n - 1):
        raise ValueError("more edges than pairs")
    numbered = ranked(nodes.select("name", draw(seed, "name").alias("_h")), [F.col("_h"), F.col("name")], "_k").select((F.col("_k") - 1).alias("k"), "name")
    dense = m * 3 > n * (n - 1)
    tries = n * (n - 1) if dense else int(m + 6 * math.sqrt(m + 1) + m * m / max(1, n * (n - 1)) * 1.5) + 16
    each = nodes.sparkSession.range(tries * replicates).select(F.expr(f"id div {tries}").cast("int").alias("replicate"), (F.col("id") % tries).alias("i"))
    codes = each.select("replicate", (F.col("i") if dense else F.pmod(draw(seed + 1, "replicate", "i"), F.lit(n * (n - 1)))).alias("code")).distinct()
    chosen = ranked(codes.withColumn("_h", draw(seed + 2, "replicate", "code")), [F.col("_h"), F.col("code")], "_c", by).where(F.col("_c") <= m)
    pairs = chosen.select("replicate", F.expr(f"code div {n - 1}").alias("i"), (F.col("code") % (n - 1)).alias("j0")).select("replicate", "i", (F.col("j0") + (F.col("j0") >= F.col("i")).cast("int")).alias("j"))
    a, b = numbered.select(F.col("k").alias("i"), F.col("name").alias("pre")), numbered.select(F.col("k").alias("j"), F.col("name").alias("post"))
    return pairs.join(a, "i").join(b, "j").select("replicate", "pre", "post")


#: Tries that one row makes at once.
CHUNK = 1 << 16


def stub_matching(edges: DataFrame, types: DataFrame, seed: int) -> DataFrame:
    """For each pair of types as many distinct random pairs between their nodes as there are edges, without loops.

    Pairs are drawn by number, as in ``random_edges``: a few too many of which the least hashes stay, or all numbers where edges are dense. The tries of a pair
    of types are made in chunks, which are dealt to tasks, and ranked by parts. Groups without enough pairs give what they have.
    """
    a, b = (types.select(F.col("name").alias(s), F.col("type").alias(f"{s}_type")) for s in ("pre", "post"))
    size = types.groupBy("type").agg(F.count("*").alias("size"))
    counts = edges.join(a, "pre").join(b, "post").groupBy("pre_type", "post_type").agg(F.count("*").alias("m"))
    counts = counts.join(size.select(F.col("type").alias("pre_type"), F.col("size").alias("A")), "pre_type").join(size.select(F.col("type").alias("post_type"), F.col("size").alias("B")), "post_type")
    same = F.col("pre_type") == F.col("post_type")
    counts = counts.withColumn("width", F.when(same, F.col("B") - 1).otherwise(F.col("B"))).withColumn("N", F.col("A") * F.col("width")).where("N > 0")
    dense = F.col("m") * 3 > F.col("N")
    tries = F.when(dense, F.col("N")).otherwise((F.col("m") + 6 * F.sqrt("m") + 1.5 * F.col("m") * F.col("m") / F.col("N") + 16).cast("bigint"))
    group = ["pre_type", "post_type"]
    chunks = counts.withColumn("tries", tries).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(tries - 1) div {CHUNK}")))).repartition(*group, "chunk")
    begin = F.col("chunk") * CHUNK
    tried = chunks.withColumn("i", F.explode(F.sequence(begin, F.least(begin + CHUNK, F.col("tries")) - 1)))
    tried = tried.select(*group, "m", "width", F.when(dense, F.col("i")).otherwise(F.pmod(draw(seed, *group, "i"), F.col("N"))).alias("code")).distinct()
    kept = ranked(tried.withColumn("_h", draw(seed + 1, *group, "code")), [F.col("_h"), F.col("code")], "k", tuple(group)).where("k <= m").withColumn("i", F.expr("code div width")).withColumn("j", F.col("code") % F.col("width"))
    kept = kept.withColumn("j", F.when(same & (F.col("j") >= F.col("i")), F.col("j") + 1).otherwise(F.col("j")))
    place = ranked(types.select("name", "type", draw(seed + 2, "name").alias("_h")), [F.col("_h"), F.col("name")], "at", ("type",)).withColumn("at", F.col("at") - 1)
    x, y = place.select(F.col("type").alias("pre_type"), F.col("at").alias("i"), F.col("name").alias("pre")), place.select(F.col("type").alias("post_type"), F.col("at").alias("j"), F.col("name").alias("post"))
    return kept.select(*group, "i", "j").join(x, ["pre_type", "i"]).join(y, ["post_type", "j"]).select("pre", "post", *group)


def _random_within(edges: DataFrame, by: str, seed: int) -> DataFrame:
    """G(n, m) of each group's own ends and number of edges: stub matching of a group with itself, names told apart by their group."""
    inside = lambda c: F.to_json(F.struct(F.col(by).cast("string").alias("g"), F.col(c).alias("n")))
    marked = edges.select(inside("pre").alias("pre"), inside("post").alias("post"), by)
    types = marked.select(F.explode(F.array("pre", "post")).alias("name"), F.col(by).alias("type")).distinct()
    out = stub_matching(marked.select("pre", "post"), types, seed)
    return out.select(F.col("pre_type").alias(by), *[F.get_json_object(c, "$.n").alias(c) for c in ("pre", "post")])


MODES = ("edge-swap", "configuration-model", "num-nodes-edges", "stub-matching")


def randomize(edges: DataFrame, mode: str, seed: int, nodes: DataFrame | None = None, rounds: int | None = None, multiplier: int | None = None, subgroups: str | None = None) -> DataFrame:
    """(subgroups, pre, post) of one null graph.

    ``multiplier`` is the number of swaps for each edge, ln(number of edges) by default: a round tries one for every two edges. ``subgroups`` names a column
    of ``edges``: each of its groups is randomized by itself, edges without a group are left out. Stub matching takes types from ``nodes`` (name, type).
    """
    if multiplier is not None and (isinstance(multiplier, bool) or not isinstance(multiplier, int)):
        raise ValueError("the multiplier must be an integer")
    if subgroups is not None and subgroups not in edges.columns:
        raise ValueError(f"no column {subgroups!r} that names subgroups")
    by = (subgroups,) if subgroups else ()
    edges = edges.where(F.col(subgroups).isNotNull()) if subgroups else edges
    if mode == "edge-swap":
        return edge_swap(edges, seed, 2 * multiplier if multiplier is not None else rounds, by)
    if mode == "configuration-model":
        return configuration_model(edges, seed, by)
    if mode == "num-nodes-edges":
        return _random_within(edges, subgroups, seed) if subgroups else random_edges(nodes, edges.count(), seed).drop("replicate")
    if mode == "stub-matching":
        return stub_matching(edges, nodes, seed).select("pre", "post")
    raise ValueError(f"unknown mode {mode!r}")


def replicates(edges: DataFrame, mode: str, n: int, seed: int = 0, nodes: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """(replicate, pre, post) of ``n`` null graphs, drawn by one plan with the replicate as a key."""
    if mode == "num-nodes-edges":
        return random_edges(nodes, edges.count(), seed, n)
    if mode not in ("edge-swap", "configuration-model"):
        raise ValueError(f"unknown mode {mode!r}")
    each = lambda df: df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if mode == "edge-swap":
        return edge_swap(each(edges), seed, rounds, ("replicate",))
    # edges are numbered once, and each replicate deals their targets out in an order of its own
    ids = [c for c in ("pre", "post", "uid", "connection_type") if c in edges.columns]
    own = edges.groupBy(*ids).agg(F.count("*").alias("_m")).withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))))
    numbered = written(ranked(own.withColumn("_h", draw(seed, *ids, "_c")), [F.col("_h"), *[F.col(c) for c in ids], F.col("_c")], "_k").select("_k", "pre", "post"), "stubs")
    dealt = each(numbered.select("_k", "post")).withColumn("_h", draw(seed + 7919, "replicate", "_k"))
    dealt = ranked(dealt, [F.col("_h"), F.col("_k")], "_r", ("replicate",)).select("replicate", F.col("_r").alias("_k"), "post")
    return dealt.join(numbered.select("_k", "pre"), "_k").select("replicate", "pre", "post")


def upper_tail(z: Column) -> Column:
    """1 - Phi(z) of the normal distribution. Of test statistics, a row a test: so a call of the library's function a value does no harm."""

    def tail(x: pd.Series) -> pd.Series:
        return pd.Series(0.5 * np.fromiter(map(math.erfc, x.to_numpy(float) / math.sqrt(2)), float, len(x)))

    return F.pandas_udf(tail, "double")(z)


def z_scores(observed: DataFrame, null: DataFrame, key: str) -> DataFrame:
    """(key, observed, null_mean, null_std, z, p) from (key, value) and (key, replicate, value); z is 0 where the null doesn't vary."""
    m = null.groupBy(key).agg(F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_std"))
    z = F.coalesce(F.try_divide(F.col("observed") - F.col("null_mean"), F.col("null_std")), F.lit(0.0))
    return observed.select(key, F.col("value").cast("double").alias("observed")).join(m, key).withColumn("z", z).withColumn("p", upper_tail(F.col("z")))


def adjust(tests: DataFrame, method: str = "bh", p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """``tests`` with ``p_adjusted``, Benjamini-Hochberg or -Yekutieli, within ``by``: the smallest of p * m / rank over ranks from here on."""
    if method not in ("bh", "by"):
        raise ValueError("method must be bh or by")
    groups = Window.partitionBy(*by)
    up, down = groups.orderBy(p), groups.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)
    m = F.count(p).over(groups)
    ranked = tests.withColumn("_rank", F.rank().over(up) + F.count("*").over(groups.orderBy(p).rangeBetween(0, 0)) - 1).withColumn("_m", m)
    scale = F.aggregate(F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda a, k: a + 1.0 / k) if method == "by" else F.lit(1.0)
    return ranked.withColumn("p_adjusted", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank") * scale).over(down))).drop("_rank", "_m")


def bootstrap(members: DataFrame, incoming: DataFrame, draws: int, k: int, seed: int) -> DataFrame:
    """(draw, type, share): ``k`` nodes drawn with replacement ``draws`` times; the share of the drawn nodes' incoming edges of each type.

    ``incoming`` is (post, type). Its counts are taken first, so that the draws join counts, not edges.
    """
    n = members.count()
    named = ranked(members.select("name", draw(seed, "name").alias("_h")), [F.col("_h"), F.col("name")], "_k").select((F.col("_k") - 1).alias("i"), "name")
    picks = members.sparkSession.range(draws * k).select(F.expr(f"id div {k}").alias("draw"), F.pmod(draw(seed + 1, "id"), F.lit(n)).alias("i"))
    counts = incoming.groupBy(F.col("post").alias("name"), "type").agg(F.count("*").alias("n"))
    seen = picks.join(named, "i").join(counts, "name").groupBy("draw", "type").agg(F.sum("n").alias("n"))
    total = seen.groupBy("draw").agg(F.sum("n").alias("total"))
    return seen.join(total, "draw").select("draw", "type", (F.col("n") / F.col("total")).alias("share"))
