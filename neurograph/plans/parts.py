"""Queries over building blocks: building and changing networks, readers, stored tables, expression tables, trials, inputs and parameters of models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from neurograph.model import CHEMICAL, GAP, Network, signature
from neurograph.operators import build, fit, layout, neighbors, nulls, omics, select, signal, simulate, stim
from neurograph.plans import views as v
from neurograph.plans.graph import _EXPRESSION, NAMES, _VALUES, expression, named
from neurograph.plans.registry import n, query, r
from neurograph.plans.series import B, K, S
from neurograph.sources import readers, writers
from neurograph.sources.tables import shared_folder

U = f"WITH {v.USER}"
EDGE = ("pre", "post", "connection_type", "weight")
STEPS = f"{U} SELECT pre, post, connection_type, {r('weight')} AS weight FROM steps"


def folder(spark, label: str) -> str:
    return f"{shared_folder(spark)}/neurograph/{label}-{uuid.uuid4().hex}"


def without_edges(net: Network) -> Network:
    return net.with_(connections=net.connections.limit(0))


@query(f"{U} SELECT pre AS first_name, post AS second_name, connection_type FROM steps")
def edges_by_name(spark, sf):
    return select.by_name(v.users(spark, sf).connections).selectExpr("names.pre AS first_name", "names.post AS second_name", "connection_type")


@query(f"{STEPS} WHERE pre = '7'")
def outgoing_edges(spark, sf):
    return neighbors.outgoing(v.users(spark, sf), "7").select(*EDGE)


@query(f"{STEPS} WHERE post = '7'")
def incoming_edges(spark, sf):
    return neighbors.incoming(v.users(spark, sf), "7").select(*EDGE)


@query(f"{U} SELECT name, type, {n('0')} AS n_edges FROM users")
def all_edges_removed(spark, sf):
    net = build.remove_all_connections(v.users(spark, sf))
    return net.neurons.crossJoin(net.connections.agg(F.count("*").alias("n_edges")))


@query(f"{U} SELECT name, type, CASE WHEN type = 'sensory' THEN 'x' END AS mark FROM users")
def property_set(spark, sf):
    return build.set_property(v.users(spark, sf).neurons, "mark", F.lit("x"), F.col("type") == "sensory")


@query("SELECT 'c' || c_custkey AS name, 'customer' AS category, CASE c_custkey WHEN 1 THEN 'first' WHEN 2 THEN 'second' END AS place FROM customer")
def neurons_created(spark, sf):
    labels = v.read(spark, sf, "customer").select(F.concat(F.lit("c"), v.text("c_custkey")).alias("name"))
    return build.create_neurons(labels, category="customer", place={"c1": "first", "c2": "second"})


@query(f"{U} SELECT name, CASE WHEN type = 'sensory' THEN type END AS type FROM users")
def neurons_from_network(spark, sf):
    net = v.users(spark, sf)
    return build.neurons_from(net.with_(neurons=net.neurons.where("type = 'sensory'")), net, data=False).neurons


@query(f"{U} SELECT pre, post, '{CHEMICAL}' AS connection_type, {r('sum(weight)')} AS weight, {n()} AS kinds FROM steps GROUP BY pre, post")
def connections_created(spark, sf):
    net = v.users(spark, sf)
    rows = net.connections.groupBy("pre", "post").agg(F.sum("weight").alias("weight"), F.count("*").alias("kinds"))
    return build.setup_connections(without_edges(net), rows, CHEMICAL).connections


@query(STEPS)
def connections_from_network(spark, sf):
    net = v.users(spark, sf)
    click = F.col("connection_type") == "click"
    return build.connections_from(net.with_(connections=net.connections.where(click)), net.with_(connections=net.connections.where(~click))).connections


@query(f"""{U} SELECT pre, post, CASE connection_type WHEN 'click' THEN '{CHEMICAL}' ELSE '{GAP}' END AS connection_type, CASE connection_type WHEN 'click' THEN 'orange' ELSE 'gray' END AS color,
{n("CASE connection_type WHEN 'click' THEN 0 ELSE 1 END")} AS uid, {r('weight')} AS weight FROM steps WHERE connection_type IN ('click', 'view')""")
def network_of_adjacencies(spark, sf):
    net = v.users(spark, sf)
    maps = [net.connections.where(F.col("connection_type") == k).groupBy("pre").agg(F.map_from_entries(F.collect_list(F.struct("post", "weight"))).alias("adjacency")) for k in ("click", "view")]
    return readers.build_network(net.neurons, *maps).connections


@query(f"""{U} SELECT 'n' || pre AS pre, 'n' || post AS post, connection_type, {r('weight')} AS weight, {n('CAST(pre AS BIGINT) + 2')} AS y FROM steps""")
def fly_network(spark, sf):
    net = v.users(spark, sf)
    ids = net.neurons.select(F.col("name").alias("root_id"))
    where = ids.select("root_id", F.format_string("[%s  %d 5]", "root_id", F.col("root_id").cast("bigint") + 2).alias("position"))
    edges = net.connections.select(F.col("pre").alias("pre_root_id"), F.col("post").alias("post_root_id"), F.col("weight").alias("syn_count"), F.col("connection_type").alias("nt_type"))
    made = readers.fly(ids.select("root_id", F.concat(F.lit("n"), "root_id").alias("name"), F.lit("g").alias("group")), where, ids.withColumn("length_nm", F.lit(1)), edges)
    return made.connections.join(made.neurons.select(F.col("name").alias("pre"), F.get("position", F.lit(1)).alias("y")), "pre")


@query(f"""WITH {_VALUES}, l AS (SELECT CASE WHEN regexp_matches(name, '^[A-Z]+0?[0-9]$') THEN regexp_extract(name, '^([A-Z]+)0?([0-9])$', 1) || '0' || name[-1:] ELSE name END AS name FROM names WHERE length(name) <> 5)
SELECT name, l.name IS NOT NULL AS found FROM names LEFT JOIN l USING (name)""")
def lineage_joined(spark, sf):
    """Lineages name VB01 as VB1; names of five letters have none."""
    net = named(spark)
    known = [(x[:-2] + x[-1] if x[-2] == "0" else x, "AB") for x in NAMES if len(x) != 5]
    found, lost = readers.join_lineage(net.neurons, spark.createDataFrame(known, "Neuron string, lineage string"))
    return found.select("name", F.lit(True).alias("found")).union(lost.select("name", F.lit(False)))


@query(f"WITH {v.SERIES} SELECT series AS recording, 'A' || recording AS neuron, {n('0')} AS trial, t, {r('value')} AS value FROM series WHERE series % 3 <> 0")
def recordings_labelled(spark, sf):
    """Traces of one neuron each; every third label isn't sure."""
    name = F.concat(F.lit("A"), v.text("label"), F.when(F.col("vec_id") % 3 == 0, "?").otherwise(""))
    raw = v.read(spark, sf, "embeddings").select(F.col("vec_id").alias("recording"), F.array(F.col("embedding").cast("array<double>")).alias("trace_array"), F.create_map(F.lit("1"), F.struct(name.alias("label"))).alias("labeled"))
    return readers.recordings(raw)


@query(STEPS)
def saved_and_loaded(spark, sf):
    path = folder(spark, "saved")
    writers.save(v.users(spark, sf), path)
    return writers.load(spark, path).connections


@query(f"{U} SELECT pre AS source, post AS target, {r('weight')} AS weight FROM steps")
def edges_as_json(spark, sf):
    parsed = writers.edges_json(v.users(spark, sf)).select(F.from_json("value", "kind string, source string, target string, weight double").alias("j"))
    return parsed.select("j.*").where("kind = 'edge'").drop("kind")


@query(f"SELECT user_id AS neuron, {n('count(*) * 2')} AS n FROM events GROUP BY ALL")
def trials_stored(spark, sf):
    """A store that is written twice has both."""
    path, trials = folder(spark, "trials"), v.read(spark, sf, "events").select("user_id", "value")
    for _ in range(2):
        fit.save_trials(trials, path)
    return fit.load_trials(spark, path).groupBy(F.col("user_id").alias("neuron")).agg(F.count("*").alias("n"))


@query("SELECT CAST(user_id AS VARCHAR) AS neuron, arg_min(event_type || CASE event_id % 2 WHEN 0 THEN '' ELSE ',x' END, event_id) AS ligands FROM events GROUP BY ALL")
def ligands_of_neurons(spark, sf):
    second = F.when(F.col("event_id") % 2 == 0, "").otherwise("x")
    table = v.read(spark, sf, "events").select(v.text("user_id").alias("Neuron"), F.col("event_type").alias("Neurotransmitter 1"), second.alias("Neurotransmitter 2"), F.col("event_id").alias("ord"))
    return omics.ligands(table).select("neuron", F.array_join("ligands", ",").alias("ligands"))


def wide(spark, sf, value):
    """Types of events as genes, and a column for each fifth of the users."""
    parts = [value(F.col("user_id") % 5 == k).alias(f"k{k}") for k in range(5)]
    return v.read(spark, sf, "events").groupBy(F.col("event_type").alias("gene_name")).agg(*parts)


@query("""SELECT 'k' || user_id % 5 AS neuron, event_type AS receptor, CASE event_type WHEN 'click' THEN 'B' WHEN 'view' THEN 'C' ELSE '' END AS ligand FROM events GROUP BY ALL HAVING count(*) % 3 <> 0""")
def receptors_of_neurons(spark, sf):
    table = wide(spark, sf, lambda c: F.count(F.when(c, 1)) % 3 != 0)
    return omics.receptors(table, spark.createDataFrame([("click", "A", 2), ("click", "B", 1), ("view", "C", 1)], "gene string, ligand string, ord int"))


@query(f"""SELECT {n('level')} AS threshold, event_type AS gene, 'k' || user_id % 5 AS neuron, count(*) FILTER (value > level * 100) > 0 AS expressed FROM events, range(1, 5) AS l(level) GROUP BY ALL""")
def expression_by_threshold(spark, sf):
    return omics.threshold_table({level: wide(spark, sf, lambda c, level=level: F.count(F.when(c & (F.col("value") > level * 100), 1))) for level in range(1, 5)}, "gene_name")


@query(f"SELECT 'p' || vec_id // 64 AS network, 'n' || vec_id % 64 AS pre, 'n' || t AS post, {r('value')} AS weight FROM (SELECT vec_id, unnest(range(0, 64)) AS t, unnest(embedding) AS value FROM embeddings) WHERE value <> 0")
def peptide_edges(spark, sf):
    """Embeddings as a stack of square blocks of 64 rows."""
    e = v.read(spark, sf, "embeddings")
    pairs = e.select(F.expr("vec_id div 64").alias("ord")).distinct().withColumn("pair", F.concat(F.lit("p"), v.text("ord")))
    return omics.peptide_networks(e.select(F.col("vec_id").alias("idx"), F.col("embedding").alias("values")), pairs, spark.range(64).select(F.col("id").alias("ord"), F.concat(F.lit("n"), v.text("id")).alias("name")))


@query(f"WITH {_EXPRESSION} SELECT DISTINCT neuron FROM expression WHERE expressed AND gene IN ('click', 'view') AND neuron NOT IN ('u1', 'u2')")
def enriched_neurons(spark, sf):
    return omics.enriched(expression(spark, sf), ["click", "view"], ["u1", "u2"])


@query(f"""{U}, g AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS neuron, 'inx-' || event_id % 9 AS gene FROM events WHERE value > 50)
SELECT DISTINCT pre, post FROM steps JOIN g a ON a.neuron = pre AND a.gene = 'inx-1' JOIN g b ON b.neuron = post AND b.gene = 'inx-2' WHERE connection_type = 'view'""")
def heteromer_edges(spark, sf):
    genes = v.read(spark, sf, "events").where("value > 50").select(v.text("user_id").alias("neuron"), F.concat(F.lit("inx-"), v.text(F.col("event_id") % 9)).alias("gene"), F.lit(True).alias("expressed"))
    return omics.with_pair(omics.subunit_pairs(v.users(spark, sf).connections, genes, "view"), "inx-1", "inx-2")


@query(f"""{U}, l AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS neuron, event_type AS ligand FROM events WHERE value > 120), x AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS neuron, event_type AS ligand FROM events WHERE value < 40),
e AS (SELECT pre, post, connection_type FROM steps), k AS (SELECT e.pre, e.post, e.connection_type, count(x.ligand) AS k FROM e LEFT JOIN l ON l.neuron = e.pre LEFT JOIN x ON x.neuron = e.post AND x.ligand = l.ligand GROUP BY ALL),
h AS (SELECT k, count(*) AS n FROM k GROUP BY ALL) SELECT {n('k')} AS n_pairs, {n('n')} AS n, {r('sum(n) OVER (ORDER BY k) / sum(n) OVER ()')} AS share FROM h""")
def pair_count_histogram(spark, sf):
    e = v.read(spark, sf, "events").select(v.text("user_id").alias("neuron"), F.col("event_type").alias("ligand"), "value")
    edges = v.users(spark, sf).connections
    receptors = e.where("value < 40").select("neuron", F.lit("r").alias("receptor"), "ligand")
    # pairs hold for every type of edge between two nodes
    pairs = omics.putative_pairs(edges.withColumn("connection_type", F.lit(CHEMICAL)), e.where("value > 120"), receptors)
    return omics.pair_histogram(omics.with_putative(edges, pairs))


@query(f"{S} SELECT DISTINCT {K}, '3' AS age FROM samples")
def trial_metadata(spark, sf):
    """An entry that is set twice has its second value."""
    trials = v.samples(spark, sf).select("neuron", "trial").distinct().withColumn("metadata", F.create_map(F.lit("age"), F.lit("2"), F.lit("site"), F.lit("a")))
    return signal.get_metadata(signal.add_metadata(trials, "age", "3"), "age")


@query(f"{S} SELECT {K}, t, {r('CASE WHEN neuron % 2 = 0 THEN value * 2 ELSE value END')} AS value FROM samples")
def trial_replaced(spark, sf):
    s = v.samples(spark, sf).select("neuron", "trial", "t", "value")
    return signal.replace_trial(s, s.where("neuron % 2 = 0").withColumn("value", F.col("value") * 2))


@query(f"{S} SELECT {K}, {r('avg(value)')} AS mean FROM samples GROUP BY ALL")
def stim_one_feature(spark, sf):
    return stim.extract_feature(v.samples(spark, sf), B, stim.FEATURES.index("mean"))


@query(f"""{S} SELECT {K}, t, {r('CASE WHEN t > 2 AND t < 10 THEN 3 ELSE 0 END')} AS step, {r('CASE WHEN t > 2 AND t < 10 THEN 3 * exp(-(t - 2) / 4.0) ELSE 0 END')} AS adapting, {r('t * t / 2.0')} AS given,
{r('value')} AS looked_up FROM samples""")
def model_inputs(spark, sf):
    s, t = v.samples(spark, sf), F.col("t")
    one = s.select("neuron", "trial", "t", simulate.step_input(t, 2, 10, 3).alias("step"), simulate.adapting_input(t, 2, 10, 3, 4).alias("adapting"), simulate.function_input(t, lambda x: x * x / 2).alias("given"))
    # a time of a trial as one key, as times of a series are unique
    key = F.struct("neuron", "trial", "t")
    found = simulate.series_input(one.withColumn("t", key), s.select(key.alias("t"), F.col("value").alias("value")))
    return found.select("neuron", "trial", "t.t", "step", "adapting", "given", F.col("value").alias("looked_up"))


@query(f"""SELECT 'n' || n_nationkey AS name, {r("CASE WHEN n_regionkey = 1 THEN n_nationkey + 0.5 ELSE 2 END")} AS gain, {r('n_nationkey + 1')} AS time_constant, 'tanh' AS activation,
{r("CASE WHEN n_regionkey = 1 THEN 7 ELSE 0.25 END")} AS weight FROM nation""")
def model_parameters(spark, sf):
    """Gains and weights of all, then those of single nodes and edges of one region; each node has an edge to the first."""
    rows = v.read(spark, sf, "nation").withColumn("name", F.concat(F.lit("n"), v.text("n_nationkey")))
    nodes = rows.select("name", F.lit(1.0).alias("gain"), (F.col("n_nationkey") + 1.0).alias("time_constant"), F.lit(0.0).alias("baseline"), F.lit("linear").alias("activation"), F.lit(False).alias("static"))
    p = simulate.Parameters(nodes, rows.select(F.col("name").alias("pre"), F.lit("n0").alias("post"), F.lit(1.0).alias("weight")))
    p = p.set_nodes(gain=2.0, activation="tanh").set_edges(weight=0.25)
    some = rows.where("n_regionkey = 1")
    p = p.update_nodes(some.select("name", (F.col("n_nationkey") + 0.5).alias("gain"))).update_edges(some.select(F.col("name").alias("pre"), F.lit("n0").alias("post"), F.lit(7.0).alias("weight")))
    return p.nodes.join(p.edges.select(F.col("pre").alias("name"), "weight"), "name").select("name", "gain", "time_constant", "activation", "weight")


@query(f"WITH {v.SERIES}, s AS (SELECT *, value * 2 + t / 100.0 AS rate FROM series) SELECT series, {r('avg(pow(rate - value, 2))')} AS squared, {r('1 - corr(rate, value)')} AS correlated FROM s GROUP BY ALL")
def losses(spark, sf):
    s = v.series(spark, sf).select("series", F.col("value").alias("real"), (F.col("value") * 2 + F.col("t") / 100).alias("rate"))
    return s.groupBy("series").agg(fit.squared_error().alias("squared"), fit.correlation_loss().alias("correlated"))


def placed(spark, sf) -> Network:
    """Customers with places made of their keys."""
    key = F.col("c_custkey")
    place = F.struct((key % 100).cast("double").alias("AP"), (key % 11 - 5).cast("double").alias("LR"), (key % 7).cast("double").alias("DV"))
    nodes = v.read(spark, sf, "customer").select(F.concat(F.lit("c"), v.text("c_custkey")).alias("name"), place.alias("position"))
    return Network("placed", nodes, v.trade(spark, sf).connections)


@query("SELECT 'c' || c_custkey AS name FROM customer WHERE c_custkey % 100 BETWEEN 10 AND 50 AND 5 - c_custkey % 11 BETWEEN -2 AND 3")
def inside_limits(spark, sf):
    return select.within(placed(spark, sf).neurons, {"AP": (10, 50), "LR": (-2, 3)}).select("name")


@query(f"SELECT 'c' || c_custkey AS name, {r('CASE c_custkey WHEN 1 THEN 8 ELSE c_custkey % 100 END')} AS AP, {r('-(c_custkey % 7)')} AS DV FROM customer")
def positions_in_plane(spark, sf):
    return layout.positions(placed(spark, sf), fixed={"c1": {"AP": 8}})


@query(f"{U} SELECT name, type FROM users WHERE type = 'sensory' AND name <> '3' OR name IN ('1', '2')")
def group_members(spark, sf):
    """A group to which two nodes are added, one of them twice, and from which one is taken."""
    net = v.users(spark, sf)
    net = net.make_neuron_group("some", net.neurons.where("type = 'sensory'")).add_to_group("some", ["1", "2"]).add_to_group("some", ["1"])
    return net.remove_from_group("some", ["3"]).group("some")


@query("SELECT n_name AS name, 'worm:region=' || n_regionkey || '_worm:stage=' || n_nationkey AS signature FROM nation")
def context_signatures(spark, sf):
    """Without private names and the name itself, in order."""
    entries = F.create_map(F.lit("stage"), v.text("n_nationkey"), F.lit("_hidden"), F.lit("1"), F.lit("name"), F.col("n_name"), F.lit("region"), v.text("n_regionkey"))
    return v.read(spark, sf, "nation").select(F.col("n_name").alias("name"), signature(entries, F.lit("worm")).alias("signature"))


@query(f"{U} SELECT name, type FROM users")
def network_copied(spark, sf):
    """A copy without data has names only, and the names find the data again."""
    net = v.users(spark, sf)
    bare = net.copy("bare", "deep_without_data").neurons
    return bare.join(net.neurons, bare.columns)


@query(f"""{U}, d AS (SELECT connection_type, pre AS name, 'out' AS side FROM steps UNION ALL SELECT connection_type, post, 'in' FROM steps)
SELECT connection_type, name, side, {n()} AS degree FROM d GROUP BY ALL""")
def randomized_subgroups(spark, sf):
    """The configuration model of each type of edge by itself keeps all degrees within the type."""
    null = nulls.randomize(v.users(spark, sf).connections.select("pre", "post", "connection_type"), "configuration-model", 4, subgroups="connection_type")
    sides = F.inline(F.array(F.struct(F.col("pre").alias("name"), F.lit("out").alias("side")), F.struct(F.col("post").alias("name"), F.lit("in").alias("side"))))
    return null.select("connection_type", sides).groupBy("connection_type", "name", "side").agg(F.count("*").alias("degree"))
