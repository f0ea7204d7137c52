"""Queries over networks: folding, statistics, filters, neighbourhoods, joins of networks, annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurograph.operators import build, combine, fold, neighbors, omics, select, stats
from neurograph.model import Network
from neurograph.plans import views as v
from neurograph.plans.registry import n, query, r


def nation_classes(net: Network):
    return net.neurons.select("name", F.col("nation").alias("class"), F.col("name").alias("ord"))


def nations(spark, sf) -> Network:
    """Trade folded to nations, clean."""
    net = v.trade(spark, sf)
    return fold.fold_network(net, nation_classes(net))


def sparse(spark, sf):
    """Pairs of nations that trade more than the average pair: (pre, post, weight)."""
    dense = nations(spark, sf).connections.groupBy("pre", "post").agg(F.sum("weight").alias("weight"))
    return dense.crossJoin(dense.agg(F.avg("weight").alias("mean"))).where("weight > mean").drop("mean")


@query(f"WITH {v.NATION} SELECT pre, post, connection_type, {n('n')} AS n, {r('weight')} AS weight FROM nat")
def fold_clean_nation(spark, sf):
    return nations(spark, sf).connections.select("pre", "post", "connection_type", "n", "weight")


@query(f"""WITH {v.TRADE}, {v.NODES} SELECT a.nation AS pre, b.nation AS post, pre AS old_pre, post AS old_post, connection_type, {r('weight')} AS weight
FROM trade JOIN nodes a ON pre = a.name JOIN nodes b ON post = b.name""")
def fold_collect_nation(spark, sf):
    net = v.trade(spark, sf)
    return fold.fold_network(net, nation_classes(net), data="collect").connections.select("pre", "post", "old_pre", "old_post", "connection_type", "weight")


@query(f"""WITH {v.TRADE}, {v.NODES} SELECT a.nation AS pre, b.nation AS post, connection_type, {n()} AS n, {r('sum(weight)')} AS weight
FROM trade JOIN nodes a ON pre = a.name JOIN nodes b ON post = b.name WHERE a.nation <> b.nation GROUP BY ALL""")
def fold_no_self_loops(spark, sf):
    net = v.trade(spark, sf)
    return fold.fold_network(net, nation_classes(net), self_loops=False).connections.select("pre", "post", "connection_type", "n", "weight")


@query(f"""WITH {v.TRADE}, {v.NODES},
k AS (SELECT name, nation, row_number() OVER (PARTITION BY nation ORDER BY name) AS k FROM nodes),
h AS (SELECT nation, name IN ('c1', 'c2', 's3') AS held FROM k WHERE k = 1),
m AS (SELECT name, CASE WHEN held OR name IN ('c1', 'c2', 's3') THEN name ELSE k.nation END AS class FROM k JOIN h ON k.nation = h.nation)
SELECT a.class AS pre, b.class AS post, connection_type, {n()} AS n, {r('sum(weight)')} AS weight FROM trade JOIN m a ON pre = a.name JOIN m b ON post = b.name GROUP BY ALL""")
def fold_exceptions(spark, sf):
    net = v.trade(spark, sf)
    return fold.fold_network(net, nation_classes(net), exceptions=("c1", "c2", "s3")).connections.select("pre", "post", "connection_type", "n", "weight")


@query(f"""WITH {v.TRADE}, {v.NODES} SELECT a.region || '/' || a.category AS pre, b.region || '/' || b.category AS post, {n()} AS n, {r('sum(weight)')} AS weight
FROM trade JOIN nodes a ON pre = a.name JOIN nodes b ON post = b.name GROUP BY ALL""")
def fold_by_attribute(spark, sf):
    net = v.trade(spark, sf)
    classes = net.neurons.select("name", F.concat_ws("/", "region", "category").alias("class"), F.col("name").alias("ord"))
    folded = fold.fold_network(net, classes)
    return folded.connections.groupBy("pre", "post").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))


@query(f"""WITH {v.TRADE}, {v.NODES} SELECT a.nation AS pre, b.nation AS post, {n('count(DISTINCT connection_type)')} AS n_types, {n('count(DISTINCT pre)')} AS n_sources
FROM trade JOIN nodes a ON pre = a.name JOIN nodes b ON post = b.name GROUP BY ALL""")
def fold_provenance(spark, sf):
    net = v.trade(spark, sf)
    edges = fold.fold_network(net, nation_classes(net), data="collect").connections
    return edges.groupBy("pre", "post").agg(F.countDistinct("connection_type").alias("n_types"), F.countDistinct("old_pre").alias("n_sources"))


NAMES = "AVAL AVAR AVBL AVBR RMEDL RMED RMEL RMER RMEV IL2DL IL2L IL2DR IL2VL I1L VB01 VC04 DA09 MCL MCR AVL RID ADAL M3L M1 DVA SIADL SIAVL AWCL CEPDL CEPVL PVDL AVM ADL URADL URAVL OLQDR OLQVR".split()
_VALUES = "names(name) AS (VALUES " + ", ".join(f"('{x}')" for x in NAMES) + ")"


def named(spark) -> Network:
    """Neurons by name in a ring, with shortcuts."""
    edges = [(a, NAMES[(k * 7 + 1) % len(NAMES)], "chemical-synapse", float(1 + k % 3)) for k, a in enumerate(NAMES)]
    return Network("names", spark.createDataFrame([(x,) for x in NAMES], "name string"), spark.createDataFrame(edges, "pre string, post string, connection_type string, weight double"))


_SUFFIX = """CASE WHEN regexp_matches(name, '(DL|DR|VL|VR|0[1-9]|1[0-3])$') AND (length(name) > 4 OR length(name) = 4 AND (regexp_matches(name, '^.[0-9]') OR regexp_matches(name, '[0-9][0-9]$') OR name[1:2] = 'MC')) THEN name[1:-3]
  WHEN regexp_matches(name, '[DVLR]$') AND (length(name) > 3 OR length(name) = 3 AND (regexp_matches(name, '^.[0-9]') OR name[1:2] = 'MC')) THEN name[1:-2] ELSE name END"""


@query(f"WITH {_VALUES} SELECT name, {_SUFFIX} AS class FROM names")
def fold_suffix_class(spark, sf):
    return named(spark).neurons.select("name", fold.suffix_class(F.col("name")).alias("class"))


@query(f"""WITH {_VALUES}, l AS (SELECT name, regexp_replace(name, 'L$', '') AS class FROM names WHERE name LIKE '%L' AND name <> 'AVL')
SELECT name, class FROM l UNION ALL SELECT n.name, class FROM names n JOIN l ON n.name = class || 'R'""")
def fold_lr(spark, sf):
    return fold.left_right_classes(named(spark).neurons).select("name", "class")


@query(f"""WITH {_VALUES}, d AS (
  SELECT name, regexp_replace(name, 'D$', 'V') AS twin, regexp_replace(name, 'D$', '') AS class FROM names WHERE regexp_matches(name, 'D$') AND name <> 'RID'
  UNION ALL SELECT name, regexp_replace(name, 'D([LR])$', 'V\\1'), regexp_replace(name, 'D([LR])$', '\\1') FROM names WHERE regexp_matches(name, 'D[LR]$')),
p AS (SELECT d.* FROM d JOIN names n ON n.name = twin) SELECT name, class FROM p UNION ALL SELECT twin, class FROM p""")
def fold_dv(spark, sf):
    return fold.dorso_ventral_classes(named(spark).neurons).select("name", "class")


@query(f"WITH {v.TRADE} SELECT {n()} AS count, {r('avg(weight)')} AS mean_weight, {r('min(weight)')} AS min_weight, {r('max(weight)')} AS max_weight FROM trade")
def edge_stats(spark, sf):
    return stats.edge_statistics(v.trade(spark, sf).connections).drop("types")


@query(f"WITH {v.TRADE} SELECT connection_type, {n()} AS n FROM trade GROUP BY ALL")
def edge_type_counts(spark, sf):
    return stats.type_counts(v.trade(spark, sf).connections)


@query(f"""WITH {v.TRADE}, {v.NODES}, o AS (SELECT pre AS name, count(*) AS o FROM trade GROUP BY ALL), i AS (SELECT post AS name, count(*) AS i FROM trade GROUP BY ALL)
SELECT name, {n('coalesce(i, 0)')} AS in_degree, {n('coalesce(o, 0)')} AS out_degree, {n('coalesce(i, 0) + coalesce(o, 0)')} AS degree FROM nodes LEFT JOIN o USING (name) LEFT JOIN i USING (name)""")
def degree_in_out(spark, sf):
    net = v.trade(spark, sf)
    return stats.degrees(net.neurons, net.connections)


@query(f"WITH {v.USER} SELECT a.type AS pre_type, b.type AS post_type, {n()} AS n FROM steps JOIN users a ON pre = a.name JOIN users b ON post = b.name GROUP BY ALL")
def type_pair_counts(spark, sf):
    net = v.users(spark, sf)
    return stats.pair_counts(net.connections, net.neurons)


@query(f"""WITH {v.USER}, p AS (SELECT a.type || '>' || b.type AS p FROM steps JOIN users a ON pre = a.name JOIN users b ON post = b.name),
c AS (SELECT count(*) FILTER (p IN ('sensory>interneuron', 'sensory>motorneuron', 'interneuron>motorneuron')) AS f,
  count(*) FILTER (p IN ('interneuron>sensory', 'motorneuron>sensory', 'motorneuron>interneuron')) AS b FROM p)
SELECT {n('f')} AS forward, {n('b')} AS backward, {r('coalesce((f - b) / nullif(f + b, 0), 0)')} AS alignment FROM c""")
def hierarchical_alignment(spark, sf):
    net = v.users(spark, sf)
    return stats.hierarchical_alignment(net.connections, net.neurons)


@query(f"WITH {v.TRADE}, t AS (SELECT pre, post, count(DISTINCT connection_type) AS weight FROM trade GROUP BY ALL) SELECT pre, post, {n('weight')} AS weight FROM t")
def summary_network(spark, sf):
    return stats.summary_network(v.trade(spark, sf).connections.withColumnRenamed("connection_type", "network"))


def _induced(where: str, edge: str = "") -> str:
    return f"""WITH {v.TRADE}, {v.NODES}, k AS (SELECT name FROM nodes WHERE {where})
SELECT pre, post, connection_type, {n()} AS n, {r('sum(weight)')} AS weight FROM trade WHERE pre IN (FROM k) AND post IN (FROM k) {edge} GROUP BY ALL"""


def _grouped(net: Network):
    return net.connections.groupBy("pre", "post", "connection_type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query(_induced("nation = '3' AND region = '3'"))
def where_and(spark, sf):
    return _grouped(select.where(v.trade(spark, sf), {"nation": "3", "region": "3"}))


@query(_induced("nation = '3' OR category = 'supplier'"))
def where_or(spark, sf):
    return _grouped(select.where(v.trade(spark, sf), {"nation": "3", "category": "supplier"}, condition="OR"))


@query(_induced("region = '1'", "AND connection_type = 'R'"))
def edge_where(spark, sf):
    return _grouped(select.where(v.trade(spark, sf), {"region": "1"}, {"connection_type": "R"}))


_SOME = ", ".join(f"'{p}{k}'" for p in "cs" for k in range(1, 10))


@query(_induced(f"name IN ({_SOME})"))
def subnetwork_nodes(spark, sf):
    return _grouped(select.subnetwork(v.trade(spark, sf), names=[f"{p}{k}" for p in "cs" for k in range(1, 10)]))


@query(f"""WITH {v.TRADE}, {v.NODES}, w AS (SELECT DISTINCT pre, post, connection_type FROM trade WHERE connection_type = 'A' AND weight >= 50),
e AS (SELECT t.* FROM trade t SEMI JOIN w USING (pre, post, connection_type))
SELECT name, category, nation FROM nodes WHERE name IN (SELECT pre FROM e UNION ALL SELECT post FROM e)""")
def subnetwork_edges(spark, sf):
    net = v.trade(spark, sf)
    wanted = net.connections.where("connection_type = 'A' and weight >= 50")
    return select.subnetwork(net, connections=wanted).neurons.select("name", "category", "nation")


@query(f"WITH {v.TRADE} SELECT pre, post, {r('weight')} AS weight FROM trade WHERE connection_type = 'N'")
def filter_type(spark, sf):
    return select.by_type(v.trade(spark, sf).connections, "N").select("pre", "post", "weight")


@query(f"WITH {v.NODES} SELECT name, category FROM nodes WHERE region = '2'")
def filter_property(spark, sf):
    return select.by_property(v.trade(spark, sf).neurons, "region", "2").select("name", "category")


@query(f"WITH {v.TRADE} SELECT pre, post, {r('weight')} AS weight FROM trade WHERE weight % 7 = 0 AND pre < post")
def filter_function(spark, sf):
    return select.by_function(v.trade(spark, sf).connections, lambda e: (e.weight % 7 == 0) & (e.pre < e.post)).select("pre", "post", "weight")


@query(f"WITH {v.NODES} SELECT name FROM nodes WHERE region IS NOT NULL")
def have_attribute(spark, sf):
    return select.have(v.trade(spark, sf).neurons, "region", "name").select("name")


@query(f"WITH {_VALUES} SELECT name, name LIKE '%L' AND name NOT IN ('ADL', 'AVL') AS is_left FROM names")
def is_left(spark, sf):
    return named(spark).neurons.select("name", select.is_left(F.col("name")).alias("is_left"))


@query(f"""WITH {v.USER}, s AS (SELECT * FROM steps WHERE weight > 1) SELECT DISTINCT name, neighbor FROM (
  SELECT pre AS name, post AS neighbor FROM s UNION ALL SELECT post, pre FROM s UNION ALL SELECT pre, pre FROM s UNION ALL SELECT post, post FROM s)""")
def weight_gt_neighbors(spark, sf):
    return neighbors.all_connected(v.users(spark, sf), 1)


@query(f"""WITH {v.USER} SELECT '7' AS name, CAST(k AS VARCHAR) AS other, EXISTS (SELECT 1 FROM steps WHERE (pre = '7' AND post = CAST(k AS VARCHAR)) OR (post = '7' AND pre = CAST(k AS VARCHAR))) AS connected
FROM range(0, 6) AS x(k)""")
def connects_to(spark, sf):
    net = v.users(spark, sf)
    return spark.createDataFrame([("7", str(k), neighbors.connects_to(net, "7", str(k))) for k in range(6)], "name string, other string, connected boolean")


@query(f"""WITH {v.USER} SELECT pre, post, {n()} AS n FROM steps WHERE (pre = '7' AND post = '9') OR (pre = '9' AND post = '7') GROUP BY ALL""")
def connections_between(spark, sf):
    return neighbors.connections_between(v.users(spark, sf), "7", "9", directed=False).groupBy("pre", "post").agg(F.count("*").alias("n"))


@query(f"WITH {v.USER} SELECT pre, post, connection_type, {r('weight')} AS weight FROM steps WHERE pre = '7' OR post = '7'")
def node_connections(spark, sf):
    return neighbors.connections_of(v.users(spark, sf), "7").select("pre", "post", "connection_type", "weight")


@query(f"""WITH {v.USER}, e AS (SELECT name AS member, pre, post, connection_type FROM steps JOIN users ON name = pre WHERE type = 'sensory'
  UNION SELECT name, pre, post, connection_type FROM steps JOIN users ON name = post WHERE type = 'sensory') SELECT member, {n()} AS n FROM e GROUP BY ALL""")
def group_connections(spark, sf):
    net = v.users(spark, sf)
    return neighbors.group_connections(net, net.neurons.where("type = 'sensory'")).groupBy("member").agg(F.count("*").alias("n"))


@query(f"WITH {v.TRADE}, {v.NODES} SELECT name FROM nodes WHERE name IN (SELECT pre FROM trade WHERE weight >= 49 UNION ALL SELECT post FROM trade WHERE weight >= 49)")
def isolates_removed(spark, sf):
    net = v.trade(spark, sf)
    return build.remove_unconnected(net.with_(connections=net.connections.where("weight >= 49"))).neurons.select("name")


@query(f"WITH {v.TRADE}, {v.NODES} SELECT pre, post, {n()} AS n FROM trade WHERE pre NOT IN (SELECT name FROM nodes WHERE nation = '4') AND post NOT IN (SELECT name FROM nodes WHERE nation = '4') GROUP BY ALL")
def nodes_removed(spark, sf):
    net = v.trade(spark, sf)
    return build.drop_nodes(net, net.neurons.where("nation = '4'")).connections.groupBy("pre", "post").agg(F.count("*").alias("n"))


@query(f"""WITH {v.TRADE}, {v.NODES}, a AS (SELECT pre, post, connection_type, avg(weight) AS weight, count(DISTINCT connection_type) FROM trade GROUP BY ALL),
j AS (SELECT pre, post, avg(weight) AS weight, count(DISTINCT connection_type) AS k FROM a GROUP BY ALL) SELECT pre, post, {r('weight')} AS weight FROM j WHERE k = 3""")
def consensus_join(spark, sf):
    net = v.trade(spark, sf)
    per = net.connections.groupBy("pre", "post", "connection_type").agg(F.avg("weight").alias("weight"))
    parts = [Network(t, net.neurons, per.where(F.col("connection_type") == t)) for t in "ANR"]
    return combine.join_networks(parts, key=("pre", "post")).connections


@query(f"""WITH {v.TRADE}, s AS (SELECT DISTINCT connection_type, post FROM trade), k AS (SELECT DISTINCT post FROM trade WHERE pre = 'c1' OR pre = 'c2')
SELECT connection_type, {n()} AS n_members, {n('count(k.post)')} AS n_shared, {r('count(k.post) / count(*)')} AS fraction FROM s LEFT JOIN k USING (post) GROUP BY ALL""")
def overlap_fraction(spark, sf):
    e = v.trade(spark, sf).connections
    return combine.overlap(e, e.where("pre in ('c1', 'c2')"), "post", "connection_type")


@query(f"WITH {v.TRADE} SELECT post FROM trade WHERE pre IN ('c1', 'c2') GROUP BY post HAVING count(DISTINCT pre) = 2")
def shared_receivers(spark, sf):
    return stats.having_all(v.trade(spark, sf).connections, "post", "pre", ["c1", "c2"])


_EXPRESSION = "expression AS (SELECT 'u' || user_id AS neuron, event_type AS gene, max(value) > 150 AS expressed FROM events GROUP BY ALL)"


def expression(spark, sf):
    e = v.read(spark, sf, "events")
    return e.groupBy(F.concat(F.lit("u"), v.text("user_id")).alias("neuron"), F.col("event_type").alias("gene")).agg((F.max("value") > 150).alias("expressed"))


@query(f"WITH {_EXPRESSION} SELECT neuron FROM expression WHERE expressed AND gene IN ('click', 'purchase') GROUP BY ALL HAVING count(*) = 2")
def multi_gene_all(spark, sf):
    return select.expresses_all(expression(spark, sf), ["click", "purchase"])


@query(f"WITH {_EXPRESSION} SELECT neuron, {n()} AS n_genes FROM expression WHERE expressed AND gene LIKE 'p%' GROUP BY ALL")
def family_counts(spark, sf):
    return select.family_counts(expression(spark, sf), "p").select("neuron", "n_genes")


@query(f"""WITH {_EXPRESSION} SELECT neuron, gene FROM expression JOIN (SELECT gene AS g, min(neuron) FILTER (expressed) AS m, max(neuron) FILTER (expressed) AS x FROM expression GROUP BY ALL) ON g = gene
WHERE expressed AND (neuron = m OR neuron = x)""")
def first_last_expressing(spark, sf):
    e = expression(spark, sf)
    ends = e.where("expressed").groupBy("gene").agg(F.min("neuron").alias("m"), F.max("neuron").alias("x"))
    return e.where("expressed").join(ends, "gene").where("neuron = m or neuron = x").select("neuron", "gene")


@query(f"""WITH {v.TRADE}, e AS (SELECT pre AS gene, connection_type AS neuron, max(weight) >= 45 AS expressed FROM trade GROUP BY ALL)
SELECT gene FROM e GROUP BY gene HAVING bool_and(expressed) FILTER (neuron IN ('A', 'R')) AND NOT coalesce(bool_or(expressed) FILTER (neuron NOT IN ('A', 'R')), false) AND count(*) FILTER (neuron IN ('A', 'R')) > 0""")
def unique_markers(spark, sf):
    """Customers with a large line among those of flags A and R, and among none of all other flags."""
    e = v.trade(spark, sf).connections.groupBy(F.col("pre").alias("gene"), F.col("connection_type").alias("neuron")).agg((F.max("weight") >= 45).alias("expressed"))
    return select.unique_markers(e, F.col("neuron").isin("A", "R"))


@query(f"""WITH {v.USER}, lig AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS neuron, event_type AS ligand FROM events WHERE value > 120),
rec AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS neuron, event_type AS ligand, 'r' || event_id % 3 AS receptor FROM events WHERE value < 2)
SELECT DISTINCT s.pre, s.post, l.ligand, receptor FROM steps s JOIN lig l ON l.neuron = s.pre JOIN rec x ON x.neuron = s.post AND x.ligand = l.ligand WHERE connection_type = 'click'""")
def putative_pairs(spark, sf):
    e = v.read(spark, sf, "events").withColumn("neuron", v.text("user_id"))
    lig = e.where("value > 120").select("neuron", F.col("event_type").alias("ligand"))
    rec = e.where("value < 2").select("neuron", F.col("event_type").alias("ligand"), F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("receptor"))
    return omics.putative_pairs(v.users(spark, sf).connections, lig, rec, "click")


@query(f"""WITH {v.USER}, g AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS neuron, 'inx-' || event_id % 9 AS gene FROM events WHERE value > 140)
SELECT DISTINCT pre, post, a.gene AS pre_gene, b.gene AS post_gene FROM steps JOIN g a ON a.neuron = pre JOIN g b ON b.neuron = post WHERE connection_type = 'view'""")
def gap_subunit_pairs(spark, sf):
    e = v.read(spark, sf, "events").where("value > 140").select(v.text("user_id").alias("neuron"), F.concat(F.lit("inx-"), (F.col("event_id") % 9).cast("string")).alias("gene"), F.lit(True).alias("expressed"))
    return omics.subunit_pairs(v.users(spark, sf).connections, e, "view")


@query(f"WITH {v.USER}, m AS (SELECT pre, post, sum(weight) AS weight FROM steps GROUP BY ALL) SELECT pre, post, {r('weight - 2')} AS weight FROM m WHERE weight <> 2")
def adjacency_explode(spark, sf):
    e = v.users(spark, sf).connections.groupBy("pre", "post").agg(F.sum("weight").alias("weight"))
    maps = e.groupBy("pre").agg(F.map_from_entries(F.collect_list(F.struct("post", F.col("weight") - 2))).alias("adjacency"))
    return build.explode_adjacency(maps, "adjacency", "chemical").select("pre", "post", "weight")


@query(f"""WITH {v.TRADE}, l AS (SELECT pre AS name FROM trade UNION SELECT post FROM trade), k AS (SELECT name FROM l WHERE NOT regexp_matches(name, '^(c1|s2)'))
SELECT pre, post, {n()} AS n FROM trade WHERE pre IN (FROM k) AND post IN (FROM k) GROUP BY ALL""")
def edge_list_clean(spark, sf):
    from neurograph.sources.readers import edge_list

    return edge_list(v.trade(spark, sf).connections.withColumnRenamed("weight", "synapses"), drop="^(c1|s2)").connections.groupBy("pre", "post").agg(F.count("*").alias("n"))


@query(f"""WITH {v.USER}, w AS (SELECT pre, post, sum(value) AS w FROM hops WHERE post IS NOT NULL AND value > 20 GROUP BY ALL)
SELECT s.pre, s.post, connection_type, {r('w')} AS weight FROM steps s LEFT JOIN w ON w.pre = s.pre AND w.post = s.post""")
def weights_overwrite(spark, sf):
    w = v.user_hops(spark, sf).where("post is not null and value > 20").groupBy("pre", "post").agg(F.sum("value").alias("new_weight"))
    return build.overwrite_weights(v.users(spark, sf).connections, w).select("pre", "post", "connection_type", "weight")


@query(f"WITH {v.USER} SELECT pre, post, connection_type, {r('CASE WHEN connection_type = $$click$$ THEN weight * 2 + 0.5 ELSE weight + 0.5 END')} AS weight FROM steps")
def weights_updated(spark, sf):
    e = v.users(spark, sf).connections
    e = build.update_weights_by(e, lambda d: F.when(d.connection_type == "click", d.weight * 2).otherwise(d.weight))
    return build.update_weights(e, 0.5, delta=True)


@query(f"WITH {v.USER}, k AS (SELECT pre, post, connection_type, weight, row_number() OVER (PARTITION BY pre, post ORDER BY connection_type) - 1 AS uid FROM steps) SELECT pre, post, connection_type, {n('uid')} AS uid FROM k")
def parallel_uids(spark, sf):
    return build.number_parallel(v.users(spark, sf).connections, "connection_type").select("pre", "post", "connection_type", "uid")


@query(f"""WITH {v.USER}, k AS (SELECT *, row_number() OVER (PARTITION BY pre, post ORDER BY connection_type DESC) AS k FROM steps)
SELECT pre, post, connection_type FROM k WHERE NOT (k = 1 AND CAST(pre AS BIGINT) < 20)""")
def one_parallel_removed(spark, sf):
    net = v.users(spark, sf)
    net = net.with_(connections=build.number_parallel(net.connections, "connection_type"))
    return build.remove_connections(net, net.connections.where("cast(pre as bigint) < 20").select("pre", "post").distinct()).connections.select("pre", "post", "connection_type")


@query(f"""WITH {v.USER}, {_EXPRESSION}, m AS (SELECT name AS src, name || 'x' AS dst FROM users WHERE type = 'sensory') SELECT name, type, dst AS map FROM users LEFT JOIN m ON name = src""")
def graph_map(spark, sf):
    net = v.users(spark, sf)
    other = Network("other", net.neurons.select(F.concat("name", F.lit("x")).alias("name")), net.connections.limit(0))
    mapping = net.neurons.where("type = 'sensory'").select(F.col("name").alias("src"), F.concat("name", F.lit("x")).alias("dst"))
    return combine.graph_map(mapping, net, other).neurons.select("name", "type", "map")


@query(f"WITH {v.USER} SELECT {n('count(DISTINCT pre)')} AS n_keys, {n('count(post)')} AS n_values FROM steps")
def map_cardinality(spark, sf):
    return combine.cardinality(v.users(spark, sf).connections.select(F.col("pre").alias("src"), F.col("post").alias("dst")))


@query(f"""WITH {v.TRADE}, {v.NODES}, e AS (SELECT nation, region, connection_type, weight FROM trade JOIN nodes ON pre = name)
SELECT region, nation, connection_type, {n()} AS n, {r('sum(weight)')} AS weight FROM e GROUP BY GROUPING SETS ((region, nation, connection_type), (region, connection_type), (region), ())""")
def edge_rollup(spark, sf):
    net = v.trade(spark, sf)
    rows = net.connections.join(net.neurons, F.col("pre") == F.col("name"))
    region, nation, kind = F.col("region"), F.col("nation"), F.col("connection_type")
    return rows.groupingSets([[region, nation, kind], [region, kind], [region], []], region, nation, kind).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
