"""Queries over the structure of networks: paths, motifs, null models, centralities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurograph.operators import centrality, layout, motifs, nulls, paths, stats
from neurograph.plans import views as v
from neurograph.plans.graph import sparse
from neurograph.plans.registry import n, query, r
from neurograph.sources.tables import written


@query(f"""WITH {v.USER}, one AS (SELECT pre, post FROM follows WHERE pre IN ('1', '2', '3'))
SELECT pre AS source, post AS target, {n('1')} AS length, pre || '>' || post AS nodes FROM one
UNION ALL SELECT a.pre, b.post, {n('2')}, a.pre || '>' || a.post || '>' || b.post FROM one a JOIN follows b ON a.post = b.pre WHERE b.post <> a.pre""")
def paths_len2(spark, sf):
    e = v.follows(spark, sf)
    found = paths.simple_paths(e, spark.createDataFrame([("1",), ("2",), ("3",)], "name string"), 2)
    return found.withColumn("nodes", F.array_join("nodes", ">"))


@query(f"""WITH RECURSIVE {v.USER}, p AS (SELECT '1' AS target, 0 AS length, ['1'] AS nodes
  UNION ALL SELECT e.post, length + 1, list_append(nodes, e.post) FROM p JOIN follows e ON e.pre = p.target WHERE length < 3 AND p.target <> '9' AND NOT list_contains(nodes, e.post))
SELECT '1' AS source, target, {n('length')} AS length, array_to_string(nodes, '>') AS nodes FROM p WHERE target = '9'""")
def paths_len3(spark, sf):
    one, nine = (spark.createDataFrame([(x,)], "name string") for x in "19")
    return paths.simple_paths(v.follows(spark, sf), one, 3, nine).withColumn("nodes", F.array_join("nodes", ">"))


@query(f"""WITH {v.USER}, f AS (SELECT a.pre AS s, a.post AS m, b.post AS t FROM follows a JOIN follows b ON a.post = b.pre WHERE a.pre = '5' AND b.post <> a.pre),
g AS (SELECT b.post AS s, a.post AS m, a.pre AS t FROM follows b JOIN follows a ON a.post = b.pre WHERE b.post = '5' AND a.pre <> b.post)
SELECT 'out' AS direction, post AS target, {n('1')} AS length, {n()} AS n FROM follows WHERE pre = '5' GROUP BY ALL UNION ALL SELECT 'out', t, {n('2')}, {n()} FROM f GROUP BY ALL
UNION ALL SELECT 'in', pre, {n('1')}, {n()} FROM follows WHERE post = '5' GROUP BY ALL UNION ALL SELECT 'in', t, {n('2')}, {n()} FROM g GROUP BY ALL""")
def all_paths_out(spark, sf):
    e, five = v.follows(spark, sf), spark.createDataFrame([("5",)], "name string")
    both = [paths.simple_paths(x, five, 2).groupBy("target", "length").agg(F.count("*").alias("n")).withColumn("direction", F.lit(d)) for d, x in (("out", e), ("in", paths.reverse_edges(e)))]
    return both[0].unionByName(both[1])


_CHAINS = f"""{v.USER}, e AS (SELECT pre, post, weight, connection_type FROM steps WHERE connection_type = 'click'),
chains AS (SELECT a.pre AS a, a.post AS b, b.post AS c, a.weight AS w1, b.weight AS w2 FROM e a JOIN e b ON a.post = b.pre WHERE a.pre <> b.post AND a.pre <> a.post AND b.pre <> b.post)"""


def chains(spark, sf):
    """Two-edge paths of all clicks, as arrays of edges."""
    e = v.users(spark, sf).connections.where("connection_type = 'click'").withColumn("uid", F.lit(0))
    whole = e.select(F.struct("pre", "post", "uid", "connection_type", "weight").alias("e"))
    a, b = whole.select(F.col("e").alias("x")), whole.select(F.col("e").alias("y"))
    pairs = a.join(b, F.col("x.post") == F.col("y.pre")).where("x.pre <> y.post and x.pre <> x.post and y.pre <> y.post")
    return pairs.select("x", "y", F.array("x", "y").alias("edges"))


@query(f"WITH {_CHAINS} SELECT a, c, {n('2')} AS length, {r('w1 + w2')} AS total_weight, {r('(w1 + w2) / 2')} AS mean_weight, {r('least(w1, w2)')} AS min_weight, {r('greatest(w1, w2)')} AS max_weight FROM chains")
def path_weights(spark, sf):
    return chains(spark, sf).select(F.col("x.pre").alias("a"), F.col("y.post").alias("c"), *[c.alias(k) for k, c in paths.path_weights(F.col("edges")).items()])


@query(f"WITH {_CHAINS} SELECT c || '>' || b || '>' || a AS nodes, {r('w2')} AS first_weight FROM chains")
def path_reverse(spark, sf):
    back = chains(spark, sf).select(paths.reverse_path(F.col("edges")).alias("edges"))
    return back.where(paths.is_continuous(F.col("edges"))).select(F.array_join(paths.path_nodes(F.col("edges")), ">").alias("nodes"), F.get("edges", F.lit(0))["weight"].alias("first_weight"))


@query(f"WITH {_CHAINS} SELECT a || '>' || b || '>' || c AS nodes, {n('2')} AS n_types FROM chains")
def path_concat(spark, sf):
    joined = chains(spark, sf).select(paths.concat_paths(F.array("x"), F.array("y")).alias("edges"))
    return joined.select(F.array_join(paths.path_nodes(F.col("edges")), ">").alias("nodes"), F.size(paths.path_types(F.col("edges"))).alias("n_types"))


_REACH = f"""WITH RECURSIVE {v.SPARSE}, s AS (SELECT pre, post FROM sparse WHERE weight > (SELECT quantile_cont(weight, 0.9) FROM sparse)),
x AS (SELECT pre AS source, post AS name FROM s UNION SELECT source, post FROM x JOIN s ON x.name = s.pre)"""


def heavy(spark, sf):
    s = sparse(spark, sf)
    return s.crossJoin(s.agg(F.percentile("weight", 0.9).alias("q"))).where("weight > q").select("pre", "post", "weight")


@query(f"{_REACH} SELECT source, name FROM x")
def reachability(spark, sf):
    e = heavy(spark, sf)
    return paths.reachable(e, e.select(F.col("pre").alias("name")).distinct())


@query(f"""WITH RECURSIVE {v.USER}, b AS (SELECT '1' AS name, 0 AS distance UNION SELECT s.post, distance + 1 FROM b JOIN follows s ON b.name = s.pre WHERE distance < 12)
SELECT '1' AS source, name, {n('min(distance)')} AS distance FROM b GROUP BY name""")
def bfs_distance(spark, sf):
    return paths.distances(v.follows(spark, sf), spark.createDataFrame([("1",)], "name string"))


@query(f"""WITH {v.USER}, s AS (SELECT count(*) AS s FROM users WHERE type = 'sensory'), t AS (SELECT count(*) AS t FROM users WHERE type = 'motorneuron')
SELECT name, {n("CASE type WHEN 'sensory' THEN -t WHEN 'motorneuron' THEN s ELSE 0 END")} AS demand FROM users, s, t""")
def flow_demand(spark, sf):
    nodes = v.users(spark, sf).neurons
    return paths.flow_demand(nodes, nodes.where("type = 'sensory'"), nodes.where("type = 'motorneuron'"))


def _motif_sql(m: motifs.Motif, view: str = v.USER, edges: str = "follows", nodes: str = "users") -> str:
    """Self-joins, pairwise differences, and NOT EXISTS for each absent edge; a node without edges is any node."""
    alone = [x for x in m.nodes if not any(x in e for e in m.edges)]
    first = {x: f"u{x}.name" if x in alone else next(f"e{i}.{'pre' if e[0] == x else 'post'}" for i, e in enumerate(m.edges) if x in e) for x in m.nodes}
    on = [f"e{i}.{c} = {first[x]}" for i, e in enumerate(m.edges) for c, x in (("pre", e[0]), ("post", e[1])) if first[x] != f"e{i}.{c}"]
    diff = [f"{first[a]} <> {first[b]}" for i, a in enumerate(m.nodes) for b in m.nodes[i + 1 :]]
    absent = [f"NOT EXISTS (SELECT 1 FROM {edges} z WHERE z.pre = {first[a]} AND z.post = {first[b]})" for a in m.nodes for b in m.nodes if a != b and (a, b) not in m.edges]
    cols, tables = ", ".join(f"{first[x]} AS {motifs.column(x)}" for x in m.nodes), [*(f"{edges} e{i}" for i in range(len(m.edges))), *(f"{nodes} u{x}" for x in alone)]
    return f"WITH {view} SELECT {cols} FROM {', '.join(tables)} WHERE {' AND '.join(on + diff + absent)}"


def _motif(name: str):
    m = motifs.triads()[name]

    def f(spark, sf):
        return motifs.search(v.followed(spark, sf), m, nodes=v.users(spark, sf).neurons)

    f.__name__ = f"motif_{name}"
    query(_motif_sql(m))(f)


for _name in motifs.TRIADS:
    if _name != "003":
        _motif(_name)


@query(_motif_sql(motifs.triads()["003"], f"{v.SPARSE}, real AS (SELECT pre, post FROM sparse WHERE pre <> post), places AS (SELECT CAST(n_nationkey AS VARCHAR) AS name FROM nation)", "real", "places"))
def motif_003(spark, sf):
    """Triples of nations without a link: as there are about as many such triples as triples, not of the users."""
    return motifs.search(sparse(spark, sf), motifs.triads()["003"], nodes=v.read(spark, sf, "nation").select(v.text("n_nationkey").alias("name")))


_CHAIN = motifs.hypermotif(motifs.triads()["030T"], 2, [(2, 1)])
_APART = " AND ".join(f"NOT EXISTS (SELECT 1 FROM follows z WHERE z.pre = {x} AND z.post = {y})" for a in ("a.n_1", "a.n_3") for b in ("b.n_2", "b.n_3") for x, y in ((a, b), (b, a)))


@query(f"""{_motif_sql(motifs.triads()["030T"]).replace("SELECT e0", ", t AS MATERIALIZED (SELECT e0", 1)})
SELECT a.n_1 AS n_1_1, a.n_2 AS n_1_2_2_1, a.n_3 AS n_1_3, b.n_2 AS n_2_2, b.n_3 AS n_2_3 FROM t a JOIN t b ON a.n_2 = b.n_1 AND a.n_1 NOT IN (b.n_2, b.n_3) AND a.n_3 NOT IN (b.n_2, b.n_3) WHERE {_APART}""")
def hyperchain2_030T(spark, sf):  # noqa: N802
    return motifs.search(v.followed(spark, sf), _CHAIN)


def _census_sql() -> str:
    rows = ", ".join(f"('{k}', '{t}')" for k, t in sorted(motifs.census_map().items()))
    return f"""WITH {v.USER}, d AS (SELECT a.name AS a, b.name AS b, (EXISTS (SELECT 1 FROM follows s WHERE s.pre = a.name AND s.post = b.name))::INT + 2 * (EXISTS (SELECT 1 FROM follows s WHERE s.pre = b.name AND s.post = a.name))::INT AS c
  FROM users a JOIN users b ON a.name < b.name), m(code, triad) AS (VALUES {rows}),
  t AS (SELECT m.triad, count(*) AS n FROM d x JOIN d y ON x.a = y.a AND x.b < y.b JOIN d z ON z.a = x.b AND z.b = y.b JOIN m ON m.code = x.c::VARCHAR || y.c::VARCHAR || z.c::VARCHAR GROUP BY ALL)
SELECT DISTINCT m.triad, {n('coalesce(t.n, 0)')} AS n FROM m LEFT JOIN t ON t.triad = m.triad"""


@query(_census_sql())
def triad_census(spark, sf):
    return motifs.triad_census(v.users(spark, sf).neurons, v.follows(spark, sf))


_030T = "f AS (SELECT a.pre AS n1, a.post AS n2, b.pre AS n3 FROM follows a JOIN follows b ON b.post = a.post AND b.pre <> a.pre JOIN follows c ON c.pre = a.pre AND c.post = b.pre WHERE NOT EXISTS (FROM follows z WHERE z.pre = n2 AND z.post = n1) AND NOT EXISTS (FROM follows z WHERE z.pre = n2 AND z.post = n3) AND NOT EXISTS (FROM follows z WHERE z.pre = n3 AND z.post = n1))"


@query(f"WITH {v.USER}, {_030T}, p AS (SELECT '1' AS role, n1 AS name FROM f UNION ALL SELECT '2', n2 FROM f UNION ALL SELECT '3', n3 FROM f) SELECT role, type, {n()} AS n FROM p JOIN users USING (name) GROUP BY ALL")
def motif_roles(spark, sf):
    m = motifs.triads()["030T"]
    return motifs.roles(motifs.search(v.followed(spark, sf), m), m, v.users(spark, sf).neurons)


@query(f"""WITH {v.USER}, {_030T}, e AS (SELECT n1 AS pre, n2 AS post FROM f UNION ALL SELECT n3, n2 FROM f UNION ALL SELECT n1, n3 FROM f),
c AS (SELECT a.type AS pre_type, b.type AS post_type, count(*) AS n FROM e JOIN users a ON pre = a.name JOIN users b ON post = b.name GROUP BY ALL)
SELECT pre_type, post_type, {n('n')} AS n, {r('n / sum(n) OVER ()')} AS share, {r('-(n / sum(n) OVER ()) * ln(n / sum(n) OVER ())')} AS entropy FROM c""")
def motif_edge_types(spark, sf):
    m = motifs.triads()["030T"]
    return stats.shares_of(motifs.edge_types(v.followed(spark, sf), m, v.users(spark, sf).neurons))


_DEGREES = f"""WITH {v.USER}, o AS (SELECT pre AS name, count(*) AS o FROM follows GROUP BY ALL), i AS (SELECT post AS name, count(*) AS i FROM follows GROUP BY ALL)
SELECT name, {n('coalesce(i, 0)')} AS in_degree, {n('coalesce(o, 0)')} AS out_degree FROM o FULL JOIN i USING (name)"""


def _degrees(edges):
    ends = edges.select(F.explode(F.array("pre", "post")).alias("name")).distinct()
    return stats.degrees(ends, edges).drop("degree")


@query(_DEGREES)
def config_model_degrees(spark, sf):
    return _degrees(nulls.configuration_model(v.follows(spark, sf), 7))


@query(_DEGREES)
def edge_swap_degrees(spark, sf):
    return _degrees(nulls.edge_swap(v.follows(spark, sf), 7, 3))


@query(f"WITH {v.USER}, c AS (SELECT count(*) AS n FROM follows) SELECT {n('n')} AS n_edges, {n('0')} AS n_loops, {n('n')} AS n_distinct FROM c")
def gnm_count(spark, sf):
    e = nulls.randomize(v.follows(spark, sf), "num-nodes-edges", 3, v.users(spark, sf).neurons)
    return e.agg(F.count("*").alias("n_edges"), F.count_if(F.col("pre") == F.col("post")).alias("n_loops"), F.countDistinct("pre", "post").alias("n_distinct"))


@query(f"WITH {v.USER} SELECT a.type AS pre_type, b.type AS post_type, {n()} AS n FROM follows JOIN users a ON pre = a.name JOIN users b ON post = b.name GROUP BY ALL")
def stub_matching_counts(spark, sf):
    e = nulls.stub_matching(v.follows(spark, sf), v.users(spark, sf).neurons, 5)
    return e.groupBy("pre_type", "post_type").agg(F.count("*").alias("n"))


def _against(observed, null):
    """z, p and its correction of all triads against the censuses of null graphs (replicate, triad, n)."""
    return nulls.adjust(nulls.z_scores(observed.select("triad", F.col("n").alias("value")), null.select("replicate", "triad", F.col("n").alias("value")), "triad"), "bh")


@query()
def null_motif_zscores(spark, sf):
    """All triads against 100 configuration models: one draw and one census, with the replicate as a key. Loops and parallel edges of the models are left out."""
    nodes, e = v.users(spark, sf).neurons, written(v.follows(spark, sf), "follows")
    null = nulls.replicates(e, "configuration-model", 100, 1).where("pre <> post")
    return _against(motifs.triad_census(nodes, e), motifs.triad_census(nodes, null, ("replicate",)))


_SHIFTS = 5


@query(f"""WITH {v.USER}, nets AS (SELECT -1 AS replicate, pre, post FROM follows UNION ALL
  SELECT DISTINCT k AS replicate, pre, CAST((CAST(post AS BIGINT) + 1 + k) % (SELECT max(user_id) + 1 FROM events) AS VARCHAR) FROM follows, range(0, {_SHIFTS}) AS x(k)),
ring AS (SELECT CAST(unnest(range(0, max(user_id) + 1)) AS VARCHAR) AS name FROM events),
d AS (SELECT replicate, least(pre, post) AS a, greatest(pre, post) AS b, CAST(sum(DISTINCT CASE WHEN pre < post THEN 1 ELSE 2 END) AS INT) AS c FROM nets WHERE pre <> post GROUP BY ALL),
s AS (SELECT replicate, a, b, c FROM (SELECT DISTINCT replicate FROM d) JOIN (SELECT x.name AS a, y.name AS b FROM ring x JOIN ring y ON x.name < y.name) ON true LEFT JOIN d USING (replicate, a, b)),
m(code, triad) AS (VALUES {", ".join(f"('{k}', '{t}')" for k, t in sorted(motifs.census_map().items()))}),
t AS (SELECT x.replicate, m.triad, count(*) AS n FROM s x JOIN s y ON x.replicate = y.replicate AND x.a = y.a AND x.b < y.b JOIN s z ON z.replicate = x.replicate AND z.a = x.b AND z.b = y.b
  JOIN m ON m.code = coalesce(x.c, 0)::VARCHAR || coalesce(y.c, 0)::VARCHAR || coalesce(z.c, 0)::VARCHAR GROUP BY ALL),
f AS (SELECT replicate, triad, coalesce(n, 0) AS n FROM (SELECT DISTINCT replicate FROM d) JOIN (SELECT DISTINCT triad FROM m) ON true LEFT JOIN t USING (replicate, triad))
SELECT triad, {r('any_value(n) FILTER (replicate < 0)')} AS observed, {r('avg(n) FILTER (replicate >= 0)')} AS null_mean, {r('stddev_pop(n) FILTER (replicate >= 0)')} AS null_std,
{r('coalesce((any_value(n) FILTER (replicate < 0) - avg(n) FILTER (replicate >= 0)) / nullif(stddev_pop(n) FILTER (replicate >= 0), 0), 0)')} AS z FROM f GROUP BY triad""")
def null_census_shift(spark, sf):
    """All triads against networks whose targets are moved on by 1 to 5 places: null graphs that SQL can make as well."""
    size = v.read(spark, sf, "events").agg(F.max("user_id") + 1).first()[0] or 0
    nodes, e = spark.range(size).select(v.text("id").alias("name")), written(v.follows(spark, sf), "follows")
    # one network at a time, so that the disk holds the arrays of one
    found = [motifs.triad_census(nodes, e.select("pre", v.text((F.col("post").cast("bigint") + 1 + k) % F.lit(max(size, 1))).alias("post"))).select(F.lit(k).alias("replicate"), "triad", "n") for k in range(_SHIFTS)]
    return _against(motifs.triad_census(nodes, e), reduce(DataFrame.union, found)).drop("p", "p_adjusted")


@query(f"""WITH {v.TRADE}, {v.NODES}, c AS (SELECT nation, connection_type, count(*) AS n FROM trade JOIN nodes ON pre = name GROUP BY ALL),
m AS (SELECT nation, avg(n) AS mean, stddev_pop(n) AS sd FROM c GROUP BY ALL),
z AS (SELECT nation, n, mean, sd, coalesce((n - mean) / nullif(sd, 0), 0) AS z FROM c JOIN m USING (nation) WHERE connection_type = 'A')
SELECT nation, {r('n')} AS observed, {r('mean')} AS null_mean, {r('sd')} AS null_std, {r('z')} AS z FROM z""")
def null_zscores(spark, sf):
    net = v.trade(spark, sf)
    counts = net.connections.join(net.neurons, F.col("pre") == F.col("name")).groupBy("nation", "connection_type").agg(F.count("*").alias("value"))
    return nulls.z_scores(counts.where("connection_type = 'A'").drop("connection_type"), counts.withColumnRenamed("connection_type", "replicate"), "nation").drop("p")


_P = f"{v.TRADE}, {v.NODES}, p AS (SELECT nation, avg((weight > 45)::INT) AS p FROM trade JOIN nodes ON pre = name GROUP BY ALL)"


def _p_values(spark, sf):
    net = v.trade(spark, sf)
    return net.connections.join(net.neurons, F.col("pre") == F.col("name")).groupBy("nation").agg(F.avg((F.col("weight") > 45).cast("int")).alias("p"))


@query(f"""WITH {_P}, k AS (SELECT *, (SELECT count(*) FROM p q WHERE q.p <= p.p) AS k, count(*) OVER () AS m FROM p)
SELECT nation, {r('p')} AS p, {r('least(1, (SELECT min(j.p * j.m / j.k) FROM k j WHERE j.p >= k.p))')} AS p_adjusted FROM k""")
def null_zscore_bh(spark, sf):
    return nulls.adjust(_p_values(spark, sf), "bh")


@query(f"""WITH {_P}, k AS (SELECT *, (SELECT count(*) FROM p q WHERE q.p <= p.p) AS k, count(*) OVER () AS m FROM p)
SELECT nation, {r('p')} AS p, {r('least(1, (SELECT min(j.p * j.m / j.k * list_sum(list_transform(range(1, j.m + 1), lambda x: 1.0::DOUBLE / x))) FROM k j WHERE j.p >= k.p))')} AS p_adjusted FROM k""")
def null_fdr_by(spark, sf):
    return nulls.adjust(_p_values(spark, sf), "by")


@query()
def bootstrap_enrichment(spark, sf):
    net = v.users(spark, sf)
    incoming = net.connections.select("post", F.col("connection_type").alias("type"))
    return nulls.bootstrap(net.neurons, incoming, 1000, 5, 11).groupBy("type").agg(F.count("*").alias("draws"), F.avg("share").alias("mean_share"), F.stddev_pop("share").alias("std_share"))


@query()
def betweenness(spark, sf):
    return centrality.betweenness(v.follows(spark, sf))


@query()
def percolation(spark, sf):
    return centrality.percolation(v.follows(spark, sf), lambda name: int(name) % 7 / 7)


@query()
def edge_connectivity(spark, sf):
    return spark.createDataFrame([(centrality.edge_connectivity(heavy(spark, sf)),)], "edge_connectivity bigint")


@query()
def girvan_newman(spark, sf):
    return centrality.girvan_newman(heavy(spark, sf).select("pre", "post"), 3)


@query(f"""WITH {v.USER}, e AS (SELECT a.type AS a, b.type AS b FROM follows JOIN users a ON pre = a.name JOIN users b ON post = b.name)
SELECT {n('count(*) FILTER (a = b)')} AS within, {n('count(*) FILTER (a <> b)')} AS between, {n('count(*) FILTER (a = b) - count(*) FILTER (a <> b)')} AS energy FROM e""".replace("AS between", 'AS "between"').replace("AS within,", 'AS "within",'))
def gn_energy(spark, sf):
    return centrality.partition_energy(v.follows(spark, sf), v.users(spark, sf).neurons.select("name", F.col("type").alias("community")))


@query(f"""WITH {v.USER}, e AS (SELECT a.type AS community, b.type AS b FROM follows JOIN users a ON pre = a.name JOIN users b ON post = b.name)
SELECT community, {n('count(*) FILTER (community <> b)')} AS cut, {n()} AS volume FROM e GROUP BY ALL""")
def cut_and_volume(spark, sf):
    return centrality.cut_and_volume(v.follows(spark, sf), v.users(spark, sf).neurons.select("name", F.col("type").alias("community")))


@query(f"""WITH {v.SPARSE}, w AS (SELECT pre, post, weight AS w FROM sparse WHERE pre <> post),
m AS (SELECT pre, post, sum(w) AS w FROM (SELECT pre, post, w FROM w UNION ALL SELECT post, pre, w FROM w) GROUP BY ALL),
p AS (SELECT pre, post, w / sum(w) OVER (PARTITION BY pre) AS p FROM m),
v AS (SELECT a.pre AS i, b.post AS j, sum(a.p * b.p) AS via FROM p a JOIN p b ON a.post = b.pre WHERE a.pre <> b.post GROUP BY ALL)
SELECT pre AS name, {r('sum(pow(p + coalesce(via, 0), 2))')} AS "constraint" FROM p LEFT JOIN v ON i = pre AND j = post GROUP BY ALL""")
def constraint(spark, sf):
    return centrality.constraint(sparse(spark, sf))


@query(f"""WITH {v.USER}, m AS (SELECT name FROM users WHERE type = 'sensory')
SELECT post AS name, {r('avg((pre IN (FROM m))::INT)')} AS fraction, {r('sum(CASE WHEN pre IN (FROM m) THEN weight ELSE 0 END) / sum(weight)')} AS weighted_fraction FROM steps GROUP BY ALL""")
def measured_inputs(spark, sf):
    net = v.users(spark, sf)
    return centrality.measured_inputs(net.connections, net.neurons.where("type = 'sensory'"))


@query(f"""SELECT l_returnflag AS kind, {r('regr_slope(l_extendedprice, l_quantity)')} AS slope, {r('regr_intercept(l_extendedprice, l_quantity)')} AS intercept,
{r('corr(l_extendedprice, l_quantity)')} AS r, {r('regr_r2(l_extendedprice, l_quantity)')} AS r2 FROM lineitem GROUP BY ALL""")
def linear_fit(spark, sf):
    rows = v.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("kind"), "l_extendedprice", "l_quantity")
    return centrality.linear_fit(rows, "l_extendedprice", "l_quantity", "kind")


@query(f"WITH {v.USER} SELECT name, type, {n('row_number() OVER (PARTITION BY type ORDER BY name) - 1')} AS place, {n('CASE WHEN name IN ($$1$$, $$2$$) THEN 0 ELSE 1 END')} AS shell FROM users")
def layout_places(spark, sf):
    return layout.shells(layout.grouped_places(v.users(spark, sf).neurons, "type"), ["1", "2"])


@query(f"WITH {v.SPARSE} SELECT pre, post, {r('1 + ln(weight) / ln(10)')} AS width FROM sparse")
def layout_widths(spark, sf):
    return layout.edge_widths(sparse(spark, sf), 10.0).select("pre", "post", "width")


@query(f"""WITH {v.USER} SELECT pre, post, connection_type, a.type AS pre_type, b.type AS post_type, a.type <> b.type AS across, EXISTS (FROM follows z WHERE z.pre = steps.pre AND z.post = steps.post) AS anatomical
FROM steps JOIN users a ON pre = a.name JOIN users b ON post = b.name""")
def layout_layers(spark, sf):
    net = v.users(spark, sf)
    return layout.layered_edges(net.connections, net.neurons, v.follows(spark, sf)).drop("weight")
