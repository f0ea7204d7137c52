"""What SQL can state of operators that it can't express: known answers, sums and bounds, over the same whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurograph.operators import centrality, fit, nulls, signal, simulate
from neurograph.plans import views as v
from neurograph.plans.registry import n, query, r
from neurograph.plans.series import K, S, template
from neurograph.sources.tables import written


def level(samples):
    """The samples, all of a neuron's at one level."""
    return samples.withColumn("value", F.col("neuron") % 7 + 0.5)


@query(f"{S} SELECT {K}, t, {r('CASE WHEN count(*) OVER (PARTITION BY neuron, trial) > 15 THEN neuron % 7 + 0.5 END')} AS value FROM samples")
def filter_of_a_constant(spark, sf):
    """A low-pass filter leaves a constant as it is; trials too short for its padding are undefined."""
    return signal.butterworth(level(v.samples(spark, sf)), "low", 1.0).withColumn("value", F.when(F.isnan("value"), None).otherwise(F.col("value")))


@query(f"{S} SELECT {K}, {n()} AS n, {r('0')} AS largest FROM samples GROUP BY ALL HAVING count(*) > 15")
def filter_is_linear(spark, sf):
    """Filtered samples, and filtered samples of three times the size: how far one is from three times the other."""
    s = v.samples(spark, sf)
    one, three = signal.butterworth(s, "low", 1.0), signal.butterworth(s.withColumn("value", F.col("value") * 3), "low", 1.0)
    both = one.join(three.withColumnRenamed("value", "thrice"), ["neuron", "trial", "t"]).where(~F.isnan("value"))
    return both.groupBy("neuron", "trial").agg(F.count("*").alias("n"), F.max(F.abs(F.col("thrice") - 3 * F.col("value"))).alias("largest"))


@query(f"{S} SELECT {K}, t, {r('neuron % 7 + 0.5')} AS value FROM samples")
def wavelet_of_a_constant(spark, sf):
    """A constant has no details to shrink."""
    return signal.wavelet_denoise(level(v.samples(spark, sf)))


@query(f"""{S}, c AS (SELECT *, (value <> coalesce(lag(value) OVER w, value + 1))::INT AS c FROM samples WINDOW w AS (PARTITION BY neuron, trial ORDER BY t)), s AS (SELECT *, sum(c) OVER (PARTITION BY neuron, trial ORDER BY t) AS run FROM c),
g AS (SELECT neuron, trial, run, min(t) AS a, max(t) AS b, any_value(value) AS value FROM s GROUP BY ALL), l AS (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS n FROM g WINDOW w AS (PARTITION BY neuron, trial ORDER BY run))
SELECT {K}, {n('(a + b) // 2')} AS t, {r('value')} AS value FROM l WHERE l < value AND n < value AND value >= 10""")
def peaks_spaced_by_one(spark, sf):
    """At a distance of one sample no peak hides another."""
    return signal.spaced_peaks(v.samples(spark, sf), 1, 10.0)


@query(f"""{S}, c AS (SELECT *, value - avg(value) OVER p AS x, count(*) OVER p AS n FROM samples WINDOW p AS (PARTITION BY neuron, trial)),
w AS (SELECT *, 0.5 - 0.5 * cos(2 * pi() * t / n) AS w FROM c WHERE n BETWEEN 2 AND 256) SELECT {K}, {r('sum(w * x * w * x) / sum(w * w)')} AS variance FROM w GROUP BY ALL""")
def welch_keeps_power(spark, sf):
    """Of trials of one segment the spectrum's sum is the variance of the windowed samples."""
    s = v.samples(spark, sf)
    length = s.groupBy("neuron", "trial").agg(F.count("*").alias("n")).where("n between 2 and 256")
    p = signal.power_spectrum(s.join(length.drop("n"), ["neuron", "trial"]))
    return p.join(length, ["neuron", "trial"]).groupBy("neuron", "trial").agg((F.sum("power") * F.first(5.0 / F.col("n"))).alias("variance"))


_CELLS = f"""WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS p, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
c AS (SELECT vec_id // 8 AS block, vec_id % 8 AS i, p // 8 AS j, p % 8 AS k, value FROM e)"""


@query(f"{_CELLS} SELECT {n('block')} AS block, {n('i')} AS i, {n('j')} AS j, {n('k')} AS k, {r('value')} AS value FROM c WHERE (i + 3 * j + 5 * k) % 7 <> 0")
def tensor_keeps_known_cells(spark, sf):
    """Imputation changes no cell that was known."""
    from neurograph.plans.series import tensor_impute

    return tensor_impute(spark, sf).join(v.read(spark, sf, "embeddings").select(F.expr("vec_id div 8").alias("block"), (F.col("vec_id") % 8).cast("int").alias("i")), ["block", "i"]).where("(i + j * 3 + k * 5) % 7 <> 0")


@query(f"SELECT {n('x')} AS model_id, 4 :: BIGINT AS nodes, true AS bounded, true AS weights_in_range, true AS constants_in_range FROM range(0, 200) AS t(x)")
def sweep_bounds(spark, sf):
    """A sweep's models: rates of tanh models stay within 1, weights and time constants where they are drawn from."""
    swept = simulate.sweep(template(spark), 200, 1)
    w = swept.edges.groupBy("model_id").agg(F.bool_and(F.col("weight").between(-1, 1)).alias("weights_in_range"))
    t = swept.nodes.groupBy("model_id").agg(F.bool_and(F.col("time_constant").between(1, 10)).alias("constants_in_range"))
    rates = simulate.simulate(swept, [k * 0.1 for k in range(100)]).groupBy("model_id").agg(F.countDistinct("name").alias("nodes"), F.bool_and(F.abs("rate") <= 1 + 1e-9).alias("bounded"))
    return rates.join(w, "model_id").join(t, "model_id")


@query(f"SELECT {n('x')} AS round, 32 :: BIGINT AS trials, true AS not_worse FROM range(0, 3) AS t(x)".replace("AS round", 'AS "round"'))
def search_never_loses(spark, sf):
    """Rounds of the search have all their trials, and none ends above twice the loss of the first."""
    times = [k * 0.1 for k in range(60)]
    truth = simulate.simulate(fit.applied(template(spark), spark.createDataFrame([(0,)], "model_id bigint")), times).where("name = 'c'").select("name", "t", F.col("rate").alias("real"))
    found = fit.search(template(spark), {"weight:a:b": (-1.0, 1.0), "weight:b:c": (-1.0, 1.0)}, written(truth, "truth"), times, 32, 3, 5)
    best = found.groupBy("round").agg(F.min("loss").alias("best"), F.count("*").alias("trials"))
    first = best.where("round = 0").select(F.col("best").alias("first"))
    return best.crossJoin(first).select("round", "trials", (F.col("best") <= 2 * F.col("first")).alias("not_worse"))


TREE = """tree AS (SELECT 'r' || n_regionkey AS pre, 'n' || n_nationkey AS post FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
ends AS (SELECT pre AS name FROM tree UNION SELECT post FROM tree), size AS (SELECT count(*) AS n FROM ends)"""


def tree(spark, sf):
    """Regions, their nations, and those' suppliers, as edges downwards."""
    a = v.read(spark, sf, "nation").select(F.concat(F.lit("r"), v.text("n_regionkey")).alias("pre"), F.concat(F.lit("n"), v.text("n_nationkey")).alias("post"))
    return a.union(v.read(spark, sf, "supplier").select(F.concat(F.lit("n"), v.text("s_nationkey")), F.concat(F.lit("s"), v.text("s_suppkey"))))


@query(f"""WITH {TREE}, below AS (SELECT pre AS name, count(*) AS k FROM tree GROUP BY ALL), above AS (SELECT post AS name, count(*) AS k FROM tree GROUP BY ALL)
SELECT name, {r('coalesce(a.k * b.k, 0) / ((n - 1) * (n - 2.0))')} AS betweenness FROM ends LEFT JOIN below b USING (name) LEFT JOIN above a USING (name), size""")
def betweenness_of_a_tree(spark, sf):
    """Only nations lie between others: one region, and each of their suppliers."""
    return centrality.betweenness(tree(spark, sf))


@query(f"""WITH {TREE}, x AS (SELECT name, (CAST(substr(name, 2) AS BIGINT) % 5) / 5.0 AS x FROM ends), total AS (SELECT sum(greatest(0, a.x - b.x)) AS total FROM x a, x b),
own AS (SELECT a.name, any_value(total) - sum(abs(a.x - b.x)) AS rest FROM x a, x b, total GROUP BY a.name),
through AS (SELECT u.post AS name, sum(greatest(0, a.x - b.x)) AS w FROM tree u JOIN tree l ON l.pre = u.post JOIN x a ON a.name = u.pre JOIN x b ON b.name = l.post GROUP BY ALL)
SELECT name, {r('coalesce(w / nullif(rest, 0), 0) / (n - 2)')} AS percolation FROM ends JOIN own USING (name) LEFT JOIN through USING (name), size""")
def percolation_of_a_tree(spark, sf):
    """States are fifths of the ids; only nations lie on paths."""
    return centrality.percolation(tree(spark, sf), lambda name: int(name[1:]) % 5 / 5)


@query(f"SELECT {n('count(*) - 1')} AS edge_connectivity FROM region")
def connectivity_of_all_pairs(spark, sf):
    """Where every region is linked to every other, as many edges as it has must go to cut one off."""
    keys = v.read(spark, sf, "region").select(v.text("r_regionkey").alias("k"))
    pairs = keys.select(F.col("k").alias("pre")).join(keys.select(F.col("k").alias("post")), F.col("pre") != F.col("post"))
    return spark.createDataFrame([(centrality.edge_connectivity(pairs),)], "edge_connectivity bigint")


@query(f"""SELECT 'r' || n_regionkey AS first_name, {n('count(*) + 1')} AS n FROM nation GROUP BY ALL""")
def communities_of_stars(spark, sf):
    """Regions and their nations, linked in a ring by one edge from each region to the next: cut into as many parts as there are regions, each is a region's own."""
    rows = v.read(spark, sf, "nation").select(F.col("n_regionkey").alias("k"), F.concat(F.lit("r"), v.text("n_regionkey")).alias("pre"), F.concat(F.lit("x"), v.text("n_nationkey")).alias("post"))
    count = v.read(spark, sf, "region").count()
    path = rows.select("k").distinct().where(F.col("k") < count - 1).select(F.concat(F.lit("r"), v.text("k")).alias("pre"), F.concat(F.lit("r"), v.text(F.col("k") + 1)).alias("post"))
    found = centrality.girvan_newman(rows.select("pre", "post").union(path), count)
    return found.groupBy("community").agg(F.min("name").alias("first_name"), F.count("*").alias("n")).drop("community")


@query(f"SELECT {n('1000')} AS draws, {r('1')} AS least, {r('1')} AS most")
def bootstrap_shares(spark, sf):
    """A draw's shares sum to one."""
    net = v.users(spark, sf)
    found = nulls.bootstrap(net.neurons, net.connections.select("post", F.col("connection_type").alias("type")), 1000, 5, 11)
    return found.groupBy("draw").agg(F.sum("share").alias("total")).agg(F.count("*").alias("draws"), F.min("total").alias("least"), F.max("total").alias("most"))
