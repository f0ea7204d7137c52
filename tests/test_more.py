"""Groups, readers by style, null models with options, motifs without edges, models' updates, and windowed fits."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurograph.model import Network
from neurograph.operators import build, fit, motifs, nulls, omics, order, select, simulate, stim, tsa
from neurograph.sources import readers, tables


@pytest.fixture(scope="module")
def net(spark):
    nodes = spark.createDataFrame([(x, "s" if x in "ab" else "m") for x in "abcde"], "name string, type string")
    edges = spark.createDataFrame([("a", "b", "chemical-synapse", 2.0), ("b", "c", "chemical-synapse", 1.0), ("c", "a", "gap-junction", 3.0), ("d", "a", "chemical-synapse", 1.0)], "pre string, post string, connection_type string, weight double")
    return Network("n", nodes, edges)


def names(df):
    return sorted(r.name for r in df.collect())


def test_groups(net):
    g = net.make_neuron_group("g", ["a", "b"])
    assert g.group_size("g") == 2 and g.in_group("g", "a") and not g.in_group("g", "c")
    g = g.add_to_group("g", ["b", "c", "nobody"])
    assert names(g.group("g")) == ["a", "b", "c"]
    assert names(g.remove_from_group("g", ["a", "e"]).group("g")) == ["b", "c"]
    assert names(g.pop_from_group("g", "b").group("g")) == ["a", "c"] and g.clear_group("g").group_size("g") == 0
    with pytest.raises(KeyError):
        g.pop_from_group("g", "e")
    with pytest.raises(KeyError):
        net.group("none")
    marked = g.set_group_property("g", "color", "red")
    assert {r.name: r.color for r in marked.neurons.collect()} == {"a": "red", "b": "red", "c": "red", "d": None, "e": None}
    c = net.make_connection_group("c", F.col("weight") > 1)
    assert c.group_size("c") == 2 and c.in_group("c", ("a", "b")) and not c.in_group("c", ("b", "c"))
    assert c.add_to_group("c", [("b", "c")]).group_size("c") == 3 and c.remove_from_group("c", [("a", "b")]).group_size("c") == 1


def test_copies_and_single_edges(spark, net):
    empty = Network("e", net.neurons.limit(0), net.connections.limit(0))
    bare = build.neurons_from(empty, net, data=False)
    assert names(bare.neurons) == list("abcde") and bare.neurons.where("type is not null").count() == 0
    assert build.neurons_from(bare, net).neurons.count() == 5
    assert build.connections_from(bare, net).connections.count() == 4
    one = spark.createDataFrame([("a", "e", 1.5, "x")], "pre string, post string, weight double, note string")
    assert build.setup_connections(net, one, "edge-kind").connections.where("note = 'x' and connection_type = 'edge-kind'").count() == 1
    with pytest.raises(NotImplementedError):
        build.setup_connections(net, one, "k", "matrix")
    assert {tuple(r.names) for r in select.by_name(net.connections).collect()} == {("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")}


def test_pair_histograms(spark, net):
    pairs = spark.createDataFrame([("a", "b", "Glu", "r1"), ("a", "b", "Glu", "r2"), ("b", "c", "ACh", "r1")], "pre string, post string, ligand string, receptor string")
    e = omics.with_putative(net.connections, pairs)
    assert [tuple(r) for r in omics.pair_histogram(e).orderBy("n_pairs").collect()] == [(0, 2, 0.5), (1, 1, 0.75), (2, 1, 1.0)]
    assert {tuple(r) for r in omics.edges_by_pair(e, "Glu", "chemical-synapse").collect()} == {("Glu", "r1", "a", "b"), ("Glu", "r2", "a", "b")}
    assert omics.edges_by_pair(e).count() == 3


def brute_census(nodes, edges):
    found = dict.fromkeys(motifs.TRIADS, 0)
    for t in itertools.combinations(sorted(nodes), 3):
        code = "".join(str(((x, y) in edges) + 2 * ((y, x) in edges)) for x, y in ((t[0], t[1]), (t[0], t[2]), (t[1], t[2])))
        found[motifs.census_map()[code]] += 1
    return found


@pytest.mark.parametrize("density", [0.05, 0.3, 0.8])
def test_census_and_all_triads(spark, density):
    rng = np.random.default_rng(int(density * 100))
    every = [f"v{k}" for k in range(14)]
    edges = {(a, b) for a in every for b in every if a != b and rng.random() < density} | {("v0", x) for x in every[1:]}
    nodes = spark.createDataFrame([(x,) for x in every], "name string")
    df = spark.createDataFrame([*edges, ("v1", "v1")], "pre string, post string")
    want = brute_census(every, edges)
    assert {r.triad: r.n for r in motifs.triad_census(nodes, df).collect()} == want
    two = df.withColumn("replicate", F.explode(F.array(F.lit(1), F.lit(2)))).where("replicate = 1 or pre <> 'v0'")
    less = brute_census(every, {(a, b) for a, b in edges if a != "v0"})
    assert {(r.replicate, r.triad): r.n for r in motifs.triad_census(nodes, two, ("replicate",)).collect()} == {**{(1, k): n for k, n in want.items()}, **{(2, k): n for k, n in less.items()}}
    if density == 0.3:
        for name, m in motifs.triads().items():
            got = {tuple(r) for r in motifs.search(df, m, nodes=nodes).collect()}
            real = {(a, b) for a, b in m.edges}
            assert got == {t for t in itertools.permutations(every, 3) if all(((t[a - 1], t[b - 1]) in edges) == ((a, b) in real) for a, b in itertools.permutations((1, 2, 3), 2))}, name
        with pytest.raises(ValueError, match="table of nodes"):
            motifs.search(df, motifs.triads()["012"])
        apart = motifs.Motif.of([(1, 2), (3, 4)])
        got = {tuple(r) for r in motifs.search(df, apart).collect()}
        assert got == {t for t in itertools.permutations(every, 4) if all(((t[a - 1], t[b - 1]) in edges) == ((a, b) in apart.edges) for a, b in itertools.permutations((1, 2, 3, 4), 2))}


def degrees(rows):
    return sorted(r.pre for r in rows), sorted(r.post for r in rows)


def test_randomize_with_options(spark):
    rng = np.random.default_rng(4)
    edges = {(f"v{a}", f"v{b}", "x" if a < 10 else "y") for a, b in rng.integers(0, 20, (120, 2)).tolist() if a != b}
    df = spark.createDataFrame(list(edges), "pre string, post string, part string")
    for mode in ("edge-swap", "configuration-model"):
        got = nulls.randomize(df, mode, 3, multiplier=2, subgroups="part").collect()
        for part in "xy":
            assert degrees([r for r in got if r.part == part]) == degrees([r for r in df.collect() if r.part == part])
        assert {(r.pre, r.post) for r in got} != {e[:2] for e in edges}
    got = nulls.randomize(df, "num-nodes-edges", 3, subgroups="part").collect()
    for part in "xy":
        own = {x for e in edges if e[2] == part for x in e[:2]}
        mine = [(r.pre, r.post) for r in got if r.part == part]
        assert len(mine) == len(set(mine)) == sum(e[2] == part for e in edges) and all(a != b and {a, b} <= own for a, b in mine)
    with pytest.raises(ValueError):
        nulls.randomize(df, "edge-swap", 3, multiplier=1.5)
    with pytest.raises(ValueError):
        nulls.randomize(df, "edge-swap", 3, subgroups="none")


@pytest.mark.parametrize("mode", nulls.MODES[:3])
def test_replicates_are_keyed_and_differ(spark, mode):
    edges = spark.createDataFrame([(f"v{k}", f"v{(k + j) % 15}") for k in range(15) for j in (1, 2, 4)], "pre string, post string")
    nodes = spark.createDataFrame([(f"v{k}",) for k in range(15)], "name string")
    rows = nulls.replicates(edges, mode, 4, 7, nodes, 3).collect()
    per = {k: [(r.pre, r.post) for r in rows if r.replicate == k] for k in range(4)}
    assert all(len(x) == 45 for x in per.values()) and len({tuple(sorted(x)) for x in per.values()}) == 4
    if mode != "num-nodes-edges":
        assert all(degrees([r for r in rows if r.replicate == k]) == degrees(edges.collect()) for k in range(4))


def test_next_of_ties_and_nulls(spark):
    rng = np.random.default_rng(6)
    rows = [(k, None if k % 17 == 0 else int(rng.integers(0, 40)), int(rng.integers(0, 9))) for k in range(500)]
    df = spark.createDataFrame(rows, "id bigint, at bigint, value bigint")
    got = {r.id: r.next for r in order.with_next(df, "value", ["at", "id"]).collect()}
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {a[0]: b[2] if b else None for a, b in itertools.zip_longest(ordered, ordered[1:])}
    assert order.with_next(df.limit(0), "value", ["at", "id"]).count() == 0


def test_correlations_of_unequal_times(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4, 30))
    rows = [("r" if s < 3 else "q", s, t, float(x[s, t])) for s in range(4) for t in range(30) if not (s == 1 and t % 5 == 0)]
    df = spark.createDataFrame(rows, "recording string, series bigint, t bigint, value double")
    got = {(r.a, r.b): r.r for r in tsa.correlations(df, 2, 28).collect()}
    keep = [t for t in range(2, 28) if t % 5]
    want = {(0, 1): np.corrcoef(x[0, keep], x[1, keep])[0, 1], (0, 2): np.corrcoef(x[0, 2:28], x[2, 2:28])[0, 1], (1, 2): np.corrcoef(x[1, keep], x[2, keep])[0, 1]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_stimulus_is_validated(spark):
    rows = [("n", 0, t, float(t % 5), 0.0) for t in range(30)]
    df = spark.createDataFrame(rows, "neuron string, trial int, t bigint, value double, stim double")
    assert stim.features(df, 10).count() == 1
    for f in (stim.features, stim.characteristics):
        with pytest.raises(ValueError, match="too short"):
            f(df, 30)


def model(spark):
    nodes = spark.createDataFrame([("in", 1.0, 1.0, 0.0, "linear", True), ("a", 1.0, 2.0, 0.0, "linear", False)], "name string, gain double, time_constant double, baseline double, activation string, static boolean")
    edges = spark.createDataFrame([("in", "a", 0.5)], "pre string, post string, weight double")
    return simulate.Parameters(nodes, edges, spark.createDataFrame([("in", t, 1.0 + (t % 7)) for t in range(60)], "name string, t bigint, value double"))


def test_model_updates(spark):
    p = model(spark)
    q = p.update_nodes(spark.createDataFrame([("a", 3.0)], "name string, gain double")).update_edges(spark.createDataFrame([("in", "a", 0.25)], "pre string, post string, weight double"))
    assert {r.name: r.gain for r in q.nodes.collect()} == {"in": 1.0, "a": 3.0} and q.edges.first().weight == 0.25 and q.remove_inputs().inputs is None
    for bad in (spark.createDataFrame([("z", 3.0)], "name string, gain double"), spark.createDataFrame([("a", 3.0)], "name string, colour double")):
        with pytest.raises(ValueError):
            p.update_nodes(bad)


def test_leaking_rates(spark):
    one = spark.createDataFrame([(0,)], "model_id bigint")
    p = fit.applied(model(spark), one)
    got = [r.rate for r in simulate.simulate(p, range(20), "leak").where("name = 'a'").orderBy("t").collect()]
    want = [0.0]
    for k in range(19):
        want.append(want[-1] + (0.5 * (1.0 + k % 7) - want[-1] / 2.0))
    assert np.allclose(got, want)
    with pytest.raises(ValueError):
        simulate.simulate(p, range(3), "none")


def test_windows_are_refitted(spark):
    """A weight that changes halfway is found in the windows before and after."""
    truth = []
    for lo, hi, w in ((0, 30, 0.8), (30, 60, -0.6)):
        rate = 0.0
        for t in range(lo, hi):
            truth.append(("a", t, rate))
            rate += (w * (1.0 + t % 7) - rate) / 2.0
    real = spark.createDataFrame(truth, "name string, t bigint, real double")
    found = fit.refit(model(spark), {"weight:in:a": (-1.0, 1.0)}, real, 30, 30, 16, 3, 1)
    assert found.count() == 2 * 16 * 3 and found.columns == ["window", "trial", "round", "loss", "params"]
    best = {r.window: json.loads(r.p)["weight:in:a"] for r in found.groupBy("window").agg(F.min_by("params", "loss").alias("p")).collect()}
    assert abs(best[0] - 0.8) < 0.03 and abs(best[1] + 0.6) < 0.03


def test_worms_by_style_and_sex(spark, tmp_path):
    f = str(tmp_path)
    spark.createDataFrame([("A", "s", "c", "m"), ("B", "i", "c", "m")], "name string, type string, category string, modality string").coalesce(1).write.csv(f"{f}/cells.csv", header=True)
    for k, rows in (("chemical", [("A", {"B": 2.0})]), ("gap", [("B", {"A": 1.0, "B": 0.0})])):
        spark.createDataFrame(rows, "pre string, adjacency map<string,double>").write.json(f"{f}/{k}.json")
    spark.createDataFrame([("A", (1.0, 2.0, 3.0))], "name string, position struct<AP:double,LR:double,DV:double>").write.json(f"{f}/positions.json")
    h = readers.read_worm(spark, f)
    assert h.connections.count() == 2 and h.neurons.where("position.AP = 1").count() == 1
    assert readers.read_worm(spark, f, gapjn_only=True).connections.count() == 1
    sheet = [(0, "SENSORY", "s1", "A", 0, 2, 1, 5), (1, None, None, "B", 3, None, 0, 0), (2, "SEX SPECIFIC", "HEAD", "CEMDL", 1, 0, 0, 0), (3, None, None, "MCML", 0, 0, 0, 0), (4, None, "MOTOR NEURON", "CP01", 0, 1, 0, 0)]
    for k in ("chemical", "gap"):
        spark.createDataFrame(sheet, "ord int, class string, category string, label string, A int, B int, CEMDL int, muscle int").coalesce(1).write.csv(f"{f}/male_{k}.csv", header=True)
    m = readers.read_worm(spark, f, sex="male")
    assert {r.name: (r.type, r.category) for r in m.neurons.collect()} == {
        "A": ("SENSORY", "s1"), "B": ("SENSORY", "s1"), "CEMDL": ("SENSORY NEURON", "SEX SPECIFIC"), "MCML": ("INTERNEURON", "SEX SPECIFIC"), "CP01": ("MOTOR NEURON", "SEX SPECIFIC"),
    }
    want = {("A", "B", 2.0), ("A", "CEMDL", 1.0), ("B", "A", 3.0), ("CEMDL", "A", 1.0), ("CP01", "B", 1.0)}
    assert {(r.pre, r.post, r.weight) for r in m.connections.where("connection_type = 'chemical-synapse'").collect()} == want and m.connections.count() == 10
    spark.createDataFrame([("A", "B", "chemical", 2), ("BWM-x", "A", "chemical", 1)], "pre string, post string, type string, synapses int").coalesce(1).write.csv(f"{f}/witvliet_L1_2.csv", header=True)
    assert readers.read_worm(spark, f, "witvliet", stage="L1", dataset=2).connections.count() == 1
    with pytest.raises(ValueError):
        readers.read_worm(spark, f, "other")


def test_spent_tables_are_deleted(spark):
    import os

    a = tables.written(spark.range(3), "a")
    path = a.inputFiles()[0].removeprefix("file://")
    b = tables.written(a.where("id > 0"), "b", a)
    assert b.count() == 2 and not os.path.exists(path)
