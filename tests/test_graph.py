"""Networks: building, groups, filters, folding, paths, writers."""

import json
import random
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from neurograph.model import CHEMICAL, GAP, Network, Organism, signature_dict
from neurograph.operators import build, combine, fold, layout, motifs, neighbors, nulls, omics, paths, select, stats
from neurograph.sources import readers, writers

EDGE = "pre string, post string, uid int, connection_type string, weight double"


@pytest.fixture(scope="module")
def typed(spark):
    nodes = spark.createDataFrame([("ASHL", "sensory"), ("AVM", "sensory"), ("AVAL", "interneuron"), ("AVBL", "interneuron")], "name string, type string")
    edges = spark.createDataFrame([("ASHL", "AVAL", 0, CHEMICAL, 1.0), ("AVAL", "AVM", 0, CHEMICAL, 1.0), ("AVAL", "AVBL", 0, CHEMICAL, 1.0), ("AVBL", "AVAL", 0, CHEMICAL, 1.0)], EDGE)
    return Network("typed", nodes, edges)


def test_typed_groups_and_degrees(typed):
    assert [select.by_type(typed.neurons, t, "type").count() for t in ("sensory", "motor", "interneuron")] == [2, 0, 2]
    got = {r.name: (r.in_degree, r.out_degree) for r in stats.degrees(typed.neurons, typed.connections).collect()}
    assert got["ASHL"] == (0, 1) and got["AVAL"] == (2, 2)
    net = typed.make_neuron_group("s", ["ASHL", "AVM"])
    assert net.num_groups == 3 and net.delete_group("s").num_groups == 2
    with pytest.raises(ValueError):
        net.make_neuron_group("s", [])


def test_connection_group(spark):
    e = spark.createDataFrame([("AVAL", "AVBL", 0, CHEMICAL, 1.0), ("AVBL", "AVAR", 1, GAP, 0.5), ("AVAL", "AVAR", 2, "neuropeptide", 0.8)], EDGE)
    s = stats.edge_statistics(e).first()
    assert (s["count"], s.min_weight, s.max_weight, s.types) == (3, 0.5, 1.0, {CHEMICAL: 1, GAP: 1, "neuropeptide": 1})
    assert {r.weight for r in build.update_weights(build.update_weights(e, 2.0), 0.5, delta=True).collect()} == {2.5}
    empty = stats.edge_statistics(e.limit(0)).first()
    assert tuple(empty)[:4] == (0, 0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        build.update_weights(e, "x")


def test_paths_as_columns(spark):
    rows = [([("AVAL", "AVBL", 0, CHEMICAL, 1.0), ("AVBL", "AVAR", 1, GAP, 0.5)], [("AVAR", "AVBR", 0, CHEMICAL, 0.8)]), ([], [])]
    p = spark.createDataFrame(rows, f"a array<struct<{EDGE.replace(' ', ':').replace(',:', ',')}>>, b array<struct<{EDGE.replace(' ', ':').replace(',:', ',')}>>")
    w = p.select(*[c.alias(k) for k, c in paths.path_weights(F.col("a")).items()]).collect()
    assert [tuple(r) for r in w] == [(2, 1.5, 0.75, 0.5, 1.0), (0, 0.0, 0.0, 0.0, 0.0)]
    both = p.select(paths.concat_paths(F.col("a"), F.col("b")).alias("e"))
    assert [round(r[0], 6) for r in both.select(paths.path_weights(F.col("e"))["total_weight"]).collect()] == [2.3, 0.0]
    back = p.select(paths.reverse_path(F.col("a")).alias("e"))
    assert [r[0] for r in back.select(paths.path_nodes(F.col("e"))).collect()] == [["AVAR", "AVBL", "AVAL"], []]
    assert [tuple(r) for r in p.select(paths.is_continuous(F.col("a")), paths.is_continuous(F.concat("b", "a"))).collect()] == [(True, False), (True, True)]
    with pytest.raises(Exception, match="begin where"):
        p.limit(1).select(paths.concat_paths(F.col("b"), F.col("a"))).collect()


def test_suffix_classes(spark):
    text = "AVAL→AVA; AVAR→AVA; AVBL→AVB; RMEDL→RME; RMED→RME; RMEL→RME; IL2DL→IL2; IL2L→IL2; I1L→I1; VB01→VB; VC04→VC; DA09→DA; MCL→MC; AVL→AVL; RID→RID; ADAL→ADA; M3L→M3; M1→M1; DVA→DVA; SIADL→SIA; AWCL→AWC; CEPDL→CEP; PVDL→PVD; AVM→AVM"
    want = dict(x.split("→") for x in text.split("; "))
    names = spark.createDataFrame([(n,) for n in want], "name string")
    assert {r.name: r.c for r in names.select("name", fold.suffix_class(F.col("name")).alias("c")).collect()} == want


def test_left_right_square(spark):
    rows = spark.createDataFrame([("AVAL", {"AVBL": 1.0}), ("AVAR", {"AVBR": 1.0}), ("AVBL", {"AVAL": 1.0}), ("AVBR", {"AVAR": None, "AVBL": 0.0})], "pre string, adjacency map<string,double>")
    nodes = spark.createDataFrame([(n,) for n in ("AVAL", "AVAR", "AVBL", "AVBR")], "name string")
    net = Network("sq", nodes, build.explode_adjacency(rows, "adjacency", "chemical"))
    joined = fold.join_left_right(net)
    assert {r.name for r in joined.neurons.collect()} == {"AVA", "AVB"} and joined.connections.count() == 4
    clean = fold.by_suffix(net)
    assert {(r.pre, r.post): r.weight for r in clean.connections.collect()} == {("AVA", "AVB"): 2.0, ("AVB", "AVA"): 2.0}


def test_fold_exceptions_and_loops(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdx"], "name string")
    edges = spark.createDataFrame([("a", "b", 0, "k", 1.0), ("b", "b", 0, "k", 2.0), ("b", "x", 0, "k", 4.0), ("c", "x", 0, "k", 8.0), ("d", "c", 0, "k", 16.0)], EDGE)
    net = Network("n", nodes, edges)
    classes = spark.createDataFrame([("a", "AB", 0), ("b", "AB", 1), ("c", "C", 0), ("d", "D", 0), ("x", "D", 1)], "name string, class string, ord int")

    def folded(**o):
        f = fold.fold_network(net, classes, **o)
        return sorted(r.name for r in f.neurons.collect()), {(r.pre, r.post): r.weight for r in f.connections.collect()}

    assert folded() == (["AB", "C", "D"], {("AB", "AB"): 3.0, ("AB", "D"): 4.0, ("C", "D"): 8.0, ("D", "C"): 16.0})
    assert folded(self_loops=False)[1][("AB", "AB")] == 2.0
    assert folded(exceptions=("a",))[0] == ["C", "D", "a", "b"]
    assert folded(exceptions=("x",))[0] == ["AB", "C", "d", "x"]
    with pytest.raises(ValueError):
        fold.fold_network(net, classes, data="other")


def test_build_and_errors(spark, typed):
    labels = spark.createDataFrame([(0, "a"), (1, "b")], "ord int, name string")
    got = build.create_neurons(labels, type="x", n=[5, 6], m={"a": 1}).orderBy("ord").collect()
    assert [(r.type, r.n, r.m) for r in got] == [("x", 5, 1), ("x", 6, None)]
    for bad in ({"n": [1]}, {"m": {"z": 1}}):
        with pytest.raises(ValueError):
            build.create_neurons(labels, **bad)
    with pytest.raises(NotImplementedError):
        build.create_neurons(labels, x=object())
    with pytest.raises(ValueError):
        build.create_neurons(labels.union(labels))
    with pytest.raises(TypeError):
        build.create_connections(typed, spark.createDataFrame([("ASHL", "nobody", 0, "k", 1.0)], EDGE))
    with pytest.raises(TypeError):
        build.remove_neurons(typed, spark.createDataFrame([("nobody",)], "name string"))
    left = build.remove_neurons(typed, spark.createDataFrame([("AVAL",)], "name string"))
    assert left.neurons.count() == 3 and left.connections.count() == 0
    with pytest.raises(KeyError):
        select.subnetwork(typed, names=["nobody"])
    with pytest.raises(ValueError):
        select.matches({"a": 1}, "XOR")
    assert {r.name for r in neighbors.connected(typed, "AVAL", above=0).collect()} == {"ASHL", "AVM", "AVAL", "AVBL"}
    assert neighbors.connects_to(typed, "AVM", "AVAL") and not neighbors.connects_to(typed, "AVM", "ASHL")
    gap = build.gap_junctions(spark.createDataFrame([("a", {"b": -1.0, "c": 2.0})], "pre string, adjacency map<string,double>"), "adjacency").collect()
    assert [(r.post, r.uid, r.connection_type) for r in gap] == [("c", 1, GAP)]


def random_graph(spark, n, p, seed):
    rng = random.Random(seed)
    edges = [(f"v{a:02d}", f"v{b:02d}") for a, b in permutations(range(n), 2) if rng.random() < p]
    return [f"v{k:02d}" for k in range(n)], set(edges), spark.createDataFrame(edges, "pre string, post string")


@pytest.mark.parametrize("p", [0.08, 0.3])
def test_census_and_motifs_against_brute_force(spark, p):
    names, edges, df = random_graph(spark, 12, p, 5)
    codes, want = motifs.census_map(), dict.fromkeys(motifs.TRIADS, 0)
    for a, b, c in combinations(names, 3):
        want[codes["".join(str(((x, y) in edges) + 2 * ((y, x) in edges)) for x, y in ((a, b), (a, c), (b, c)))]] += 1
    nodes = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.triad: r.n for r in motifs.triad_census(nodes, df).collect()} == want
    for t in ("030T", "021D", "120C", "300"):
        m = motifs.triads()[t]
        found = {tuple(r) for r in motifs.search(df, m).select("n_1", "n_2", "n_3").collect()}
        assert found == {x for x in permutations(names, 3) if {(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i != j and (x[i - 1], x[j - 1]) in edges} == set(m.edges)}
        assert motifs.search(df, m, distinct_sets=True).count() == want[t]


def test_hypermotif():
    h = motifs.hypermotif(motifs.Motif.of([(1, 2), (2, 3)]), 3, [(3, 1)])
    assert h.nodes == ("1.1", "1.2", "1.3-2.1", "2.2", "2.3-3.1", "3.2", "3.3") and len(h.edges) == 6
    with pytest.raises(AssertionError):
        motifs.hypermotif(motifs.Motif.of([(1, 2)]), 2, [(1, 1), (2, 1)])


def test_parallel_edges_match_no_motif(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "z")], "pre string, post string")
    m = motifs.Motif.of([(1, 2), (2, 3)])
    assert {tuple(r) for r in motifs.search(df, m).collect()} == {("a", "b", "c"), ("x", "y", "z")}
    assert motifs.search(df, m, collapse_parallel=False).count() == 0


def test_simple_paths_against_brute_force(spark):
    names, edges, df = random_graph(spark, 9, 0.25, 2)

    def walk(path):
        if len(path) > 1:
            yield tuple(path)
        if len(path) < 5:
            for a, b in edges:
                if a == path[-1] and b not in path:
                    yield from walk([*path, b])

    got = {tuple(r.nodes) for r in paths.simple_paths(df, spark.createDataFrame([("v00",)], "name string"), 4).collect()}
    assert got == set(walk(["v00"]))


def test_null_models(spark):
    _, edges, df = random_graph(spark, 30, 0.15, 3)
    ends = df.select(F.explode(F.array("pre", "post")).alias("name")).distinct()
    want = sorted(map(tuple, stats.degrees(ends, df).collect()))
    for made in (nulls.configuration_model(df, 1), nulls.edge_swap(df, 1, 4)):
        assert sorted(map(tuple, stats.degrees(ends, made).collect())) == want
    swapped = {tuple(r) for r in nulls.edge_swap(df, 1, 4).collect()}
    assert len(swapped) == len(edges) and all(a != b for a, b in swapped) and len(swapped & edges) < 0.8 * len(edges)
    for m in (5, 200, 800):
        e = nulls.random_edges(ends, m, 2).collect()
        assert len({tuple(r) for r in e}) == len(e) == m and all(r.pre != r.post for r in e)
    kinds = ends.select("name", F.when(F.substring("name", 3, 1) < "4", "x").otherwise("y").alias("type"))
    made = nulls.stub_matching(df, kinds, 3).collect()
    assert len({(r.pre, r.post) for r in made}) == len(made) and all(r.pre != r.post for r in made)
    count = lambda rows: sorted((r.pre_type, r.post_type, r.n) for r in rows.groupBy("pre_type", "post_type").agg(F.count("*").alias("n")).collect())
    assert count(spark.createDataFrame(made)) == count(stats.with_types(df, kinds))
    with pytest.raises(ValueError):
        nulls.randomize(df, "other", 1)


def test_omics(spark):
    lig = spark.createDataFrame([("AVAL", "GABA", "", 0), ("AVBL", "ACh", "GABA", 1)], "Neuron string, `Neurotransmitter 1` string, `Neurotransmitter 2` string, ord int")
    assert {r.neuron: r.ligands for r in omics.ligands(lig).collect()} == {"AVAL": ["GABA"], "AVBL": ["ACh", "GABA"]}
    npr = spark.createDataFrame([("gab-1", True, True), ("gab-2", False, False), ("ach-1", True, True), ("ach-2", False, False)], "gene_name string, AVAL boolean, AVAR boolean")
    m = spark.createDataFrame([("gab-1", "GABA"), ("gab-2", "GABA"), ("ach-1", "ACh"), ("ach-2", "ACh")], "gene string, ligand string")
    got = omics.receptors(npr, m).where("neuron = 'AVAL'").collect()
    assert {r.receptor: r.ligand for r in got} == {"gab-1": "GABA", "ach-1": "ACh"}
    neurons = spark.createDataFrame([(n,) for n in ("ASHL", "ASHR", "AWCL", "VD03", "RMED", "VC04", "DB01", "XYZ", "DVA")], "name string")
    classes = spark.createDataFrame([(c, k) for k, c in enumerate(("ASH", "DB", "DB0", "DVA", "V"))], "class string, ord int")
    assert {r.name: r["class"] for r in omics.expression_class(neurons, classes).collect()} == {"ASHL": "ASH", "ASHR": "ASH", "AWCL": "AWC_OFF", "VD03": "VD_DD", "RMED": "RME_DV", "VC04": "VC_4_5", "DB01": "DB0", "XYZ": None, "DVA": "DVA"}


def test_readers(spark):
    rows = spark.createDataFrame([("AVAL", "BWM-1", "chemical", "3"), ("AVAL", "AVBL", "chemical", "2")], "pre string, post string, type string, synapses string")
    net = readers.edge_list(rows)
    assert net.neurons.count() == 2 and [r.weight for r in net.connections.collect()] == [2.0]
    with pytest.raises(ValueError):
        readers.check_dataset("L9", 1)
    wide = spark.createDataFrame([("a", 1.0, None, 3.0), ("b", 0.0, 2.0, 1.0)], "row string, a double, b double, total double")
    assert {(r.pre, r.post) for r in readers.wide_adjacency(wide, "row").collect()} == {("a", "a"), ("b", "b")}
    raw = spark.createDataFrame([("w1", [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], {"1": ("AVA",), "2": ("AVB?",)})], "recording string, trace_array array<array<double>>, labeled map<string,struct<label:string>>")
    assert [(r.neuron, r.t, r.value) for r in readers.recordings(raw).orderBy("t").collect()] == [("AVA", 0, 1.0), ("AVA", 1, 2.0)]
    found, none = readers.join_lineage(spark.createDataFrame([("VB01",), ("AVA",)], "name string"), spark.createDataFrame([("VB1", "x")], "Neuron string, lineage string"))
    assert [r.lineage for r in found.collect()] == ["x"] and [r.name for r in none.collect()] == ["AVA"]
    names, xyz = spark.createDataFrame([(1, "p", "g"), (2, "q", "g")], "root_id bigint, name string, group string"), spark.createDataFrame([(1, "[ 1  2 3]")], "root_id bigint, position string")
    cells, syn = spark.createDataFrame([(1, 5)], "root_id bigint, length_nm int"), spark.createDataFrame([(1, 2, 7, "GABA")], "pre_root_id bigint, post_root_id bigint, syn_count int, nt_type string")
    fly = readers.fly(names, xyz, cells, syn)
    assert [tuple(r) for r in fly.connections.collect()] == [("p", "q", "GABA", 7.0)] and fly.neurons.where("name = 'p'").first().position == [1, 2, 3]
    filled = readers.fill_down(spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, None)], "i int, c string"), ["c"], "i")
    assert [r.c for r in filled.orderBy("i").collect()] == ["a", "a", "b", "b"]


def test_save_load_export(spark, typed, tmp_path):
    writers.save(typed.make_neuron_group("g", ["AVM"]), str(tmp_path / "net"))
    back = writers.load(spark, str(tmp_path / "net"))
    assert back.name == "typed" and back.neurons.count() == 4 and back.connections.count() == 4 and back.groups["g"].count() == 1
    for fmt in writers.FORMATS:
        writers.export_graph(typed, str(tmp_path / f"x.{fmt}"), fmt)
    assert len(json.loads((tmp_path / "x.json").read_text())["elements"]["edges"]) == 4 and (tmp_path / "x.dot").read_text().count("->") == 4
    with pytest.raises(ValueError):
        writers.export_graph(typed, str(tmp_path / "x"), "png")
    assert writers.edges_json(typed).count() == 8


def test_consensus_and_maps(spark, typed):
    other = Network("other", typed.neurons, typed.connections.where("pre <> 'ASHL'").withColumn("weight", F.lit(3.0)))
    joined = combine.join_networks([typed, other])
    assert joined.connections.count() == 3 and {r.weight for r in joined.connections.collect()} == {2.0}
    with pytest.raises(AssertionError):
        combine.join_networks([typed, typed])
    with pytest.raises(ValueError):
        combine.graph_map(spark.createDataFrame([("ASHL", "nobody")], "src string, dst string"), typed, other)


def test_organism():
    w = Organism("worm")
    assert (w.stage, w.sex, w.genotype) == ("Day-1 Adult", "Hermaphrodite", "N2") and w.name.startswith("Worm-") and len(w.name) == 13
    w.add_context("c", {"t": 20})
    w.set_active_context("c")
    w.remove_context("c")
    assert w.active is None and w.get_context("c") is None
    with pytest.raises(ValueError):
        w.set_active_context("c")
    assert signature_dict("S", {"b": 1, "_x": 2, "name": "n", "a": 0}) == {"S:a": "0", "S:b": "1"}


def test_layout(spark, typed):
    nodes = spark.createDataFrame([("a", (1.0, 2.0, 3.0)), ("b", (4.0, 5.0, 6.0))], "name string, position struct<AP:double,LR:double,DV:double>")
    net = Network("p", nodes, typed.connections.limit(0))
    got = layout.positions(net, ("AP", "LR", "DV"), reverse=("AP", "DV"), fixed={"b": {"AP": 9.0}}).orderBy("name").collect()
    assert [tuple(r) for r in got] == [("a", -1.0, -2.0, 3.0), ("b", -9.0, -5.0, 6.0)]
    assert [r.name for r in select.within(nodes, {"AP": (0, 2), "LR": (-2, 0)}).collect()] == ["a"]
    with pytest.raises(ValueError):
        layout.positions(net.with_(neurons=nodes.withColumn("position", F.lit(None).cast(nodes.schema["position"].dataType))))
    with pytest.raises(AssertionError):
        layout.highlighted(nodes, ["z"])


def test_percolation_states_at_any_id(spark, monkeypatch):
    """The states of a network don't depend on how large its ids are: 70,000 is a multiple of 7."""
    from neurograph.plans import structure

    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (2, 6), (6, 4), (5, 1)]
    got = []
    for shift in (0, 70_000):
        monkeypatch.setattr(structure.v, "follows", lambda spark, sf, shift=shift: spark.createDataFrame([(str(a + shift), str(b + shift)) for a, b in pairs], "pre string, post string"))
        got.append({int(r.name) - shift: round(r.percolation, 12) for r in structure.percolation(spark, "").collect()})
    assert got[0] == got[1] and any(got[0].values())
