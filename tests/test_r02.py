"""Tests of the findings of round 2."""

import os
import random
import time
from itertools import combinations, permutations

import numpy as np

from pyspark.sql import functions as F

from neurograph.operators import adjacency, centrality, motifs, nulls, tsa
from neurograph.sources.tables import shared_folder, written


def _random_edges(n, m, seed):
    rng = random.Random(seed)
    return sorted({(f"v{a}", f"v{b}") for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def test_exploded_rows_are_not_broadcast(spark):
    """a hundred copies of an edge pass for one in the optimizer's sizes."""
    edges = spark.createDataFrame(_random_edges(30, 200, 1), "pre string, post string")
    null = nulls.replicates(edges, "configuration-model", 100, 1)
    plan = null._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [replicate" in plan
    got = null.collect()
    assert len(got) == 100 * edges.count()
    for k in (0, 99):
        mine = [r for r in got if r.replicate == k]
        assert sorted(r.pre for r in mine) == sorted(r.pre for r in edges.collect()) and sorted(r.post for r in mine) == sorted(r.post for r in edges.collect())
    assert [r.post for r in sorted(r for r in got if r.replicate == 0)] != [r.post for r in sorted(r for r in got if r.replicate == 1)]


def test_census_in_groups_of_colours(spark, monkeypatch):
    """triangles are found inside groups of links, each once."""
    nets = {s: _random_edges(25, 260, s) for s in (2, 3)}
    names = [f"v{k}" for k in range(25)]
    want, kinds = {}, motifs.census_map()
    for s, e in nets.items():
        e = set(e)
        for a, b, c in combinations(names, 3):
            t = kinds["".join(str(((x, y) in e) + 2 * ((y, x) in e)) for x, y in ((a, b), (a, c), (b, c)))]
            want[s, t] = want.get((s, t), 0) + 1
    rows = spark.createDataFrame([(s, *p) for s, e in nets.items() for p in e], "replicate int, pre string, post string")
    nodes = spark.createDataFrame([(n,) for n in names], "name string")
    for group in (10**6, 60):
        monkeypatch.setattr(motifs, "GROUP", group)
        monkeypatch.setattr(motifs, "WEDGES", 50)
        got = {(r.replicate, r.triad): r.n for r in motifs.triad_census(nodes, rows, ("replicate",)).collect() if r.n}
        assert got == want


def test_searches_from_several_sources(spark, monkeypatch):
    """the same sums as one search a source; no bound on links, and sources without links cost nothing."""
    names = sorted({x for e in _random_edges(40, 120, 4) for x in e})
    pairs = [(names.index(a), names.index(b)) for a, b in _random_edges(40, 120, 4)]
    near = [sorted(b for a, b in pairs if a == k) for k in range(len(names))]
    want = sum(centrality._accumulate(near, s)[0] for s in range(len(names)))
    monkeypatch.setattr(centrality, "MOST_EDGES", 10)
    monkeypatch.setattr(centrality, "STEP", 7)
    edges = spark.createDataFrame(_random_edges(40, 120, 4), "pre string, post string")
    got = {r.name: r.betweenness for r in centrality.betweenness(edges, normalized=False).collect()}
    assert sorted(got) == names and all(abs(got[n] - w) < 1e-9 for n, w in zip(names, want, strict=True))
    begin = np.concatenate([[0], np.cumsum([len(x) for x in near])])
    search = centrality._Search(begin, np.array([x for row in near for x in row], np.int32))
    nodes, found = search.run(np.arange(len(names)), None)
    assert np.allclose(np.bincount(nodes, weights=found, minlength=len(names)), want)
    assert (search.dist == -1).all() and not search.sigma.any() and not search.delta.any()


def _series(spark, seed, gaps=False):
    rng = random.Random(seed)
    rows = [(k % 2, k, t, rng.gauss(0, 1) + 0.3 * t * (k % 3) if k != 4 else 1.0) for k in range(14) for t in range(20) if not (gaps and k in (3, 5) and t == 7)]
    return rows, spark.createDataFrame(rows, "recording int, series bigint, t bigint, value double")


def test_correlations_in_blocks(spark, monkeypatch):
    """Products of blocks give each pair once, and series of other times are still joined."""
    monkeypatch.setattr(tsa, "BLOCK", 3)
    rows, df = _series(spark, 5, True)
    got = [(r.a, r.b, r.r) for r in tsa.correlations(df).collect()]
    at = {k: {t: x for _, s, t, x in rows if s == k} for k in range(14)}
    want = {(a, b) for a in range(14) for b in range(a + 1, 14) if a % 2 == b % 2}
    assert len(got) == len(want) and {(a, b) for a, b, _ in got} == want
    for a, b, r in got:
        both = sorted(set(at[a]) & set(at[b]))
        if 4 in (a, b):
            assert r is None
        else:
            assert abs(r - np.corrcoef([at[a][t] for t in both], [at[b][t] for t in both])[0, 1]) < 1e-9
    plan = tsa.connected_share(tsa.correlations(df), F.expr("(a + b) % 4 = 0"), [0.1])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan


def test_windows_need_no_pairs(spark):
    """means over all pairs from sums over series; none of a series that doesn't vary."""
    rows, df = _series(spark, 6)
    wins = [(4, 0), (4, 9), (8, 12), (20, 0), (30, 0)]
    out = tsa.window_correlations(df, spark.createDataFrame(wins, "size int, start int"))
    assert "zip_with" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["size"]: r.mean_r for r in out.collect()}
    at = {k: [x for _, s, _, x in rows if s == k] for k in range(14)}
    for size in (4, 8, 20):
        want = [np.corrcoef(at[a][s : s + n], at[b][s : s + n])[0, 1] for n, s in wins if n == size for a in range(14) for b in range(a + 1, 14) if a % 2 == b % 2 and 4 not in (a, b)]
        assert abs(got[size] - np.mean(want)) < 1e-9
    assert set(got) == {4, 8, 20}


def test_search_over_arrays_of_neighbours(spark, monkeypatch):
    """No absent edge is a join, with or without a broadcast, and nodes without edges come in parts."""
    edges = _random_edges(12, 40, 7)
    names, e = [f"v{k}" for k in range(12)], set(edges)
    df, nodes = spark.createDataFrame(edges, "pre string, post string"), spark.createDataFrame([(n,) for n in names], "name string")
    monkeypatch.setattr(motifs, "PART", 5)
    for shared, triad in ((0, "030T"), (10**6, "021D"), (0, "012")):
        monkeypatch.setattr(motifs, "SHARED", shared)
        m = motifs.triads()[triad]
        found = motifs.search(df, m, nodes=nodes)
        assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()
        want = {t for t in permutations(names, 3) if all(((t[a - 1], t[b - 1]) in e) == ((a, b) in m.edges) for a, b in permutations((1, 2, 3), 2))}
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want


def test_matches_are_not_shuffled(spark):
    """Ranges of links give named matches, by any order of nodes, and no join or exchange holds one."""
    edges = _random_edges(14, 60, 8) + [("v0", "w"), ("w", "v0")]
    names, e = sorted({x for p in edges for x in p} | {"alone"}), set(edges)
    df, nodes = spark.createDataFrame(edges, "pre string, post string"), spark.createDataFrame([(n,) for n in names], "name string")
    for triad in ("021U", "102", "030C", "021C", "030T"):
        m = motifs.triads()[triad]
        found = motifs.search(df, m, nodes=nodes)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got))
        assert set(got) == {t for t in permutations(names, 3) if all(((t[a - 1], t[b - 1]) in e) == ((a, b) in m.edges) for a, b in permutations((1, 2, 3), 2))}


def test_search_in_small_pieces(spark, monkeypatch):
    """A hub's neighbours come in pieces, codes are looked up for few nodes at a time, and longer chains ask for other nodes' codes, too."""
    edges = _random_edges(10, 30, 9) + [("hub", f"v{k}") for k in range(10)]
    names, e = sorted({x for p in edges for x in p}), set(edges)
    df = spark.createDataFrame(edges, "pre string, post string")
    for k, x in {"WEDGES": 3, "MARKS": 25, "GROUP": 7, "PART": 4}.items():
        monkeypatch.setattr(motifs, k, x)
    chain = motifs.hypermotif(motifs.Motif.of([(1, 2)]), 3, [(2, 1)])
    square = motifs.Motif.of([(1, 2), (2, 3), (3, 4), (4, 1)])
    for m in (motifs.triads()["021C"], chain, square):
        want = {t for t in permutations(names, len(m.nodes)) if all(((t[i], t[j]) in e) == ((m.nodes[i], m.nodes[j]) in m.edges) for i, j in permutations(range(len(t)), 2))}
        got = [tuple(r) for r in motifs.search(df, m).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_census_leaves_nothing_behind(spark):
    """links are shuffled once, and neither they nor the arrays stay on disk until the next network's."""
    edges = _random_edges(20, 90, 10) + [("v1", "v1"), ("v2", "not a node")]
    df, nodes = spark.createDataFrame(edges, "pre string, post string"), spark.createDataFrame([(f"v{k}",) for k in range(20)], "name string")
    folder = shared_folder(spark).removeprefix("file://") + "/neurograph"
    held = lambda: {x for x in (os.listdir(folder) if os.path.isdir(folder) else []) if x.startswith(("links", "adjacency", "dyads"))}
    before = held()
    found = motifs.triad_census(nodes, df)
    assert held() == before
    assert sum(r.n for r in found.collect()) == 20 * 19 * 18 // 6
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def _shuffle_files(spark):
    folders = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def test_a_search_leaves_no_shuffle_files(spark):
    """The files of a step's shuffle go before the next step, not when the driver's JVM collects its garbage, and the setting is as before."""
    setting, edges = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", _random_edges(14, 60, 11)
    df, old = spark.createDataFrame(edges, "pre string, post string"), spark.conf.get(setting, None)
    before = _shuffle_files(spark)
    found = motifs.search(df, motifs.triads()["030C"])
    for _ in range(20):
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(setting, None) == old
    names, e = sorted({x for p in edges for x in p}), set(edges)
    m = motifs.triads()["030C"]
    assert {tuple(r) for r in found.collect()} == {t for t in permutations(names, 3) if all(((t[a - 1], t[b - 1]) in e) == ((a, b) in m.edges) for a, b in permutations((1, 2, 3), 2))}


def test_repeated_links_are_not_shuffled_to_be_distinct(spark, monkeypatch):
    """Links may repeat, and are written as they come; a task drops repeated ones before it deals them."""
    edges, plans = _random_edges(12, 50, 12), {}
    monkeypatch.setattr(motifs, "written", lambda df, label, *spent: plans.update({label: df._jdf.queryExecution().executedPlan().toString()}) or written(df, label, *spent))
    monkeypatch.setattr(adjacency, "BLOCK", 16)
    df = spark.createDataFrame(edges * 5 + [("v1", "v1")] * 3, "pre string, post string")
    names, e = sorted({x for p in edges for x in p}), set(edges)
    nodes = spark.createDataFrame([(n,) for n in names], "name string")
    for triad in ("021U", "102", "021C"):
        m = motifs.triads()[triad]
        got = [tuple(r) for r in motifs.search(df, m, nodes=nodes).collect()]
        assert "Exchange" not in plans["pairs"]
        assert len(got) == len(set(got))
        assert set(got) == {t for t in permutations(names, 3) if all(((t[a - 1], t[b - 1]) in e) == ((a, b) in m.edges) for a, b in permutations((1, 2, 3), 2))}


def test_types_of_matched_edges_are_counted_in_tasks(spark, monkeypatch):
    """F16: edges of matches are counted where they are found; as rows they were joined with types, and broadcast, as the optimizer took them for few."""
    from neurograph.operators import stats
    from neurograph.plans import registry

    monkeypatch.setattr(motifs, "PART", 3)
    edges, m = _random_edges(14, 70, 13), motifs.triads()["030T"]
    df = spark.createDataFrame(edges * 2, "pre string, post string")
    # a name with two types, one with a type twice, one without a type, one with none of its own row, and one that isn't in the network
    typed = [(f"v{i}", "xyz"[i % 3]) for i in range(3, 14)] + [("v0", "x"), ("v0", "y"), ("v1", "z"), ("v1", "z"), ("v3", None), ("far", "q")]
    types = spark.createDataFrame(typed, "name string, type string")
    want = stats.with_types(motifs.match_edges(motifs.search(df, m), m), types).groupBy("pre_type", "post_type").agg(F.count("*").alias("n"))
    got = motifs.edge_types(df, m, types)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count()
    plan = registry.QUERIES["motif_edge_types"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


def test_types_of_no_matches(spark):
    m = motifs.triads()["030T"]
    types = spark.createDataFrame([("a", "x")], "name string, type string")
    assert motifs.edge_types(spark.createDataFrame([("a", "b")], "pre string, post string"), m, types).collect() == []
    assert motifs.edge_types(spark.createDataFrame([("a", "b"), ("c", "b"), ("a", "c")], "pre string, post string"), m, types.where("false")).collect() == []
    assert motifs.edge_types(spark.createDataFrame([], "pre string, post string"), m, types).collect() == []


def _matches(names, edges, m):
    e = set(edges)
    return {t for t in permutations(names, 3) if all(((t[a - 1], t[b - 1]) in e) == ((a, b) in m.edges) for a, b in permutations((1, 2, 3), 2))}


def _runs(rows):
    return 1 + sum(x != y for x, y in zip(rows, rows[1:], strict=False))


def test_matches_of_a_star_come_by_its_middle(spark, monkeypatch):
    """rows around one node come together, which are a fraction of the size once written; of hubs, too, whose neighbours aren't walked for each row."""
    monkeypatch.setattr(motifs, "WEDGES", 64)
    edges = [*_random_edges(30, 160, 14), *((f"v{i}", "hub") for i in range(30, 110)), *(("hub", f"v{i}") for i in range(25, 40)), *((f"v{i}", f"v{i + 1}") for i in range(20, 60))]
    names, df = sorted({x for p in edges for x in p}), spark.createDataFrame(edges, "pre string, post string")
    for triad, middle in (("021C", "n_3"), ("021U", "n_3"), ("021D", "n_3"), ("111D", "n_2"), ("111U", "n_2"), ("201", "n_1")):
        m = motifs.triads()[triad]
        got = motifs.search(df, m).coalesce(1).collect()
        assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == _matches(names, edges, m)
        if triad.startswith("021"):
            of = [r[middle] for r in got]
            assert _runs(of) == len(set(of))



def test_nodes_without_links_come_in_runs_that_rows_share(spark, monkeypatch):
    """a run of unlinked nodes comes for one pair after the other, so that the rows, as many as pairs times nodes, repeat and are small once written."""
    monkeypatch.setattr(motifs, "RUN", 4)
    edges = _random_edges(16, 70, 15)
    names = sorted({x for p in edges for x in p} | {"lone", "other"})
    df, nodes = spark.createDataFrame(edges, "pre string, post string"), spark.createDataFrame([(n,) for n in names], "name string")
    for wedges, marks in ((1 << 18, 1 << 25), (8, 40)):
        monkeypatch.setattr(motifs, "WEDGES", wedges)
        monkeypatch.setattr(motifs, "MARKS", marks)
        for triad in ("102", "012"):
            m = motifs.triads()[triad]
            got = motifs.search(df, m, nodes=nodes).coalesce(1).collect()
            assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == _matches(names, edges, m)
            pairs = [(r["n_1"], r["n_2"]) for r in got]
            assert wedges == 8 or _runs(pairs) > len(set(pairs))
    got = motifs.search(df.where("false"), motifs.triads()["003"], nodes=nodes.limit(5)).collect()
    assert len(set(map(tuple, got))) == len(got) == 60
