from itertools import permutations

import numpy as np
import pytest

from neurograph.operators import centrality, motifs


def _network(n, links, seed):
    """A random network whose last nodes are a chain, as (begin, near, lists of neighbours)."""
    rng = np.random.default_rng(seed)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, n, (links, 2)) if a != b} | {(k, k + 1) for k in range(n - 1, n + 20)}
    near = [sorted(b for a, b in pairs if a == k) for k in range(n + 21)]
    return np.concatenate([[0], np.cumsum([len(x) for x in near])]), np.array([b for x in near for b in x], np.int32), near


def test_a_search_follows_few_links_of_a_dense_network(monkeypatch):
    """links that lead back to what was reached before aren't followed; each was, once on the way out and once on the way back."""
    begin, near, lists = _network(400, 16_000, 5)
    search, followed, ranges = centrality._Search(begin, near), [], centrality._ranges
    monkeypatch.setattr(centrality, "_ranges", lambda lo, size: followed.append(int(size.sum())) or ranges(lo, size))
    nodes, found = search.run(np.arange(20), None)
    assert np.allclose(np.bincount(nodes, weights=found, minlength=len(lists)), sum(centrality._accumulate(lists, s)[0] for s in range(20)))
    assert sum(followed) < 20 * len(near) / 4


@pytest.mark.parametrize(("step", "even", "kept"), [(1 << 20, 1 << 13, 1 << 22), (7, 1, 0), (50, 1 << 20, 300), (1 << 20, 1, 0)])
def test_searches_by_either_way_and_in_pieces(monkeypatch, step, even, kept):
    """the same sums from any number of sources at once, whichever way a level is found and whether its links are kept or not; also weighted by states."""
    for name, value in (("STEP", step), ("EVEN", even), ("KEPT", kept)):
        monkeypatch.setattr(centrality, name, value)
    for links in (60, 600):
        begin, near, lists = _network(60, links, links)
        search, n = centrality._Search(begin, near), len(lists)
        total = np.zeros(n)
        search.add(total, np.arange(n), None)
        assert np.allclose(total, sum(centrality._accumulate(lists, s)[0] for s in range(n)))
        x = np.arange(n) % 7 / 7
        weighted, want = np.zeros(n), np.zeros(n)
        search.add(weighted, np.arange(n), x)
        for s in range(n):
            dist, sigma, order = {s: 0}, {s: 1.0}, [s]
            for v in order:
                for w in lists[v]:
                    if w not in dist:
                        dist[w], sigma[w] = dist[v] + 1, 0.0
                        order.append(w)
                    if dist[w] == dist[v] + 1:
                        sigma[w] += sigma[v]
            delta = dict.fromkeys(order, 0.0)
            for v in reversed(order):
                delta[v] = sum(sigma[v] / sigma[w] * (max(0.0, x[s] - x[w]) + delta[w]) for w in lists[v] if dist[w] == dist[v] + 1)
                want[v] += delta[v] if v != s else 0.0
        assert np.allclose(weighted, want)
        assert (search.dist == -1).all() and not search.sigma.any() and not search.delta.any() and not search.some.any()


@pytest.mark.parametrize(("run", "wedges"), [(256, 1 << 18), (4, 40), (1, 3)])
def test_a_last_node_without_links_is_multiplied_out_by_spark(spark, monkeypatch, run, wedges):
    """tasks hand on rows and runs of last nodes that go with all of them, not each match; the matches are those of a search by hand."""
    monkeypatch.setattr(motifs, "RUN", run)
    monkeypatch.setattr(motifs, "WEDGES", wedges)
    rng = np.random.default_rng(3)
    pairs = {(f"u{a}", f"u{b}") for a, b in rng.integers(0, 9, (22, 2)) if a != b} | {("u1", "u2"), ("u2", "u1")}
    names = [f"u{k}" for k in range(23)]
    edges, nodes = spark.createDataFrame(sorted(pairs), "pre string, post string"), spark.createDataFrame([(n,) for n in names], "name string")
    for triad in ("012", "102", "003"):
        want = [p for p in permutations(names, 3) if {(i + 1, j + 1) for i in range(3) for j in range(3) if (p[i], p[j]) in pairs} == set(motifs.TRIADS[triad])]
        found = motifs.search(edges, motifs.triads()[triad], nodes=nodes)
        assert found.columns == ["n_1", "n_2", "n_3"] and sorted(tuple(r) for r in found.collect()) == sorted(want)
        assert "Generate explode" in found._jdf.queryExecution().executedPlan().toString()
        ranges = motifs._ready(edges, motifs.triads()[triad], True, nodes)[0]
        groups = list(ranges.found(0, ranges.size))
        assert sum(int(a) * int(b) for _, rows, _, last in groups for a, b in zip(rows, last, strict=True)) == len(want)
        assert all(len(x) == rows.sum() for nodes_, rows, _, _ in groups for x in nodes_) and all(len(ids) == last.sum() for _, _, ids, last in groups)
        if run == 4:
            assert any((rows > 1).any() for _, rows, _, _ in groups)
