"""Centralities and partitions. Per-source searches run in parallel, each task holding the adjacency of one network."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurograph.operators.nulls import ranked
from neurograph.sources.tables import written

#: Edges that a broadcast adjacency may have.
MOST_EDGES = 5_000_000


def adjacency(edges: DataFrame, directed: bool = True) -> tuple[list, list[list[int]]]:
    """Names in order and neighbours by number, without loops and parallels; an error beyond MOST_EDGES edges."""
    pairs = edges.select("pre", "post").where("pre is not null and post is not null").distinct().limit(MOST_EDGES + 1).collect()
    if len(pairs) > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} distinct edges: threshold or fold the network first")
    names = sorted({x for p in pairs for x in p})
    at, near = {n: k for k, n in enumerate(names)}, [set() for _ in names]
    for a, b in pairs:
        if a != b:
            near[at[a]].add(at[b])
            if not directed:
                near[at[b]].add(at[a])
    return names, [sorted(x) for x in near]


def _accumulate(near: list[list[int]], s: int) -> tuple[np.ndarray, dict]:
    """Brandes' dependencies of one source: on nodes, and on edges."""
    n = len(near)
    dist, sigma, order, preds = np.full(n, -1), np.zeros(n), [], [[] for _ in range(n)]
    dist[s], sigma[s], queue = 0, 1, deque([s])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in near[v]:
            if dist[w] < 0:
                dist[w] = dist[v] + 1
                queue.append(w)
            if dist[w] == dist[v] + 1:
                sigma[w] += sigma[v]
                preds[w].append(v)
    delta, on_edges = np.zeros(n), {}
    for w in reversed(order):
        for v in preds[w]:
            c = sigma[v] / sigma[w] * (1 + delta[w])
            delta[v] += c
            on_edges[v, w] = on_edges.get((v, w), 0.0) + c
    delta[s] = 0
    return delta, on_edges


def _over_sources(edges: DataFrame, directed: bool, value) -> tuple[list, DataFrame]:
    names, near = adjacency(edges, directed)
    spark = edges.sparkSession
    parts = min(max(1, len(names)), spark.sparkContext.defaultParallelism * 4)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield value(near, b["id"].tolist())

    return names, spark.range(len(names), numPartitions=parts).mapInPandas(run, "a bigint, b bigint, v double")


def _named(spark, names: list, value) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({"_i": range(len(names)), value: names}))


#: Cells (sources times nodes) of a task's searches, links of a level that it follows at once, links it aims at for a level, and links that it keeps for the way back.
CELLS, STEP, EVEN, KEPT = 1 << 21, 1 << 20, 1 << 13, 1 << 22


def _numbered(edges: DataFrame, directed: bool) -> tuple[DataFrame, DataFrame, int]:
    """(name, id) and (a, b) of the distinct links without loops, both written, and the number of nodes. Numbers follow hashes, from 0."""
    pairs = edges.select("pre", "post").where("pre is not null and post is not null")
    pairs = written(pairs if directed else pairs.unionByName(pairs.select(F.col("post").alias("pre"), F.col("pre").alias("post"))), "pairs")
    names = pairs.select(F.explode(F.array("pre", "post")).alias("name")).distinct().withColumn("_h", F.xxhash64("name"))
    ids = written(ranked(names, [F.col("_h"), F.col("name")], "_k").select("name", (F.col("_k") - 1).cast("int").alias("id")), "ids")
    x, y = (ids.select(F.col("name").alias(c), F.col("id").alias(i)) for c, i in (("pre", "a"), ("post", "b")))
    links = written(pairs.where("pre <> post").join(x, "pre").join(y, "post").select("a", "b").distinct(), "links", pairs)
    return ids, links, ids.count()


def _adjacent(links: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each node's neighbours begin, and these: 4 bytes a link, filled from one key of 8 bytes a link."""
    table = links.select((F.col("a").cast("bigint") * n + F.col("b")).alias("k")).toArrow()
    key = np.empty(table.num_rows, np.int64)
    lo = 0
    for part in table["k"].chunks:
        key[lo : lo + len(part)] = part.to_numpy()
        lo += len(part)
    del table
    key.sort()
    begin = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) * n)
    key %= max(n, 1)
    return begin, key.astype(np.int32)


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``lo`` on, ``size`` of them, one after the other."""
    out = np.repeat(lo - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def _pieces(size: np.ndarray) -> Iterator[slice]:
    """Slices of rows whose sizes sum to about STEP."""
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, side="right")))
        yield slice(lo, hi)
        lo = hi


def _reversed(begin: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of the links the other way."""
    n = len(begin) - 1
    key = near * np.int64(max(n, 1))
    key += np.repeat(np.arange(n, dtype=np.int32), np.diff(begin))
    key.sort()
    back = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) * n)
    key %= max(n, 1)
    return back, key.astype(np.int32)


class _Search:
    """Brandes' search from several sources at once, level by level. A cell is (place of the source, node). A level is found from the links that leave the one
    before, or, where fewer links come to the cells not reached yet, from those: most links of a dense network lead back to what is known, and are never
    followed. The way back takes the same links, as only they join two levels. ``width`` sources are taken at once: as many as make a level's arrays long enough to
    be worth their calls, and no more, so that the cells stay in the processor's cache."""

    def __init__(self, begin: np.ndarray, near: np.ndarray, back: tuple[np.ndarray, np.ndarray] | None = None):
        self.n = len(begin) - 1
        self.out, self.into = (begin, near, np.diff(begin)), ()
        begin, near = back or _reversed(begin, near)
        self.into = (begin, near, np.diff(begin))
        self.most = max(1, CELLS // max(1, self.n))
        self.width, cells = 1, self.most * self.n
        self.dist, self.last = np.full(cells, -1, np.int32), np.zeros(cells, np.int32)
        self.sigma, self.delta, self.some = np.zeros(cells), np.zeros(cells), np.zeros(cells)

    def _links(self, cells: np.ndarray, of: tuple, many: int) -> tuple[np.ndarray, Callable[[], Iterator[tuple]]]:
        """The cells that have links, and pieces (slice of these, their numbers of links, the cells at the other ends); kept for the way back while there are few."""
        begin, near, degree = of
        node = cells % self.n if many > 1 else cells
        size = degree[node]
        has = np.flatnonzero(size)
        if len(has) < len(size):
            cells, node, size = cells[has], node[has], size[has]

        def followed() -> Iterator[tuple]:
            for part in _pieces(size):
                ends = near[_ranges(begin[node[part]], size[part])]
                yield part, size[part], ends + np.repeat(cells[part] - node[part], size[part]) if many > 1 else ends.astype(np.int64)

        total = int(size.sum())
        self.followed += total
        if total > self.room:
            return cells, followed
        self.room -= total
        kept = list(followed())
        return cells, lambda: iter(kept)

    def _outward(self, level: np.ndarray, depth: int, many: int, total: int) -> tuple[np.ndarray, np.ndarray, Callable]:
        """The next level, from the links that leave this one."""
        n = many * self.n
        dist, sigma = self.dist[:n], self.sigma
        cells, followed = self._links(level, self.out, many)
        if 4 * total > n:
            paths = np.zeros(n)
            for part, size, go in followed():
                paths += np.bincount(go, weights=np.repeat(sigma[cells[part]], size), minlength=n)
            new = np.flatnonzero((paths > 0) & (dist < 0))
            sigma[new] = paths[new]
            dist[new] = depth
            return new, cells, followed
        found = []
        for part, size, go in followed():
            before = dist[go]
            on = np.flatnonzero((before < 0) | (before == depth))
            np.add.at(sigma, go[on], np.repeat(sigma[cells[part]], size)[on])
            fresh = go[before < 0]
            dist[fresh] = depth
            places = np.arange(len(fresh), dtype=np.int32)
            self.last[fresh] = places  # of a cell that comes several times one place stays
            found.append(fresh[self.last[fresh] == places])
        return np.concatenate(found) if found else level[:0], cells, followed

    def _inward(self, level: np.ndarray, depth: int, many: int) -> tuple[np.ndarray, np.ndarray, Callable]:
        """The next level, from the links that come to cells that weren't reached yet."""
        cells, followed = self._links(np.flatnonzero(self.dist[: many * self.n] < 0), self.into, many)
        self.some[level] = self.sigma[level]
        paths = np.zeros(len(cells))
        for part, size, come in followed():
            paths[part] = np.add.reduceat(self.some[come], np.cumsum(size) - size)
        self.some[level] = 0
        fresh = np.flatnonzero(paths)
        new = cells[fresh]
        self.sigma[new] = paths[fresh]
        self.dist[new] = depth
        return new, cells, followed

    def _reach(self, sources: np.ndarray, x: np.ndarray | None) -> list[np.ndarray]:
        """The cells of each level; leaves their dependencies in ``delta``, and 0 for the sources' own."""
        n, many = self.n, len(sources)
        self.room, self.followed = KEPT, 0
        start = np.arange(many, dtype=np.int64) * n + sources
        self.dist[start], self.sigma[start] = 0, 1
        levels, ways, left = [start], [], many * len(self.into[1])
        while len(level := levels[-1]):
            node = level % n if many > 1 else level
            total = int(self.out[2][node].sum())
            left -= int(self.into[2][node].sum())
            inward = left + many * n // 8 < total
            new, *way = self._inward(level, len(levels), many) if inward else self._outward(level, len(levels), many, total)
            levels.append(new)
            ways.append((inward, *way))
        # the last level is empty
        levels.pop()
        ways.pop()
        for level, new, (inward, cells, followed) in reversed(list(zip(levels[:-1], levels[1:], ways, strict=True))):
            own = 1.0 if x is None else np.maximum(0.0, x[sources[new // n]] - x[new % n])
            self.some[new] = (own + self.delta[new]) / self.sigma[new]
            if inward:
                got = np.zeros(many * n)
                for part, size, come in followed():
                    got += np.bincount(come, weights=np.repeat(self.some[cells[part]], size), minlength=many * n)
                self.delta[level] = self.sigma[level] * got[level]
            else:
                for part, size, go in followed():
                    self.delta[cells[part]] = self.sigma[cells[part]] * np.add.reduceat(self.some[go], np.cumsum(size) - size)
            self.some[new] = 0
        self.delta[start] = 0
        self.width = min(self.most, max(1, EVEN * len(levels) * many // max(1, self.followed)))
        return levels

    def _clear(self, levels: list[np.ndarray], many: int) -> None:
        every = slice(many * self.n) if 8 * sum(map(len, levels)) > many * self.n else np.concatenate(levels)
        self.dist[every], self.sigma[every], self.delta[every] = -1, 0, 0

    def run(self, sources: np.ndarray, x: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and their dependencies of these sources: each node comes once for each source, itself left out."""
        levels = self._reach(sources, x)
        seen = np.concatenate([levels[0][:0], *levels[1:]])
        found = self.delta[seen]
        self._clear(levels, len(sources))
        return seen % self.n, found

    def add(self, total: np.ndarray, sources: np.ndarray, x: np.ndarray | None) -> None:
        """Adds to ``total`` each node's dependencies of all these sources."""
        lo = 0
        while lo < len(sources):
            some = sources[lo : lo + self.width]
            lo += len(some)
            levels = self._reach(some, x)
            if 8 * sum(map(len, levels)) > len(some) * self.n:
                for k in range(len(some)):
                    total += self.delta[k * self.n : (k + 1) * self.n]
            else:
                seen = np.concatenate(levels)
                np.add.at(total, seen % self.n, self.delta[seen])
            self._clear(levels, len(some))


def _dependencies(edges: DataFrame, directed: bool, state: Callable[[str], float] | None = None) -> tuple[DataFrame, int, DataFrame]:
    """(name, id), the number of nodes, and (id, v) of the nodes that lie between others: sums of Brandes' dependencies over all sources, of which those without
    an own link need no search. With ``state`` a pair counts by how much its source is above its target, and a node's sum is divided by that of the pairs it isn't
    in; sources of the least state count for none.

    The driver and each task hold 8 bytes a link, 4 for each of its ends, and some dozen bytes a node; there is no bound on links.
    """
    spark = edges.sparkSession
    ids, links, n = _numbered(edges, directed)
    begin, near = _adjacent(links, n)
    x = rest = None
    if state is not None:

        def stated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"id": b["id"], "x": [state(name) for name in b["name"]]})

        known = ids.mapInPandas(stated, "id int, x double").toArrow()
        x = np.empty(n)
        x[known["id"].to_numpy()] = known["x"].to_numpy()
        order = np.sort(x)
        # sum over pairs of max(0, x_s - x_t), and that without the pairs that the node is in
        total, before = float((order * (2 * np.arange(n) - n + 1)).sum()), np.concatenate([[0.0], np.cumsum(order)])
        below = np.searchsorted(order, x)
        rest = total - (x * (2 * below - n) + before[-1] - 2 * before[below])
    shared = spark.sparkContext.broadcast((begin, near, _reversed(begin, near), x, rest))
    parts = min(max(1, n), spark.sparkContext.defaultParallelism * 4)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin, near, back, x, rest = shared.value
        search, total = _Search(begin, near, back), np.zeros(n)
        for b in batches:
            sources = b["id"].to_numpy()
            sources = sources[begin[sources + 1] > begin[sources]]
            search.add(total, sources if x is None else sources[x[sources] > x.min()], x)
        some = np.flatnonzero(total if rest is None else (total != 0) & (rest > 0))
        yield pd.DataFrame({"id": some.astype(np.int32), "v": total[some] if rest is None else total[some] / rest[some]})

    found = spark.range(n, numPartitions=parts).mapInPandas(run, "id int, v double")
    return ids, n, found.groupBy("id").agg(F.sum("v").alias("v"))


def betweenness(edges: DataFrame, directed: bool = True, normalized: bool = True) -> DataFrame:
    """(name, betweenness): shares of shortest paths, ends excluded."""
    ids, n, summed = _dependencies(edges, directed)
    scale = 1 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0 if directed else 0.5
    return ids.join(summed, "id", "left").select("name", (F.coalesce("v", F.lit(0.0)) * scale).alias("betweenness"))


def edge_betweenness(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(pre, post, betweenness), not normalized; of undirected networks each edge once, its smaller end first."""

    def value(near, sources):
        total: dict = {}
        for s in sources:
            for e, c in _accumulate(near, s)[1].items():
                total[e] = total.get(e, 0.0) + c
        return pd.DataFrame([(*e, c) for e, c in total.items()], columns=["a", "b", "v"])

    names, parts = _over_sources(edges, directed, value)
    if not directed:
        parts = parts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("v") / 2).alias("v"))
    spark = edges.sparkSession
    a, b = _named(spark, names, "pre").withColumnRenamed("_i", "_p"), _named(spark, names, "post").withColumnRenamed("_i", "_q")
    return parts.groupBy("a", "b").agg(F.sum("v").alias("betweenness")).join(a, F.col("a") == F.col("_p")).join(b, F.col("b") == F.col("_q")).select("pre", "post", "betweenness")


def percolation(edges: DataFrame, states: dict | Callable[[str], float] | None = None) -> DataFrame:
    """(name, percolation): betweenness weighted by how much more percolated the source is than the target; all states 1 by default (then all are 0).
    ``states`` gives a name's state, as a function or a dict."""
    ids, n, summed = _dependencies(edges, True, lambda name: float(states(name) if callable(states) else (states or {}).get(name, 1.0)))
    return ids.join(summed, "id", "left").select("name", (F.coalesce("v", F.lit(0.0)) / max(1, n - 2)).alias("percolation"))


def edge_connectivity(edges: DataFrame) -> int:
    """Fewest edges whose loss leaves some node unreachable from another (directed); unit flows from one node to each other and back."""
    names, near = adjacency(edges)
    return _least_cut(len(names), near)


def _least_cut(n: int, near: list[list[int]]) -> int:
    if n < 2:
        return 0
    best = min(len(x) for x in near)
    for k in range(n):
        best = min(best, _unit_flow(near, k, (k + 1) % n, best))
        if not best:
            break
    return best


def _unit_flow(near: list[list[int]], s: int, t: int, bound: int) -> int:
    """Edge-disjoint paths from s to t, up to ``bound``."""
    residual = [dict.fromkeys(x, 1) for x in near]
    for v, ws in enumerate(near):
        for w in ws:
            residual[w].setdefault(v, 0)
    found = 0
    while found < bound:
        back, queue = {s: None}, deque([s])
        while queue and t not in back:
            v = queue.popleft()
            for w, c in residual[v].items():
                if c and w not in back:
                    back[w] = v
                    queue.append(w)
        if t not in back:
            return found
        w = t
        while (v := back[w]) is not None:
            residual[v][w] -= 1
            residual[w][v] += 1
            w = v
        found += 1
    return found


def girvan_newman(edges: DataFrame, parts: int = 2) -> DataFrame:
    """(name, community): the edge of most betweenness goes, again and again, until the undirected network falls into ``parts`` components. Ties go by name."""
    now = edges.select(F.least("pre", "post").alias("pre"), F.greatest("pre", "post").alias("post")).where("pre <> post").distinct()
    names, near = adjacency(now, False)
    near_sets = [set(x) for x in near]

    def split() -> list[int]:
        label, c = [-1] * len(names), 0
        for s in range(len(names)):
            if label[s] < 0:
                label[s], queue = c, deque([s])
                while queue:
                    for w in near_sets[queue.popleft()]:
                        if label[w] < 0:
                            label[w] = c
                            queue.append(w)
                c += 1
        return label

    spark, label = edges.sparkSession, split()
    while max(label, default=-1) + 1 < min(parts, len(names)):
        left = [(names[v], names[w]) for v in range(len(names)) for w in near_sets[v] if v < w]
        ranked = edge_betweenness(spark.createDataFrame(left, now.schema)).orderBy(F.round("betweenness", 9).desc(), "pre", "post").first()
        a, b = names.index(ranked.pre), names.index(ranked.post)
        near_sets[a].discard(b)
        near_sets[b].discard(a)
        label = split()
    return spark.createDataFrame(pd.DataFrame({"name": names, "community": label})) if names else spark.createDataFrame([], "name string, community bigint")


def partition_energy(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(within, between, energy): edges inside and across communities (name, community), and their difference."""
    a, b = (communities.select(F.col("name").alias(s), F.col("community").alias(f"{s}_c")) for s in ("pre", "post"))
    same = F.col("pre_c") == F.col("post_c")
    counted = edges.join(a, "pre").join(b, "post").agg(F.count_if(same).alias("within"), F.count_if(~same).alias("between"))
    return counted.withColumn("energy", F.col("within") - F.col("between"))


def cut_and_volume(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, cut, volume): edges that leave it, and out-degrees of its nodes."""
    a, b = (communities.select(F.col("name").alias(s), F.col("community").alias(f"{s}_c")) for s in ("pre", "post"))
    rows = edges.join(a, "pre").join(b, "post")
    return rows.groupBy(F.col("pre_c").alias("community")).agg(F.count_if(F.col("pre_c") != F.col("post_c")).alias("cut"), F.count("*").alias("volume"))


def is_partition(nodes: DataFrame, communities: DataFrame) -> bool:
    """Whether every node has exactly one community."""
    counted = nodes.select("name").join(communities.groupBy("name").agg(F.count("*").alias("k")), "name", "full_outer")
    return not counted.where("k is null or k <> 1").limit(1).count() and not communities.join(nodes, "name", "left_anti").limit(1).count()


def constraint(edges: DataFrame) -> DataFrame:
    """(name, constraint), Burt's: sum over neighbours j of (p_ij + sum_q p_iq p_qj)^2, p the shares of mutual weights. Two hops, as joins."""
    w = edges.where("pre <> post").groupBy("pre", "post").agg(F.sum("weight").alias("w"))
    mutual = w.unionByName(w.select(F.col("post").alias("pre"), F.col("pre").alias("post"), "w")).groupBy("pre", "post").agg(F.sum("w").alias("w"))
    total = mutual.groupBy("pre").agg(F.sum("w").alias("t"))
    p = mutual.join(total, "pre").select("pre", "post", (F.col("w") / F.col("t")).alias("p"))
    first, second = p.select(F.col("pre").alias("i"), F.col("post").alias("q"), F.col("p").alias("p1")), p.select(F.col("pre").alias("q"), F.col("post").alias("j"), F.col("p").alias("p2"))
    indirect = first.join(second, "q").where("i <> j").groupBy("i", "j").agg(F.sum(F.col("p1") * F.col("p2")).alias("via"))
    local = p.join(indirect, (F.col("pre") == F.col("i")) & (F.col("post") == F.col("j")), "left")
    return local.groupBy(F.col("pre").alias("name")).agg(F.sum(F.pow(F.col("p") + F.coalesce("via", F.lit(0.0)), 2)).alias("constraint"))


def measured_inputs(edges: DataFrame, measured: DataFrame) -> DataFrame:
    """(name, fraction, weighted_fraction) of a node's inputs that come from measured nodes."""
    m = measured.select(F.col("name").alias("pre"), F.lit(1).alias("m")).distinct()
    seen, w = edges.join(m, "pre", "left"), F.col("weight")
    return seen.groupBy(F.col("post").alias("name")).agg((F.count("m") / F.count("*")).alias("fraction"), F.coalesce(F.try_divide(F.sum(F.when(F.col("m") == 1, w).otherwise(0.0)), F.sum(w)), F.lit(0.0)).alias("weighted_fraction"))


def linear_fit(rows: DataFrame, y: str, x: str, *by: str) -> DataFrame:
    """Least squares of y on x by group: slope, intercept, r, r2; nulls where x or y doesn't vary."""
    ok = F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.lit(True))
    cov, vx, vy = F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)
    slope, r = F.try_divide(cov, vx), F.try_divide(cov, F.sqrt(vx * vy))
    return rows.groupBy(*by).agg(F.when(ok, slope).alias("slope"), F.when(ok, F.avg(y) - slope * F.avg(x)).alias("intercept"), F.when(ok, r).alias("r"), F.when(ok, r * r).alias("r2"))
