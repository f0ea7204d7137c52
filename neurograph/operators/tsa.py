"""Time series against time series: correlations, lags, embeddings, tensors. Series are (series, t, value), and may have a ``recording``: then only series of one
recording are compared."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurograph.functions import kernels


def pearson(x: str, y: str) -> Column:
    """Correlation; null if one of the two doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def correlations(series: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """(a, b, r) over start <= t < end, of every two series of a recording over the times that both have; null if one of the two doesn't vary there.

    A series is one array row; pairs of series with the same times are products of matrices of ``BLOCK`` series, and only others are joined sample by sample.
    """
    some = series.where(F.col("t") >= start) if end is None else series.where((F.col("t") >= start) & (F.col("t") < end))
    on = ["recording"] if "recording" in series.columns else []
    rows = some.groupBy(*on, "series").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("s"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)
    values, times = F.transform("s", lambda e: e["value"]), F.transform("s", lambda e: e["t"])
    rows = rows.select(*on, "series", values.alias("v"), times.alias("times"))
    rows = rows.withColumn("m", total(F.col("v")) / F.size("v"))
    # centred values, and their energy, once a series
    rows = rows.select(*on, "series", "times", F.transform("v", lambda x: x - F.col("m")).alias("v")).withColumn("e", total(F.transform("v", lambda x: x * x)))
    whole = _products(rows, on)
    # series of different times: only pairs of two kinds of times that a recording has
    kinds = rows.select(*on, "times").distinct()
    two = kinds.withColumnRenamed("times", "a_times").join(kinds.withColumnRenamed("times", "b_times"), on) if on else kinds.select(F.col("times").alias("a_times")).crossJoin(kinds.select(F.col("times").alias("b_times")))
    a, b = (rows.select(*on, F.col("series").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("times", "v")]) for n in "ab")
    met = two.where("a_times <> b_times").join(a, [*on, "a_times"]).join(b, [*on, "b_times"]).where("a < b")
    x, y = (F.map_from_arrays(f"{n}_times", f"{n}_v") for n in "ab")
    rest = met.select("a", "b", y.alias("y"), F.explode(x).alias("t", "x")).select("a", "b", "x", F.try_element_at("y", "t").alias("y")).where("y is not null")
    return whole.unionByName(rest.groupBy("a", "b").agg(pearson("x", "y").alias("r")))


#: Series of a block: two blocks are multiplied at once.
BLOCK = 1024


def _products(rows: DataFrame, on: list[str]) -> DataFrame:
    """(a, b, r) of rows (recording, series, times, v, e) with the same times: series are dealt into blocks, and each two blocks make one product of matrices."""
    deal = [*on, "times"]
    rows = rows.where("series is not null")
    many = rows.groupBy(*deal).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_of"))
    block = F.pmod(F.xxhash64("series"), F.col("_of")).cast("int")
    rows = rows.join(many, deal).withColumn("_b", block).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    rows = rows.select(*deal, F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", "series", "v", "e")
    kind = rows.schema["series"].dataType.simpleString()

    def product(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("series")
        of, ids, e = table["_b"].to_numpy(), table["series"].combine_chunks(), table["e"].to_numpy()
        # of centred values some are null only where all are, and so is the energy
        v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(e), -1)
        known = table["e"].is_valid().to_numpy()
        left = np.flatnonzero(of == of.min())
        right = np.flatnonzero(of == of.max())
        with np.errstate(all="ignore"):
            scale = np.sqrt(e[left][:, None] * e[right][None, :])
            r = v[left] @ v[right].T / scale
        null = (scale == 0) | ~(known[left][:, None] & known[right][None, :])
        x, y = np.broadcast_to(left[:, None], r.shape), np.broadcast_to(right[None, :], r.shape)
        if of.min() == of.max():
            own = x < y
            x, y, r, null = x[own], y[own], r[own], null[own]
        x, y, r, null = x.ravel(), y.ravel(), r.ravel(), null.ravel()
        return pa.table({"a": ids.take(pa.array(np.minimum(x, y))), "b": ids.take(pa.array(np.maximum(x, y))), "r": pa.array(r, mask=null)})

    # groups of two blocks of which one alone has rows there would make its own pairs again
    def pairs(table: pa.Table) -> pa.Table:
        i, j, b = table["_i"][0].as_py(), table["_j"][0].as_py(), table["_b"].to_numpy()
        if i != j and (b == b[0]).all():
            return pa.table({"a": table["series"].slice(0, 0), "b": table["series"].slice(0, 0), "r": pa.array([], pa.float64())})
        return product(table)

    return rows.groupBy(*deal, "_i", "_j").applyInArrow(pairs, f"a {kind}, b {kind}, r double")


def window_correlations(series: DataFrame, starts: DataFrame) -> DataFrame:
    """(size, mean_r): the mean over windows (size, start) and pairs of the correlation inside the window, of series with a sample at each t from 0.

    Inside a window a correlation is the product of two series of mean 0 and length 1, and the products of all pairs sum to half of (the square of the series'
    sum, less the sum of their squares). So each series is read once, and pairs are never rows. Pairs are of a recording and of the same length.
    """
    on = ["recording"] if "recording" in series.columns else []
    rows = _arrays(series).where(" and ".join(f"{c} is not null" for c in [*on, "series"]))
    rows = rows.select(*on, "v", F.size("v").alias("len"), F.array_position(F.transform("v", lambda x: x.isNull()), True).alias("gap"))
    kinds = rows.select(*on, "len").distinct()
    keyed = kinds.crossJoin(F.broadcast(starts.select("size", "start").distinct())).where("start + size <= len")
    # windows are few (sizes times draws): one list of those that fit for each kind of series
    lists = keyed.groupBy(*on, "len").agg(F.array_sort(F.collect_list(F.struct("size", "start"))).alias("w"))
    size = keyed.schema["size"].dataType.simpleString()
    width = f"{rows.schema['recording'].dataType.simpleString()}" if on else None

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, g in b.groupby([*on, "len"], sort=False):
                wins, gap = g["w"].iloc[0], g["gap"].to_numpy()
                v = np.stack([np.asarray(x, float) for x in g["v"]])
                zero = np.zeros((len(v), 1))
                s, q = np.hstack([zero, np.cumsum(v, axis=1)]), np.hstack([zero, np.cumsum(v * v, axis=1)])
                for w in wins:
                    n, lo = w["size"], w["start"]
                    hi = lo + n
                    sx = s[:, hi] - s[:, lo]
                    xx = q[:, hi] - q[:, lo] - sx * sx / n
                    # a running sum has no value from a missing sample on
                    ok = ~(xx <= 1e-12) & ((gap == 0) | (gap > hi))
                    z = (v[ok, lo:hi] - (sx[ok] / n)[:, None]) / np.sqrt(xx[ok])[:, None]
                    out.append((*key[:-1], key[-1], n, lo, len(v), int(ok.sum()), z.sum(axis=0).tolist(), float((z * z).sum())))
            yield pd.DataFrame(out, columns=[*on, "len", "size", "start", "m", "k", "z", "e"])

    parts = rows.join(lists, [*on, "len"]).mapInPandas(summed, ", ".join([*([f"recording {width}"] if on else []), f"len int, size {size}, start int, m bigint, k bigint, z array<double>, e double"]))
    group = [*on, "len", "size", "start"]
    each = parts.select(*group, "m", "k", "e", F.posexplode("z").alias("p", "s")).groupBy(*group, "p").agg(F.sum("m").alias("m"), F.sum("k").alias("k"), F.sum("e").alias("e"), F.sum("s").alias("s"))
    whole = each.groupBy(*group).agg(F.first("m").alias("m"), F.first("k").alias("k"), ((F.sum(F.col("s") * F.col("s")) - F.first("e")) / 2).alias("r")).where("m > 1")
    return whole.groupBy("size").agg(F.try_divide(F.sum(F.when(F.col("k") > 1, F.col("r"))), F.sum(F.col("k") * (F.col("k") - 1) / 2)).alias("mean_r"))


def _arrays(series: DataFrame) -> DataFrame:
    """(recording, series, v, t0): each series as one row, its values in order of t and its first t."""
    on = ["recording"] if "recording" in series.columns else []
    rows = series.groupBy(*on, "series").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("s"))
    return rows.select(*on, "series", F.transform("s", lambda e: e["value"]).alias("v"), F.element_at("s", 1)["t"].alias("t0"))


def starts(length: int, sizes: Iterable[int], draws: int, seed: int) -> list[tuple[int, int]]:
    """(size, start) of ``draws`` random windows of each size inside ``length`` samples, repeated ones once."""
    rng = np.random.default_rng(seed)
    return sorted({(size, int(x)) for size in sizes for x in rng.integers(0, length - size + 1, draws)})


def connected_share(pairs: DataFrame, edges: DataFrame | Column, thresholds: list[float]) -> DataFrame:
    """(threshold, n_pairs, n_connected, fraction): of pairs with abs(r) above a threshold, those with an edge either way. ``edges`` is a table (pre, post), or a
    condition on a and b where a rule tells which pairs have one: then pairs are joined with nothing."""
    lim = F.explode(F.lit([float(x) for x in thresholds])).alias("threshold")
    if isinstance(edges, Column):
        known = pairs.withColumn("e", F.when(edges, 1))
    else:
        e = edges.select(F.least("pre", "post").alias("a"), F.greatest("pre", "post").alias("b")).distinct().withColumn("e", F.lit(1))
        known = pairs.join(e, ["a", "b"], "left")
    hit = known.select("*", lim).where(F.abs("r") > F.col("threshold"))
    return hit.groupBy("threshold").agg(F.count("*").alias("n_pairs"), F.count("e").alias("n_connected")).withColumn("fraction", F.col("n_connected") / F.col("n_pairs"))


def moving_average(series: DataFrame, size: int, step: int = 1) -> DataFrame:
    """Means of whole windows only, every ``step`` samples: (series, t, value), t the window's start."""
    w = Window.partitionBy("series").orderBy("t").rowsBetween(0, size - 1)
    s = series.withColumn("_m", F.avg("value").over(w)).withColumn("_n", F.count("*").over(w))
    return s.where((F.col("_n") == size) & (F.col("t") % step == 0)).select("series", "t", F.col("_m").alias("value"))


def zero_crossings(series: DataFrame, half: int, seconds: float) -> DataFrame:
    """(series, t, rate): sign changes within samples t - half to t + half - 1, for each second of the 2 * half samples."""
    w = Window.partitionBy("series").orderBy("t")
    s = series.withColumn("_c", (F.signum("value") != F.lag(F.signum("value")).over(w)).cast("int"))
    # a change between two samples counts if both are in the frame, so the frame's first sample's own change doesn't
    return s.withColumn("rate", F.coalesce(F.sum("_c").over(w.rowsBetween(-half + 1, half - 1)), F.lit(0)) / F.lit(2 * half * seconds)).select("series", "t", "rate")


def acceleration(series: DataFrame, dt: float, size: int = 5) -> DataFrame:
    """(series, t, value): differences by dt, the first one as the second, then a moving average with zeros beyond the ends."""
    w = Window.partitionBy("series").orderBy("t")
    d = (F.col("value") - F.lag("value").over(w)) / dt
    s = series.withColumn("_d", d)
    s = s.withColumn("_d", F.coalesce("_d", F.lead("_d").over(w)))
    return s.select("series", "t", (F.sum("_d").over(w.rowsBetween(-(size // 2), (size - 1) // 2)) / size).alias("value"))


def cross_correlation(series: DataFrame, pairs: DataFrame, most: int = 50) -> DataFrame:
    """(a, b, lag, c): sum x(t) y(t + lag) by the root of both energies in the overlap, 0 without energy; ``pairs`` is (a, b). Series have a sample at each t.

    A series is one array, so a pair is one row: its lags are products of slices of the two arrays, and no sample is joined or shuffled by lag.
    """
    one = _arrays(series)
    a, b = one.select(F.col("series").alias("a"), F.col("v").alias("x"), F.col("t0").alias("ta")), one.select(F.col("series").alias("b"), F.col("v").alias("y"), F.col("t0").alias("tb"))
    lagged = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y", "ta", "tb", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"))
    # x[i] meets y[i + shift]
    lagged = lagged.withColumn("shift", (F.col("lag") + F.col("ta") - F.col("tb")).cast("int"))
    lo, hi = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("x"), F.size("y") - F.col("shift"))
    cut = lagged.where(hi > lo).select("a", "b", "lag", F.slice("x", lo + 1, hi - lo).alias("x"), F.slice("y", lo + F.col("shift") + 1, hi - lo).alias("y"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    energy = F.sqrt(total(F.transform("x", lambda v: v * v)) * total(F.transform("y", lambda v: v * v)))
    dot = total(F.zip_with("x", "y", lambda v, w: v * w))
    return cut.select("a", "b", "lag", F.coalesce(F.try_divide(dot, F.nullif(energy, F.lit(0.0))), F.lit(0.0)).alias("c"))


def best_lag(c: DataFrame) -> DataFrame:
    """(a, b, lag, c) of the largest absolute value, the earliest of equal ones."""
    top = F.min_by(F.struct("lag", "c"), F.struct(-F.abs(F.round("c", 12)), F.col("lag")))
    return c.groupBy("a", "b").agg(top.alias("_t")).select("a", "b", "_t.lag", "_t.c")


def hankel(series: DataFrame, k: int) -> DataFrame:
    """(series, row, col, value): delay embedding, value at row + col, of whole windows of k samples. By exploding each sample to its windows; no join."""
    n = F.max("t").over(Window.partitionBy("series"))
    rows = series.withColumn("_last", n - (k - 1)).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("row", F.col("t") - F.col("col"))
    return rows.where("row >= 0 and row <= _last").select("series", "row", "col", "value")


def recompose(embedded: DataFrame) -> DataFrame:
    """(series, t, value): the mean over the windows that cover each sample."""
    return embedded.groupBy("series", (F.col("row") + F.col("col")).alias("t")).agg(F.avg("value").alias("value"))


def cumulative_histogram(values: DataFrame, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n, cdf) of ``value`` in equal bins; the last includes ``hi``."""
    b = F.least(F.floor((F.col("value") - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
    counted = values.where(F.col("value").between(lo, hi)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # over ``bins`` rows
    return counted.withColumn("cdf", run / F.sum("n").over(Window.partitionBy()))


def coverage(labels: DataFrame, least: int) -> DataFrame:
    """(label, n) seen in at least that many recordings."""
    return labels.groupBy("label").agg(F.countDistinct("recording").alias("n")).where(F.col("n") >= least)


def impute(cells: DataFrame, shape: tuple[int, int, int], rank: int = 20, rounds: int = 100, seed: int = 0) -> DataFrame:
    """(block, i, j, k, value): each block's tensor of (block, i, j, k, value), cells that are missing filled by a CP decomposition. One block's cells must fit a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.full(shape, np.nan)
        x[pdf["i"], pdf["j"], pdf["k"]] = pdf["value"]
        _, made = kernels.parafac(x, rank, rounds, seed)
        i, j, k = np.indices(shape).reshape(3, -1)
        return pd.DataFrame({"block": pdf["block"].iloc[0], "i": i, "j": j, "k": k, "value": np.where(np.isfinite(x), x, made).ravel()})

    return cells.groupBy("block").applyInPandas(run, f"block {dict(cells.dtypes)['block']}, i int, j int, k int, value double")
