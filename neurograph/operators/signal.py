"""Recorded signals in long form: samples (neuron, trial, t, value), t counted from 0 at F_SAMPLE samples a second.

Windows and aggregates partition by (neuron, trial), so that one shuffle serves all of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurograph.functions import kernels
from neurograph.model import F_SAMPLE

KEYS = ("neuron", "trial")


def over(keys: tuple[str, ...] = KEYS) -> Window:
    return Window.partitionBy(*keys)


def recording(samples: DataFrame, discard: float = 0) -> DataFrame:
    """Without the first ``discard`` seconds; t counts from 0 again. Trials that would be empty are an error."""
    if discard < 0:
        raise ValueError("discard must not be negative")
    d = int(discard * F_SAMPLE)
    n = F.count("*").over(over())
    checked = samples.withColumn("_n", F.when(n > d, n).otherwise(F.raise_error(F.lit("discard is longer than the recording")).cast("bigint")))
    return checked.where((F.col("_n") > 0) & (F.col("t") >= d)).drop("_n").withColumn("t", F.row_number().over(over().orderBy("t")) - 1)


def durations(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*KEYS).agg((F.count("*") / float(F_SAMPLE)).alias("duration"))


def timestamps(samples: DataFrame) -> DataFrame:
    return samples.withColumn("seconds", F.col("t") / float(F_SAMPLE))


def moving_average(samples: DataFrame, size: int = 5, out: str = "value") -> DataFrame:
    """Mean of ``size`` samples around each, those beyond the ends counting 0."""
    w = over().orderBy("t").rowsBetween(-(size // 2), (size - 1) // 2)
    return samples.withColumn(out, F.sum("value").over(w) / size)


def median_filter(samples: DataFrame, size: int = 5, out: str = "value") -> DataFrame:
    """Median of ``size`` (odd) samples around each, those beyond the ends counting 0."""
    if size % 2 == 0:
        raise ValueError("the size must be odd")
    frame = F.collect_list("value").over(over().orderBy("t").rowsBetween(-(size // 2), size // 2))
    padded = F.concat(frame, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(frame)))
    return samples.withColumn(out, F.get(F.sort_array(padded), F.lit(size // 2)))


def gaussian_smooth(samples: DataFrame, sigma: float, out: str = "value") -> DataFrame:
    """Weighted sum over a kernel of fixed width; ends are reflected. The kernel is a literal array, the series' ends are read from two windows."""
    weights = [float(x) for x in kernels.gaussian_kernel(sigma)]
    r = len(weights) // 2
    w = over().orderBy("t")
    n = F.count("*").over(over())
    frame = F.collect_list("value").over(w.rowsBetween(-2 * r - 1, 2 * r + 1))
    first = F.greatest(F.col("t") - (2 * r + 1), F.lit(0))

    def at(k: Column) -> Column:
        """The sample at k, mirrored at the ends as often as needed."""
        m = F.pmod(k, 2 * F.col("_n"))
        return F.get(F.col("_f"), (F.when(m < F.col("_n"), m).otherwise(2 * F.col("_n") - 1 - m) - F.col("_o")).cast("int"))

    parts = F.aggregate(F.zip_with(F.sequence(F.lit(-r), F.lit(r)), F.lit(weights), lambda k, c: at(F.col("t") + k) * c), F.lit(0.0), lambda a, x: a + x)
    return samples.withColumn("_n", n).withColumn("_f", frame).withColumn("_o", first).withColumn(out, parts).drop("_n", "_f", "_o")


def normalize(samples: DataFrame, method: str = "minmax", baseline: tuple[int, int] | None = None, out: str = "value") -> DataFrame:
    """minmax, zscore (population deviation), or baseline: relative to the mean of samples start <= t < end. Null where the scale is 0."""
    v, w = F.col("value"), over()
    if method == "minmax":
        lo = F.min("value").over(w)
        return samples.withColumn(out, F.try_divide(v - lo, F.max("value").over(w) - lo))
    if method == "zscore":
        return samples.withColumn(out, F.try_divide(v - F.avg("value").over(w), F.stddev_pop("value").over(w)))
    if method == "baseline":
        if baseline is None:
            raise ValueError("a baseline window is needed")
        b = F.avg(F.when((F.col("t") >= baseline[0]) & (F.col("t") < baseline[1]), v)).over(w)
        return samples.withColumn(out, F.try_divide(v - b, b))
    raise ValueError(f"unknown method {method!r}")


def statistics(samples: DataFrame) -> DataFrame:
    """mean, std (population), median, min, max, skewness and excess kurtosis (population forms), rms of each trial."""
    v = F.col("value")
    return samples.groupBy(*KEYS).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), F.sqrt(F.avg(v * v)).alias("rms"),
    )


def segments(samples: DataFrame, threshold: float, min_duration: int = 10) -> DataFrame:
    """(neuron, trial, start, end): runs above the threshold, end exclusive, at least ``min_duration`` long.

    A trial that never rises through the threshold, or never falls through it, has none.
    """
    w = over().orderBy("t")
    up = F.coalesce(F.col("value") > threshold, F.lit(False)).cast("int")
    marked = samples.withColumn("_up", up).withColumn("_before", F.lag("_up").over(w))
    change = (F.coalesce(F.col("_before"), F.lit(-1)) != F.col("_up")).cast("int")
    islands = marked.withColumn("_c", change).withColumn("_island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy(*KEYS, "_island").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end"), F.max("_up").alias("_up"), F.max(F.when((F.col("_before") == 0) & (F.col("_up") == 1), 1)).alias("_rise"), F.max(F.when((F.col("_before") == 1) & (F.col("_up") == 0), 1)).alias("_fall"))
    both = runs.withColumn("_r", F.max("_rise").over(over())).withColumn("_f", F.max("_fall").over(over()))
    return both.where("_up = 1 and _r = 1 and _f = 1").where(F.col("end") - F.col("start") >= min_duration).select(*KEYS, "start", "end")


def peaks(samples: DataFrame, height: float | None = None) -> DataFrame:
    """(neuron, trial, t, value) of strict local maxima; of a plateau its middle. By runs of equal values."""
    w = over().orderBy("t")
    first = (F.lag("value").over(w).isNull() | (F.lag("value").over(w) != F.col("value"))).cast("int")
    runs = samples.withColumn("_new", first).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*KEYS, "_run").agg(F.min("t").alias("_a"), F.max("t").alias("_b"), F.first("value").alias("value"))
    r = over().orderBy("_run")
    top = runs.withColumn("_l", F.lag("value").over(r)).withColumn("_n", F.lead("value").over(r)).where("_l < value and _n < value")
    out = top.select(*KEYS, F.expr("(_a + _b) div 2").alias("t"), "value")
    return out if height is None else out.where(F.col("value") >= height)


def snr(samples: DataFrame, signal: Column, noise: Column) -> DataFrame:
    """10 log10 of the ratio of mean squares where ``signal`` and where ``noise`` holds; infinite without noise."""
    p = {n: F.avg(F.when(c, F.col("value") * F.col("value"))) for n, c in (("_s", signal), ("_n", noise))}
    ratio = F.when(F.col("_n") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.col("_s") / F.nullif("_n", F.lit(0.0))))
    return samples.groupBy(*KEYS).agg(*[c.alias(n) for n, c in p.items()]).select(*KEYS, ratio.alias("snr"))


def validity(samples: DataFrame) -> DataFrame:
    """(neuron, trial, valid): samples, and all of them finite."""
    v = F.col("value")
    return samples.groupBy(*KEYS).agg(F.bool_and(F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))).alias("valid"))


def quality(samples: DataFrame) -> DataFrame:
    """noise (deviation of the first tenth), artifacts (samples beyond 3 deviations), stability (1 - std / mean of ten parts' means)."""
    w = over()
    s = samples.withColumn("_n", F.count("*").over(w)).withColumn("_m", F.avg("value").over(w)).withColumn("_s", F.stddev_pop("value").over(w)).withColumn("_part", F.ntile(10).over(w.orderBy("t")))
    tenth = F.col("t") < F.expr("_n div 10")
    v = F.col("value")
    parts = s.groupBy(*KEYS, "_part").agg(F.avg("value").alias("_pm"), F.count_if(F.abs(v - F.col("_m")) > 3 * F.col("_s")).alias("_a"), F.sum(F.when(tenth, v)).alias("_x"), F.sum(F.when(tenth, v * v)).alias("_xx"), F.count_if(tenth).alias("_k"))
    mean = F.try_divide(F.sum("_x"), F.sum("_k"))
    noise = F.sqrt(F.greatest(F.try_divide(F.sum("_xx"), F.sum("_k")) - mean * mean, F.lit(0.0)))
    return parts.groupBy(*KEYS).agg(noise.alias("noise"), F.sum("_a").alias("artifacts"), (1 - F.try_divide(F.stddev_pop("_pm"), F.avg("_pm"))).alias("stability"))


def per_trial(samples: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(neuron, trial, t, value): a numpy kernel over each trial's values in order of t."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y = np.asarray(f(pdf["value"].to_numpy(float)), float)
        return pd.DataFrame({"neuron": pdf["neuron"].iloc[0], "trial": pdf["trial"].iloc[0], "t": np.arange(len(y)), "value": y})

    kinds = dict(samples.dtypes)
    return samples.groupBy(*KEYS).applyInPandas(run, f"neuron {kinds['neuron']}, trial {kinds['trial']}, t bigint, value double")


def butterworth(samples: DataFrame, kind: str = "low", cutoff: float | tuple[float, float] = 2.0, order: int = 4) -> DataFrame:
    """Zero-phase Butterworth filter; ValueError for a cutoff that isn't below half the sample rate."""
    b, a = kernels.butter(order, cutoff, kind, F_SAMPLE)
    return per_trial(samples, lambda x: kernels.filtfilt(b, a, x) if len(x) > 3 * max(len(a), len(b)) else np.full(len(x), np.nan))


def wavelet_denoise(samples: DataFrame, wavelet: str = "db4") -> DataFrame:
    return per_trial(samples, lambda x: kernels.wavelet_denoise(x, wavelet))


def spaced_peaks(samples: DataFrame, distance: float, height: float | None = None) -> DataFrame:
    """Peaks of which the lower within ``distance`` samples of a higher one go."""
    if distance < 1:
        raise ValueError("distance must be at least 1")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["value"].to_numpy(float)
        at = kernels.find_peaks(x, height, distance)
        return pd.DataFrame({"neuron": pdf["neuron"].iloc[0], "trial": pdf["trial"].iloc[0], "t": at, "value": x[at]})

    kinds = dict(samples.dtypes)
    return samples.groupBy(*KEYS).applyInPandas(run, f"neuron {kinds['neuron']}, trial {kinds['trial']}, t bigint, value double")


def power_spectrum(samples: DataFrame) -> DataFrame:
    """(neuron, trial, frequency, power)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f, p = kernels.welch(pdf.sort_values("t")["value"].to_numpy(float), F_SAMPLE)
        return pd.DataFrame({"neuron": pdf["neuron"].iloc[0], "trial": pdf["trial"].iloc[0], "frequency": f, "power": p})

    kinds = dict(samples.dtypes)
    return samples.groupBy(*KEYS).applyInPandas(run, f"neuron {kinds['neuron']}, trial {kinds['trial']}, frequency double, power double")


def replace_trial(trials: DataFrame, new: DataFrame) -> DataFrame:
    """Trials of ``new`` take the place of those of the same number."""
    return trials.join(new.select(*KEYS).distinct(), list(KEYS), "left_anti").unionByName(new)


# Metadata: trials (neuron, trial, metadata map<string,string>, log array<string>).


def add_metadata(trials: DataFrame, key: str, value: str) -> DataFrame:
    """Adds or replaces an entry."""
    return trials.withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, _: k != key), F.create_map(F.lit(key), F.lit(value))))


def get_metadata(trials: DataFrame, key: str | None = None) -> DataFrame:
    """All metadata, or one entry, null where a trial has none of the name."""
    return trials.select(*KEYS, F.col("metadata") if key is None else F.try_element_at("metadata", F.lit(key)).alias(key))


def log_processing(trials: DataFrame, step: str) -> DataFrame:
    """Appends a step and the time to the log."""
    return trials.withColumn("log", F.array_append("log", F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f" {step}"))))
