"""Stimulus responses: samples (neuron, trial, t, value, stim) whose first ``baseline`` samples are the baseline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurograph.model import F_SAMPLE
from neurograph.operators.signal import KEYS, over

STEP = 1 / F_SAMPLE
#: Features by number.
FEATURES = ("maximum", "auc", "time_to_peak", "mean", "auc_to_peak", "minimum", "onset", "positive_area", "absolute_auc")


def validate(samples: DataFrame, baseline: int) -> DataFrame:
    """``samples``, or ValueError if a trial has no more samples than the baseline, or not as many stimulus values as responses."""
    n = samples.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count("value").alias("v"), F.count("stim").alias("s"))
    if n.where((F.col("n") <= baseline) | (F.col("v") != F.col("s"))).limit(1).count():
        raise ValueError("a trial is too short for its baseline, or its stimulus is of another length")
    return samples


def _area(rows: DataFrame, value: Column, width: float, name: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Trapezoids between neighbouring rows in order of t."""
    pairs = rows.withColumn("_x", value).withColumn("_next", F.lead("_x").over(over(keys).orderBy("t")))
    return pairs.groupBy(*keys).agg(F.coalesce(F.sum((F.col("_x") + F.col("_next")) / 2 * width), F.lit(0.0)).alias(name))


def onset(samples: DataFrame, baseline: int, size: int = 10, deviations: float = 2.0, threshold: float | None = None) -> DataFrame:
    """(neuron, trial, onset): seconds to the first window of ``size`` samples whose mean is above the threshold, by default the baseline's mean
    and two deviations; null if there is none. The last ``size`` samples begin no window."""
    w, b = over(), F.when(F.col("t") < baseline, F.col("value"))
    limit = F.avg(b).over(w) + deviations * F.stddev_pop(b).over(w) if threshold is None else F.lit(float(threshold))
    s = samples.withColumn("_limit", limit).withColumn("_mean", F.avg("value").over(w.orderBy("t").rowsBetween(0, size - 1))).withColumn("_n", F.count("*").over(w))
    hit = (F.col("_mean") > F.col("_limit")) & (F.col("t") < F.col("_n") - size)
    return s.groupBy(*KEYS).agg((F.min(F.when(hit, F.col("t"))) * STEP).alias("onset"))


def features(samples: DataFrame, baseline: int, auc_bin: int = 5, area_bin: int = 10) -> DataFrame:
    """One row for each trial with FEATURES, and ``negative_area``; ValueError for trials that ``validate`` refuses."""
    validate(samples, baseline)
    v = F.col("value")
    basic = samples.groupBy(*KEYS).agg(F.max(v).alias("maximum"), F.min(v).alias("minimum"), F.avg(v).alias("mean"), (F.min_by("t", F.struct(-v, F.col("t"))) * STEP).alias("time_to_peak"))
    fine, coarse = samples.where(F.col("t") % auc_bin == 0), samples.where(F.col("t") % area_bin == 0)
    dx, wide = auc_bin * STEP, area_bin * STEP
    peak = coarse.withColumn("_peak", F.min_by("t", F.struct(-v, F.col("t"))).over(over()))
    parts = [
        basic, _area(fine, v, dx, "auc"), _area(fine, F.abs(v), dx, "absolute_auc"), _area(peak.where(F.col("t") <= F.col("_peak")), v, wide, "auc_to_peak"),
        _area(coarse.where(v > 0), v, wide, "positive_area"), _area(coarse.where(v < 0), F.abs(v), wide, "negative_area"), onset(samples, baseline),
    ]
    out = reduce(lambda a, b: a.join(b, list(KEYS), "left"), parts)
    return out.fillna(0.0, ["positive_area", "negative_area"]).select(*KEYS, *FEATURES, "negative_area")


def extract_feature(samples: DataFrame, baseline: int, number: int) -> DataFrame:
    if number not in range(len(FEATURES)):
        raise ValueError(f"no feature {number}")
    return features(samples, baseline).select(*KEYS, FEATURES[number])


def characteristics(samples: DataFrame, baseline: int) -> DataFrame:
    """amplitude, duration, latency, integral, baseline_mean, baseline_std, snr.

    The duration is (index of the last sample at or below the end threshold - onset in seconds) * 0.2, mixed units included, as results depend on it;
    0 without an onset.
    """
    validate(samples, baseline)
    w, v = over(), F.col("value")
    b = F.when(F.col("t") < baseline, v)
    s = samples.withColumn("_m", F.avg(b).over(w)).withColumn("_s", F.stddev_pop(b).over(w))
    d = v - F.col("_m")
    one = s.groupBy(*KEYS).agg(
        F.min_by(d, F.struct(-F.abs(d), F.col("t"))).alias("amplitude"), F.coalesce(F.max(F.when(v <= F.col("_m") + 2 * F.col("_s"), F.col("t"))), F.count("*")).alias("_end"),
        F.first("_m").alias("baseline_mean"), F.first("_s").alias("baseline_std"), F.avg(d * d).alias("_power"), F.avg(F.when(F.col("t") < baseline, d * d)).alias("_noise"),
    )
    area = _area(samples.where(F.col("t") % 5 == 0), v, 5 * STEP, "integral")
    all_ = one.join(onset(samples, baseline), list(KEYS)).join(area, list(KEYS))
    ratio = F.when(F.col("_noise") > 0, 10 * F.log10(F.col("_power") / F.nullif("_noise", F.lit(0.0)))).otherwise(F.lit(float("inf")))
    return all_.select(*KEYS, "amplitude", F.coalesce((F.col("_end") - F.col("onset")) * STEP, F.lit(0.0)).alias("duration"), F.col("onset").alias("latency"), "integral", "baseline_mean", "baseline_std", ratio.alias("snr"))


def linear_transform(v: Column, lo: Column, hi: Column) -> Column:
    return (v - lo) / (hi - lo)


