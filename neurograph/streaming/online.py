"""Online versions of signal operators over streams of samples (an extension: there is no streaming counterpart to match)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "neuron bigint, start timestamp, end timestamp, n bigint, peak double"


def windowed_statistics(stream: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(neuron, start, end, n, mean, peak) of (neuron, ts, value): tumbling windows, or sliding ones; rows later than ``late`` are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    seen = stream.withWatermark("ts", late).groupBy("neuron", w.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("peak"))
    return seen.select("neuron", "w.start", "w.end", "n", "mean", "peak")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(neuron, start, end, n): bursts of samples with no longer gap between two."""
    seen = stream.withWatermark("ts", late).groupBy("neuron", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return seen.select("neuron", "w.start", "w.end", "n")


def segments(stream: DataFrame, threshold: float, min_samples: int = 1) -> DataFrame:
    """SEGMENTS: runs of samples above the threshold, emitted when they end. A neuron's state is its open run, however long."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, last, n, peak = state.get if state.exists else (None, None, 0, None)
        out = []
        rows = pd.concat(list(batches)).sort_values("ts")
        for ts, value in zip(rows["ts"], rows["value"], strict=True):
            if value > threshold:
                start, n, peak = start if n else ts, n + 1, value if peak is None else max(peak, value)
            else:
                if n >= min_samples and n:
                    out.append((key[0], start, ts, n, peak))
                start, n, peak = None, 0, None
            last = ts
        state.update((start, last, n, peak))
        yield pd.DataFrame(out, columns=["neuron", "start", "end", "n", "peak"])

    grouped = stream.groupBy("neuron")
    return grouped.applyInPandasWithState(step, SEGMENTS, "start timestamp, last timestamp, n bigint, peak double", "append", "NoTimeout")
