"""Fitting of rate models: batches of parameter sets are simulated together and scored by an aggregate."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neurograph.operators.simulate import Parameters, simulate

#: Loss of a trial that diverged.
WORST = 1e6


def squared_error(simulated: str = "rate", real: str = "real") -> Column:
    return F.avg(F.pow(F.col(simulated) - F.col(real), 2))


def correlation_loss(simulated: str = "rate", real: str = "real") -> Column:
    return 1 - F.try_divide(F.covar_pop(simulated, real), F.nullif(F.stddev_pop(simulated) * F.stddev_pop(real), F.lit(0.0)))


def latin_hypercube(bounds: dict[str, tuple[float, float]], n: int, seed: int) -> pd.DataFrame:
    """``n`` points; each parameter's range has one of them in each of ``n`` equal parts."""
    rng = np.random.default_rng(seed)
    return pd.DataFrame({k: lo + (hi - lo) * (rng.permutation(n) + rng.random(n)) / n for k, (lo, hi) in bounds.items()})


def parse(key: str) -> dict:
    """``parameter:node`` or ``parameter:pre:post[:uid]``."""
    p = key.split(":")
    return {"parameter": p[0], "name": p[1]} if len(p) == 2 else {"parameter": p[0], "pre": p[1], "post": p[2]}


def parsed(trials: DataFrame) -> DataFrame:
    """(trial, parameter, pre, post, value) of (trial, key, value)."""
    s = F.split("key", ":")
    return trials.select("*", F.get(s, F.lit(0)).alias("parameter"), F.get(s, F.lit(1)).alias("pre"), F.get(s, F.lit(2)).alias("post"))


def applied(template: Parameters, points: DataFrame) -> Parameters:
    """One model for each row of ``points`` (model_id, a column for each key), others as the template has them."""
    nodes, edges = points.select("model_id").crossJoin(template.nodes), points.select("model_id").crossJoin(template.edges)
    for key in points.columns[1:]:
        p, value = parse(key), points.select(F.col("model_id").alias("_id"), F.col(f"`{key}`").alias("_v"))
        if "name" in p:
            new = F.when(F.col("name") == p["name"], F.col("_v")).otherwise(F.col(p["parameter"]))
            nodes = nodes.join(value, F.col("model_id") == F.col("_id")).withColumn(p["parameter"], new).drop("_id", "_v")
        else:
            new = F.when((F.col("pre") == p["pre"]) & (F.col("post") == p["post"]), F.col("_v")).otherwise(F.col("weight"))
            edges = edges.join(value, F.col("model_id") == F.col("_id")).withColumn("weight", new).drop("_id", "_v")
    inputs = points.select("model_id").crossJoin(template.inputs) if template.inputs is not None else None
    return Parameters(nodes, edges, inputs)


def score(template: Parameters, points: DataFrame, real: DataFrame, times, loss: Column | None = None) -> DataFrame:
    """(model_id, loss) against (name, t, real)."""
    made = simulate(applied(template, points), times).join(real, ["name", "t"])
    value = squared_error() if loss is None else loss
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return made.groupBy("model_id").agg(F.when(bad, F.lit(WORST)).otherwise(value).alias("loss"))


def search(template: Parameters, bounds: dict[str, tuple[float, float]], real: DataFrame, times, trials: int = 64, rounds: int = 3, seed: int = 0, loss: Column | None = None) -> DataFrame:
    """(trial, round, loss, params json) of all trials. The first round fills the bounds with a Latin hypercube; each further one a box around the
    best, a third as wide. Takes the place of sequential samplers: judge it by the loss that it reaches."""
    spark, now, out, number = real.sparkSession, dict(bounds), None, 0
    for r in range(rounds):
        points = latin_hypercube(now, trials, seed + r)
        points.insert(0, "model_id", range(number, number + trials))
        number += trials
        frame = spark.createDataFrame(points)
        scored = score(template, frame, real, times, loss).toPandas()
        joined = points.merge(scored, on="model_id")
        rows = pd.DataFrame({"trial": joined["model_id"], "round": r, "loss": joined["loss"], "params": [json.dumps({k: float(row[k]) for k in bounds}) for _, row in joined.iterrows()]})
        out = rows if out is None else pd.concat([out, rows])
        best = joined.sort_values(["loss", "model_id"]).iloc[0]
        now = {k: (max(lo, best[k] - (now[k][1] - now[k][0]) / 6), min(hi, best[k] + (now[k][1] - now[k][0]) / 6)) for k, (lo, hi) in bounds.items()}
    return spark.createDataFrame(out)


def minimize(f, start: np.ndarray, bounds: list[tuple[float, float]], rounds: int = 100, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """Projected BFGS with finite differences and backtracking, for smooth losses on the driver or in a task."""
    lo, hi = np.array(bounds, float).T
    x = np.clip(np.asarray(start, float), lo, hi)
    n, h = len(x), np.eye(len(x))

    def gradient(x: np.ndarray, fx: float) -> np.ndarray:
        e = 1e-7 * np.maximum(1, np.abs(x))
        return np.array([(f(np.where(np.arange(n) == k, np.where(x + e > hi, x - e, x + e), x)) - fx) / (-e[k] if x[k] + e[k] > hi[k] else e[k]) for k in range(n)])

    fx = f(x)
    g = gradient(x, fx)
    for _ in range(rounds):
        free = ~((x <= lo) & (g > 0) | (x >= hi) & (g < 0))
        if not free.any() or np.abs(g[free]).max() < tolerance:
            break
        d = np.zeros(n)
        d[free] = -(h[np.ix_(free, free)] @ g[free])
        if d @ g >= 0:
            h, d = np.eye(n), np.where(free, -g, 0.0)
        t = 1.0
        while t > 1e-14:
            y = np.clip(x + t * d, lo, hi)
            if (fy := f(y)) <= fx + 1e-4 * (g @ (y - x)):
                break
            t /= 2
        else:
            break
        gy = gradient(y, fy)
        s, v = y - x, gy - g
        if s @ v > 1e-12:
            a = np.eye(n) - np.outer(s, v) / (s @ v)
            h = a @ h @ a.T + np.outer(s, s) / (s @ v)
        done = abs(fx - fy) <= tolerance * max(1.0, abs(fx))
        x, fx, g = y, fy, gy
        if done:
            break
    return x, fx


def windows(series: DataFrame, length: int = 100, step: int = 50) -> DataFrame:
    """``series`` with ``window``, exploded to every whole window of ``length`` samples that starts at a multiple of ``step``."""
    last = F.expr(f"(max(t) over (partition by name) + 1 - {length}) div {step}")
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - length + 1) / step)).cast("bigint")
    rows = series.withColumn("_last", F.when(F.expr("max(t) over (partition by name)") + 1 >= length, last).otherwise(-1))
    upto = F.least(F.expr(f"t div {step}"), F.col("_last"))
    return rows.where(upto >= first).withColumn("window", F.explode(F.sequence(first, upto))).drop("_last")


def refit(template: Parameters, bounds: dict[str, tuple[float, float]], real: DataFrame, length: int = 100, step: int = 50, trials: int = 25, rounds: int = 1, seed: int = 0, loss: Column | None = None) -> DataFrame:
    """(window, trial, round, loss, params json): the search done in each window of ``real`` (name, t, real; t from 0) by itself, models starting anew at its first
    sample. All windows' trials of a round are one simulation, with the window as a key; what comes to the driver is a row a trial."""
    cut = windows(real, length, step).withColumn("t", (F.col("t") - F.col("window") * step).cast("double"))
    fed = None if template.inputs is None else windows(template.inputs.withColumn("t", F.col("t").cast("bigint")), length, step).withColumn("t", F.col("t") - F.col("window") * step)
    numbers = [r[0] for r in cut.select("window").distinct().orderBy("window").collect()]
    spark, out = real.sparkSession, []
    boxes = {w: dict(bounds) for w in numbers}
    for r in range(rounds):
        points = pd.concat([latin_hypercube(boxes[w], trials, seed + 1000 * r + k).assign(window=w) for k, w in enumerate(numbers)], ignore_index=True)
        points.insert(0, "model_id", np.arange(len(points)) + r * len(points))
        frame = spark.createDataFrame(points)
        own = frame.select("model_id", "window")
        p = applied(template.remove_inputs(), frame.drop("window"))
        made = simulate(p.set_inputs(own.join(fed, "window").drop("window") if fed is not None else None), range(length))
        value = squared_error() if loss is None else loss
        bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
        scored = made.join(own, "model_id").join(cut, ["window", "name", "t"]).groupBy("model_id").agg(F.when(bad, F.lit(WORST)).otherwise(value).alias("loss")).toPandas()
        joined = points.merge(scored, on="model_id")
        out.append(pd.DataFrame({"window": joined["window"], "trial": joined["model_id"], "round": r, "loss": joined["loss"], "params": [json.dumps({k: float(row[k]) for k in bounds}) for _, row in joined.iterrows()]}))
        for w, rows in joined.groupby("window"):
            best, box = rows.sort_values(["loss", "model_id"]).iloc[0], boxes[w]
            boxes[w] = {k: (max(lo, best[k] - (box[k][1] - box[k][0]) / 6), min(hi, best[k] + (box[k][1] - box[k][0]) / 6)) for k, (lo, hi) in bounds.items()}
    return spark.createDataFrame(pd.concat(out, ignore_index=True)) if out and numbers else spark.createDataFrame([], "window bigint, trial bigint, round bigint, loss double, params string")


def common_parameters(studies: DataFrame) -> DataFrame:
    """Keys that every study of (study, key, value) has, with their mean best value."""
    k = studies.agg(F.countDistinct("study").alias("_all"))
    return studies.groupBy("key").agg(F.countDistinct("study").alias("_k"), F.avg("value").alias("mean_value")).crossJoin(k).where("_k = _all").select("key", "mean_value")


def save_trials(trials: DataFrame, path: str) -> None:
    """Appends trials to a store of Parquet files."""
    trials.write.mode("append").parquet(path)


def load_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
