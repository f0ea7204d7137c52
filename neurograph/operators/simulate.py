"""Rate models on graphs: many models at once, each in a task of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVATIONS = {"linear": lambda x: x, "sigmoid": lambda x: 1 / (1 + np.exp(-x)), "tanh": np.tanh, "relu": lambda x: np.maximum(x, 0)}


def step_input(t: Column, start: float, end: float, value: float) -> Column:
    """``value`` strictly between start and end."""
    return F.when((t > start) & (t < end), F.lit(float(value))).otherwise(0.0)


def adapting_input(t: Column, start: float, end: float, value: float, decay: float) -> Column:
    return F.when((t > start) & (t < end), value * F.exp(-(t - start) / decay)).otherwise(0.0)


def function_input(t: Column, f: Callable[[Column], Column]) -> Column:
    return f(t)


def series_input(times: DataFrame, values: DataFrame) -> DataFrame:
    """(t, value) looked up; a time without a value is an error."""
    joined = times.join(values, "t", "left")
    return joined.withColumn("value", F.coalesce("value", F.raise_error(F.lit("a time has no value")).cast("double")))


class Parameters:
    """Nodes (model_id, name, gain, time_constant, baseline, activation, static), edges (model_id, pre, post, weight), inputs (model_id, name, t, value)."""

    NODE, EDGE = ("gain", "time_constant", "baseline"), ("weight",)

    def __init__(self, nodes: DataFrame, edges: DataFrame, inputs: DataFrame | None = None):
        self.nodes, self.edges, self.inputs = nodes, edges, inputs

    def set_nodes(self, **values) -> Parameters:
        if unknown := set(values) - {*self.NODE, "activation"}:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        if (a := values.get("activation")) is not None and a not in ACTIVATIONS:
            raise ValueError(f"unknown activation {a!r}")
        return Parameters(self.nodes.withColumns({k: F.lit(v) for k, v in values.items()}), self.edges, self.inputs)

    def set_edges(self, **values) -> Parameters:
        if unknown := set(values) - set(self.EDGE):
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        return Parameters(self.nodes, self.edges.withColumns({k: F.lit(float(v)) for k, v in values.items()}), self.inputs)

    def set_inputs(self, inputs: DataFrame | None) -> Parameters:
        return Parameters(self.nodes, self.edges, inputs)

    def remove_inputs(self) -> Parameters:
        return Parameters(self.nodes, self.edges)

    def update_nodes(self, rows: DataFrame) -> Parameters:
        """From (name, and any of NODE and activation): values of single nodes; nulls and nodes without a row stay. ValueError for unknown names or columns."""
        return Parameters(_updated(self.nodes, rows, ["name"], {*self.NODE, "activation"}), self.edges, self.inputs)

    def update_edges(self, rows: DataFrame) -> Parameters:
        """From (pre, post, weight): weights of single edges, as ``update_nodes``."""
        return Parameters(self.nodes, _updated(self.edges, rows, ["pre", "post"], set(self.EDGE)), self.inputs)


def _updated(now: DataFrame, rows: DataFrame, keys: list[str], known: set[str]) -> DataFrame:
    keys = (["model_id"] if "model_id" in rows.columns else []) + keys
    values = [c for c in rows.columns if c not in keys]
    if unknown := set(values) - known:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    if not rows.join(now, keys, "left_anti").isEmpty():
        raise ValueError("a row is of no node or edge of the model")
    out = now.join(rows.select(*keys, *[F.col(c).alias(f"_{c}") for c in values]), keys, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in values}).select(*now.columns)


#: Rate equations: relaxing, r' = (g f(x) - r) / tau; and leaking, r' = g x - r / tau without a function.
FORMULAS = ("relax", "leak")


def euler(w: np.ndarray, gain, tau, base, act: list[str], static, fed, ext: np.ndarray, times: np.ndarray, start=None, formula: str = "relax") -> np.ndarray:
    """Rates (time, node): r' = (g f(Σ w r + input + baseline) - r) / τ by explicit Euler steps. ``ext`` is (time, node), already times the gain.

    Nodes with an input of their own don't listen to edges; static nodes have their input as rate. With the ``leak`` formula r' = g Σ w r + g input - r / τ,
    and all nodes listen.
    """
    n = len(gain)
    out = np.zeros((len(times), n))
    out[0] = 0.0 if start is None else start
    out[0, static] = ext[0, static]
    kinds = {a: np.array([x == a for x in act]) for a in set(act)}
    listen = ~fed
    for k in range(len(times) - 1):
        r = out[k]
        if formula == "leak":
            out[k + 1] = r + (gain * (w.T @ r) + ext[k] - r / tau) * (times[k + 1] - times[k])
            out[k + 1, static] = ext[k + 1, static]
            continue
        total = np.where(listen, w.T @ r, 0.0) + np.where(fed, ext[k], 0.0) + base
        f = np.empty(n)
        for a, mask in kinds.items():
            f[mask] = ACTIVATIONS[a](total[mask])
        out[k + 1] = r + (gain * f - r) / tau * (times[k + 1] - times[k])
        out[k + 1, static] = ext[k + 1, static]
    return out


def simulate(p: Parameters, times: Iterable[float], formula: str = "relax") -> DataFrame:
    """(model_id, name, t, rate) of every model. Models are spread over tasks, a model's time steps run in one."""
    ts = np.array(list(times), float)
    if formula not in FORMULAS:
        raise ValueError(f"unknown formula {formula!r}")
    if not len(ts):
        raise ValueError("time points must be set")
    model = [F.struct(F.lit("n").alias("kind"), F.col("name"), F.lit(None).cast("string").alias("other"), F.col("gain").cast("double").alias("a"), F.col("time_constant").cast("double").alias("b"), F.col("baseline").cast("double").alias("c"), F.col("activation").alias("act"), F.col("static"))]
    nodes = p.nodes.select("model_id", F.inline(F.array(*model)))
    null = F.lit(None)
    edges = p.edges.select("model_id", F.lit("e").alias("kind"), F.col("pre").alias("name"), F.col("post").alias("other"), F.col("weight").cast("double").alias("a"), null.cast("double").alias("b"), null.cast("double").alias("c"), null.cast("string").alias("act"), null.cast("boolean").alias("static"))
    rows = nodes.unionByName(edges)
    if p.inputs is not None:
        rows = rows.unionByName(p.inputs.select("model_id", F.lit("i").alias("kind"), "name", null.cast("string").alias("other"), F.col("t").cast("double").alias("a"), F.col("value").cast("double").alias("b"), null.cast("double").alias("c"), null.cast("string").alias("act"), null.cast("boolean").alias("static")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf[pdf["kind"] == "n"].sort_values("name")
        names = n["name"].tolist()
        at = {x: k for k, x in enumerate(names)}
        w, ext, fed = np.zeros((len(names), len(names))), np.zeros((len(ts), len(names))), np.zeros(len(names), bool)
        for r in pdf[pdf["kind"] == "e"].itertuples():
            w[at[r.name], at[r.other]] += r.a
        index = {t: k for k, t in enumerate(ts)}
        gain = n["a"].to_numpy(float)
        for r in pdf[pdf["kind"] == "i"].itertuples():
            fed[at[r.name]] = True
            if r.a in index:
                ext[index[r.a], at[r.name]] += gain[at[r.name]] * r.b
        static = n["static"].to_numpy(bool)
        rates = euler(w, gain, n["b"].to_numpy(float), n["c"].to_numpy(float), n["act"].tolist(), static, fed, ext, ts, formula=formula)
        return pd.DataFrame({"model_id": pdf["model_id"].iloc[0], "name": np.tile(names, len(ts)), "t": np.repeat(ts, len(names)), "rate": rates.ravel()})

    return rows.groupBy("model_id").applyInPandas(run, f"model_id {dict(p.nodes.dtypes)['model_id']}, name string, t double, rate double")


def uniform(seed: int, lo: float, hi: float, *keys: str) -> Column:
    """A number of [lo, hi) from a hash of the keys: the same on any cluster."""
    return lo + (hi - lo) * (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53)))


def sweep(template: Parameters, models: int, seed: int, weights: tuple[float, float] = (-1, 1), log_tau: tuple[float, float] = (0, 1)) -> Parameters:
    """``models`` copies of a template (nodes and edges without model_id): uniform weights, time constants 10 to a uniform power."""
    ids = template.nodes.sparkSession.range(models).withColumnRenamed("id", "model_id")
    nodes = ids.crossJoin(template.nodes).withColumn("time_constant", F.pow(F.lit(10.0), uniform(seed, *log_tau, "model_id", "name")))
    edges = ids.crossJoin(template.edges).withColumn("weight", uniform(seed + 1, *weights, "model_id", "pre", "post"))
    return Parameters(nodes, edges, ids.crossJoin(template.inputs) if template.inputs is not None else None)
