"""Signals, responses, kernels, simulation, fitting and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurograph.functions import kernels
from neurograph.operators import fit, signal, simulate, stim, tsa
from neurograph.streaming import online

SCHEMA = "neuron string, trial int, t int, value double, stim double"


def frame(spark, values, neuron="n"):
    return spark.createDataFrame([(neuron, 0, k, float(x), 0.0) for k, x in enumerate(values)], SCHEMA)


def noisy():
    t = np.linspace(0, 30, 150)
    return np.sin(2 * np.pi * 10 * t) + 0.1 * np.random.default_rng(1).standard_normal(150)


def test_statistics_equal_numpy(spark):
    x = noisy()
    r = signal.statistics(frame(spark, x)).first()
    z = (x - x.mean()) / x.std()
    want = x.mean(), x.std(), np.median(x), x.min(), x.max(), (z**3).mean(), (z**4).mean() - 3, math.sqrt((x * x).mean())
    assert np.allclose(tuple(r)[2:], want, atol=1e-10)


def test_step_and_impulse(spark):
    step = stim.features(frame(spark, [0.0] * 2 + [1.0] * 148), 30).first()
    assert step.maximum == 1.0 and abs(step.auc - 28.5) < 0.01
    x = np.where(np.arange(150) < 30, 0.1, 0.0)
    x[105] = 1.0
    r = stim.characteristics(frame(spark, x), 30).first()
    assert abs(r.baseline_mean - 0.1) < 1e-12 and abs(r.amplitude - 0.9) < 1e-12
    with pytest.raises(ValueError):
        stim.extract_feature(frame(spark, x), 30, 999)
    with pytest.raises(ValueError):
        stim.validate(frame(spark, x), 150)


def test_smoothing_equals_numpy(spark):
    x = noisy()
    for size in (4, 5, 8):
        got = [r.value for r in signal.moving_average(frame(spark, x), size).orderBy("t").collect()]
        assert np.allclose(got, np.convolve(x, np.ones(size), mode="same") / size)
    got = [r.value for r in signal.median_filter(frame(spark, x), 5).orderBy("t").collect()]
    padded = np.pad(x, 2)
    assert np.allclose(got, [np.median(padded[k : k + 5]) for k in range(150)])
    for sigma in (1.5, 40):  # a kernel that is longer than the series, too
        got = [r.value for r in signal.gaussian_smooth(frame(spark, x), sigma).orderBy("t").collect()]
        assert np.allclose(got, kernels.gaussian_smooth(x, sigma))


def test_butterworth():
    b, a = kernels.butter(4, 1.0, "low", 5)
    w = np.exp(-1j * 2 * np.pi * np.array([0, 0.5, 1.0, 2.5]) / 5)
    h = np.abs(np.polyval(b[::-1], w) / np.polyval(a[::-1], w))
    assert np.allclose(h[[0, 2, 3]], [1, 1 / math.sqrt(2), 0], atol=1e-6) and h[1] > 0.99
    b, a = kernels.butter(3, 1.0, "high", 5)
    h = np.abs(np.polyval(b[::-1], w) / np.polyval(a[::-1], w))
    assert np.allclose(h[[0, 2, 3]], [0, 1 / math.sqrt(2), 1], atol=1e-6)
    b, a = kernels.butter(2, (0.5, 1.5), "band", 5)
    h = np.abs(np.polyval(b[::-1], np.exp(-1j * 2 * np.pi * np.array([0, 0.5, 1.5, 2.5]) / 5)) / np.polyval(a[::-1], np.exp(-1j * 2 * np.pi * np.array([0, 0.5, 1.5, 2.5]) / 5)))
    assert np.allclose(h, [0, 1 / math.sqrt(2), 1 / math.sqrt(2), 0], atol=1e-6)
    b, a = kernels.butter(4, 2.0, "low", 5)
    assert np.allclose(kernels.filtfilt(b, a, np.full(50, 3.0)), 3.0)
    for cutoff in (10, 2.5, 0):
        with pytest.raises(ValueError):
            kernels.butter(4, cutoff, "low", 5)


def test_filter_in_spark(spark):
    got = signal.butterworth(frame(spark, noisy()[:50]), "low", 2.0)
    assert got.count() == 50 and all(math.isfinite(r.value) for r in got.collect())


def test_welch_has_the_variance():
    x = noisy()
    f, p = kernels.welch(x, 5)
    assert (p >= 0).all() and abs((p[1:] * (f[1] - f[0])).sum() - x.var()) < 0.5 * x.var() + 1e-9
    t = np.arange(512) / 5
    f, p = kernels.welch(np.sin(2 * np.pi * 1.0 * t), 5)
    assert abs(f[p.argmax()] - 1.0) < 0.05


def test_peaks(spark):
    x = [0, 2, 1, 3, 3, 3, 1, 5, 5, 6, 2, 2, 0]
    assert kernels.find_peaks(np.array(x, float)).tolist() == [1, 4, 9]
    assert [r.t for r in signal.peaks(frame(spark, x)).orderBy("t").collect()] == [1, 4, 9]
    assert kernels.find_peaks(np.array(x, float), height=3).tolist() == [4, 9]
    assert kernels.find_peaks(np.array(x, float), distance=6).tolist() == [1, 9]
    with pytest.raises(ValueError):
        signal.spaced_peaks(frame(spark, x), 0.5)


def test_segments(spark):
    x = [1, 1, 0, 1, 1, 1, 0, 0, 1]
    got = [(r.start, r.end) for r in signal.segments(frame(spark, x), 0.5, 1).orderBy("start").collect()]
    assert got == [(0, 2), (3, 6), (8, 9)]
    assert signal.segments(frame(spark, [1] * 9), 0.5, 1).count() == 0 and signal.segments(frame(spark, [0, 1, 1]), 0.5, 1).count() == 0
    s = noisy()
    for r in signal.segments(frame(spark, s), 0.5, 1).collect():
        assert (s[r.start : r.end] > 0.5).all()


def test_wavelet_and_tensors():
    rng = np.random.default_rng(2)
    x = np.sin(np.linspace(0, 12, 200))
    y = x + 0.3 * rng.standard_normal(200)
    for w in ("db4", "db6"):
        assert np.abs(kernels.wavelet_denoise(y, w) - x).mean() < 0.7 * np.abs(y - x).mean()
    low = np.array(kernels.DB4)
    assert abs(low.sum() - math.sqrt(2)) < 1e-9 and abs((low**2).sum() - 1) < 1e-9
    f = [rng.standard_normal((n, 2)) for n in (5, 6, 7)]
    t = np.einsum("ir,jr,kr->ijk", *f)
    mask = rng.random(t.shape) > 0.1
    _, made = kernels.parafac(t, 2, 500, 1, mask)
    assert np.abs(made - t).max() < 0.05 * np.abs(t).max()
    assert kernels.tucker(t, (2, 2, 2))[2] > 0.999


def test_euler_against_closed_form(spark):
    nodes = spark.createDataFrame([(0, "a", 1.0, 2.0, 1.0, "linear", False)], "model_id bigint, name string, gain double, time_constant double, baseline double, activation string, static boolean")
    edges = spark.createDataFrame([], "model_id bigint, pre string, post string, weight double")
    times = [0.01 * k for k in range(300)]
    got = [r.rate for r in simulate.simulate(simulate.Parameters(nodes, edges), times).orderBy("t").collect()]
    assert np.allclose(got, 1 - (1 - 0.005) ** np.arange(300)) and got[0] == 0
    with pytest.raises(ValueError):
        simulate.simulate(simulate.Parameters(nodes, edges), [])
    with pytest.raises(ValueError):
        simulate.Parameters(nodes, edges).set_nodes(colour=1)


def test_fit():
    x, fx = fit.minimize(lambda p: (p[0] - 0.3) ** 2 + 10 * (p[1] + 0.5) ** 2, np.array([1.0, 1.0]), [(-1, 1), (-0.2, 1)])
    assert np.allclose(x, [0.3, -0.2], atol=1e-4)
    p = fit.latin_hypercube({"a": (0.0, 1.0), "b": (2.0, 4.0)}, 10, 1)
    assert sorted((p["a"] * 10).astype(int)) == list(range(10)) and p["b"].between(2, 4).all()
    assert fit.parse("weight:a:b:0") == {"parameter": "weight", "pre": "a", "post": "b"} and fit.parse("gain:a") == {"parameter": "gain", "name": "a"}


def test_search_reaches_a_small_loss(spark):
    from neurograph.plans import registry

    rows = {r["round"]: r.best_loss for r in registry.QUERIES["fit_random_search"](spark, "").collect()}
    assert rows[2] <= rows[0] and rows[2] < 1e-3


def test_cross_correlation_finds_the_lag(spark):
    x = np.random.default_rng(3).standard_normal(100)
    rows = [(0, k, float(x[k])) for k in range(100)] + [(1, k, float(x[k - 4])) for k in range(4, 100)]
    s = spark.createDataFrame(rows, "series int, t int, value double")
    pairs = spark.createDataFrame([(0, 1)], "a int, b int")
    best = tsa.best_lag(tsa.cross_correlation(s, pairs, 10)).first()
    assert best.lag == 4 and abs(best.c - 1) < 1e-9


def test_streams_equal_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("neuron"), F.col("ts").cast("timestamp").alias("ts"), "value").where("neuron < 5")
    e.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    stats = run(online.windowed_statistics(source, "1 day"), "w", "update").collect()
    want = {(r.neuron, r.w.start): r.n for r in e.groupBy("neuron", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert {(r.neuron, r.start): r.n for r in stats} == want
    got = run(online.segments(source, 10.0), "s", "append")
    rows, n = [r.value for r in e.where("neuron = 1").orderBy("ts").collect()], 0
    for k in range(1, len(rows)):
        n += rows[k] <= 10 < rows[k - 1]
    assert got.where("neuron = 1").count() == n


def test_metadata_and_trials(spark):
    trials = spark.createDataFrame([("n", 0, {"a": "1"}, ["x"])], "neuron string, trial int, metadata map<string,string>, log array<string>")
    got = signal.log_processing(signal.add_metadata(signal.add_metadata(trials, "a", "2"), "b", "3"), "filter").first()
    assert got.metadata == {"a": "2", "b": "3"} and len(got.log) == 2 and got.log[1].endswith(" filter")
    assert signal.get_metadata(trials, "z").first().z is None
    old, new = frame(spark, [1, 2]), frame(spark, [5])
    assert [r.value for r in signal.replace_trial(old, new).collect()] == [5.0]
    assert signal.recording(frame(spark, range(10)), 1.0).count() == 5
    with pytest.raises(Exception, match="longer"):
        signal.recording(frame(spark, range(4)), 1.0).collect()
