"""Losses, projections and kernels by item against plain NumPy."""

import itertools

import numpy as np
import pytest

from wavelattice.operators import kernels, network


def long(spark, data):
    """data: label -> samples of one item."""
    rows = [("i", k, 0, n, float(x)) for k, v in data.items() for n, x in enumerate(v)]
    return spark.createDataFrame(rows, "item string, label string, ch int, n long, x double")


@pytest.mark.parametrize("estimates", [["a", "b"], ["a", "b", "c"]])
def test_invariant_loss(spark, estimates):
    r = np.random.default_rng(1)
    t, e = {k: r.normal(size=30) for k in "uv"}, {k: r.normal(size=30) for k in estimates}
    got = network.invariant_loss(long(spark, t), long(spark, e), list("uv"), estimates).first()["loss"]
    want = min(np.mean([np.abs(t[k] - e[m]).mean() for k, m in zip("uv", way, strict=True)]) for way in itertools.permutations(estimates, 2))
    assert got == pytest.approx(want)


def test_too_few_estimates(spark):
    with pytest.raises(ValueError):
        network.invariant_loss(long(spark, {"u": [1]}), long(spark, {"a": [1]}), ["u", "v"], ["a"])


def test_mel_weights_sum_to_one():
    w = network.mel_weights(16000, 257, 40)
    sums = np.zeros(40)
    for _, m, x in w:
        sums[m] += x
    assert sums == pytest.approx(np.ones(40)) and len(w) <= 2 * 257


def test_ica_recovers_sources(spark):
    n = np.arange(2000)
    s = np.array([np.sin(n / 7), np.sign(np.sin(n / 11))])
    x = np.array([[1, 0.5], [0.4, 1]]) @ s
    rows = [("i", c, k, float(x[c, k])) for c in range(2) for k in range(len(n))]
    got = kernels.by_item(spark.createDataFrame(rows, "item string, ch int, n long, x double"), kernels.fast_ica).toPandas()
    y = got.pivot(index="ch", columns="n", values="x").to_numpy()
    assert np.abs(np.corrcoef(np.vstack([s, y]))[:2, 2:]).max(axis=1).min() > 0.98


def test_filters_and_resampling(spark):
    n = np.arange(800)
    x = np.sin(2 * np.pi * 100 * n / 8000)
    rows = [("i", 0, int(k), float(v)) for k, v in zip(n, x, strict=True)]
    df = spark.createDataFrame(rows, "item string, ch int, n long, x double")
    low = kernels.by_item(df, lambda a: kernels.by_channel(a, kernels.biquad, 8000, "low", 1000)).toPandas().sort_values("n").x
    high = kernels.by_item(df, lambda a: kernels.by_channel(a, kernels.biquad, 8000, "high", 1000)).toPandas().x
    assert low.abs().max() > 0.9 and high[100:].abs().max() < 0.1
    half = kernels.by_item(df, lambda a: kernels.by_channel(a, kernels.resample, 8000, 4000)).toPandas().sort_values("n").x.to_numpy()
    assert len(half) == 400 and np.abs(half[50:-50] - x[::2][50:-50]).max() < 0.01
