import numpy as np
import pytest

from wavelattice.operators import kernels, signal, spectral
from wavelattice.sources import files


def test_wav_round_trip():
    x = np.array([[0.0, 0.5, -0.5, 0.25], [0.1, -0.1, 0.9, -1.0]])
    rate, back = files.decode_wav(files.encode_wav(x, 8000))
    assert rate == 8000 and np.abs(back - x).max() < 1e-4
    assert files.decode_wav(files.encode_wav(x, 8000), offset=2 / 8000)[1].shape == (2, 2)
    with pytest.raises(ValueError):
        files.decode_wav(files.encode_wav(x, 8000), offset=1.0)


def test_stft_identity():
    x = np.random.default_rng(0).normal(size=501)
    z = spectral.stft_array(x, 64, 16)
    assert np.abs(spectral.istft_array(z, 64, 16, len(x)) - x).max() < 1e-10


def test_parameters(spark):
    s = spark.createDataFrame([("a", 0, 0, 1.0)], "item string, ch int, n long, x double")
    for bad in (lambda: signal.pan(s, 50), lambda: signal.zero_pad(s, -1, 0), lambda: signal.delay(s, {0: -1}), lambda: signal.tremolo(s, 8000, 0.01, 0.5)):
        with pytest.raises(ValueError):
            bad()


def test_silence_stays_silence(spark):
    s = spark.createDataFrame([("a", 0, k, 0.0) for k in range(4)], "item string, ch int, n long, x double")
    assert [r.x for r in signal.peak_normalize(s).collect()] == [0.0] * 4


def test_rpca_separates_low_rank_and_sparse():
    r = np.random.default_rng(1)
    low = np.outer(r.random(40), r.random(30))
    sparse = np.zeros((40, 30))
    sparse[r.integers(0, 40, 30), r.integers(0, 30, 30)] = 5
    a, b = kernels.rpca(low + sparse)
    assert np.abs(a - low).max() < 0.05 and np.abs(b - sparse).max() < 0.05


def test_nmf_reconstructs():
    r = np.random.default_rng(2)
    v = r.random((30, 3)) @ r.random((3, 40))
    w, h = kernels.nmf(v, 3, iterations=500)
    assert np.linalg.norm(v - w @ h) / np.linalg.norm(v) < 0.05 and (w >= 0).all() and (h >= 0).all()


def test_ica_unmixes():
    r = np.random.default_rng(3)
    s = np.stack([np.sign(np.sin(np.arange(2000) / 17)), r.uniform(-1, 1, 2000)])
    found = kernels.fast_ica(np.array([[1, 0.6], [0.4, 1]]) @ s)
    c = np.abs(np.corrcoef(np.vstack([s, found]))[:2, 2:])
    assert c.max(axis=1).min() > 0.95


def test_peaks_are_apart():
    v = np.zeros(100)
    v[[10, 12, 50, 90]] = [1.0, 0.9, 0.8, 0.7]
    assert kernels.peaks(v, 3, distance=5) == [10, 50, 90]
    with pytest.raises(ValueError):
        kernels.peaks(np.zeros(5), 1)


def test_biquad_low_pass_keeps_low_tones():
    n = np.arange(4000)
    low, high = np.sin(2 * np.pi * 50 * n / 8000), np.sin(2 * np.pi * 3000 * n / 8000)
    out = kernels.biquad(low + high, 8000, "low", 500)
    assert np.std(out[500:] - low[500:]) < 0.2


def test_resample_length_and_tone():
    n = np.arange(8000)
    out = kernels.resample(np.sin(2 * np.pi * 440 * n / 8000), 8000, 4000)
    assert len(out) == 4000 and np.abs(out[500:3500] - np.sin(2 * np.pi * 440 * np.arange(4000) / 4000)[500:3500]).max() < 0.05


def test_per_item_kernels(spark):
    r = np.random.default_rng(4)
    s = spark.createDataFrame([(i, c, k, float(v)) for i in "ab" for c in (0, 1) for k, v in enumerate(r.normal(size=300))], "item string, ch int, n long, x double")
    for method in kernels.SEPARATORS:
        out = kernels.separate(s, method, 8000, 64, 16).groupBy("item", "ch", "n").count().count()
        assert out == 1200, method
