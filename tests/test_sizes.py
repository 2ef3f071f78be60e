"""Parts of the signal operators that keep tasks small."""

import numpy as np
import pytest

from wavelattice.operators import learning, spectral
from wavelattice.plans import catalog
from wavelattice.sources import views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("made", [catalog.spectra, catalog.source_spectra, lambda spark, d: spectral.ipd_ild(spectral.stft(views.line_stereo(spark, d), 16, 4))])
def test_tasks_follow_the_rows(spark, monkeypatch, made):
    """Cells of spectra stay in the tasks that samples are dealt to, as many as the input asks for."""
    monkeypatch.setattr(views, "SHARE", 50)
    cells = made(spark, SF)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    assert cells.rdd.getNumPartitions() >= 20


@pytest.mark.parametrize("name, scans", [("irm_psa", 1), ("apply_mask", 2)])
def test_cells_are_not_dealt_again(spark, monkeypatch, name, scans):
    """Masks meet spectra in the tasks that samples are dealt to; a join by cell would deal cells to the session's number of tasks."""
    monkeypatch.setattr(views, "SHARE", 50)
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == scans and "Join" not in plan


def test_histogram_takes_one_pass(spark, monkeypatch):
    """The cells of a task are made once, not once for each of the grid, its largest and the result."""
    monkeypatch.setattr(views, "SHARE", 50)
    plan = catalog.duet_histogram(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_silhouette_in_blocks(spark, monkeypatch):
    """Small and shuffled blocks, equal vectors and a null label give what all pairs give, without a row a pair."""
    r = np.random.default_rng(5)
    v = r.normal(size=(60, 4)).round(3)
    v[7], v[20] = v[0], v[0] + 1e-7
    labels = [None if k == 30 else k % 3 for k in range(60)]
    f = spark.createDataFrame([(k, labels[k], v[k].tolist()) for k in range(60)], "id long, label int, v array<double>").repartition(3)
    for name, value in (("BLOCK", 7), ("SAMPLE_BLOCK", 4), ("STEP", 3), ("FEW", 1)):
        monkeypatch.setattr(learning, name, value)
    got = {x.id: (x.label, x.s) for x in learning.silhouette(f, f.where("id % 10 = 0")).collect()}
    for k in range(0, 60, 10):
        gap = np.sqrt(((v - v[k]) ** 2).sum(axis=1))
        means = {c: np.mean([gap[j] for j in range(60) if j != k and labels[j] == c]) for c in range(3)}
        a, b = means.get(labels[k]), min((m for c, m in means.items() if c != labels[k]), default=0)
        assert got[k][0] == labels[k] and got[k][1] == pytest.approx(0 if a is None else (b - a) / max(a, b), abs=1e-12)
    assert len(got) == 6


def test_inverse_transform_with_hops_that_do_not_divide_the_window():
    x = np.random.default_rng(6).normal(size=203)
    for length, hop in ((16, 4), (16, 5), (12, 5), (8, 8)):
        z, w = spectral.stft_array(x, length, hop), spectral.window_array(length)
        out, norm = np.zeros(400), np.zeros(400)
        for t, frame in enumerate(np.fft.irfft(z.T * w.sum(), n=length, axis=1) * w):
            out[t * hop : t * hop + length] += frame
            norm[t * hop : t * hop + length] += w * w
        want = np.where(norm > 1e-10, out / np.maximum(norm, 1e-10), out)[length // 2 : length // 2 + len(x)]
        assert (spectral.istft_array(z, length, hop, len(x)) == want).all()
