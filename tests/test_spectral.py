"""Measures and spectra on edge lists against dense solutions."""

import numpy as np
import pytest

from sequora.operators import kernels as kn, spectral


def edges_of(spark, p):
    i, j = np.nonzero(p)
    return spark.createDataFrame([(int(a), int(b), float(p[a, b])) for a, b in zip(i, j)], "src int, dst int, p double")


def slow(n, link):
    """Three sets of states that hardly meet."""
    r = np.random.default_rng(1)
    p = np.zeros((n, n))
    for s in range(3):
        inside = np.arange(s * n // 3, (s + 1) * n // 3)
        for i in inside:
            p[i, r.choice(inside, 6)] += r.random(6)
        p[inside[0], ((s + 1) * n // 3) % n] += link
    for i in range(n):
        p[i, (i + 1) % n if (i + 1) % (n // 3) else i - n // 3 + 1] += 0.1
    return p / p.sum(axis=1, keepdims=True)


def periodic(n):
    p = np.zeros((n, n))
    r = np.random.default_rng(2)
    for i in range(n):
        p[i, (i + 1) % n] = 1.0
        if i % 10 == 0:  # another path of the same length
            p[i, (i + 1) % n], p[i, (i + n // 2 * 2 + 1 - n // 2) % n] = 0.5 + 0.4 * r.random(), 0.3
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("p", [slow(60, 1e-4), periodic(30)], ids=["slow", "periodic"])
def test_measure_by_cycles(spark, p):
    got = spectral.stationary(edges_of(spark, p)).toPandas().sort_values("state").pi.to_numpy()
    want = kn.stationary(p)
    assert np.abs(got - want).max() < 1e-9


def test_spectrum_on_1200_states(spark):
    n, k = 1200, 4
    p = slow(n, 1e-2)
    pi, values, phi = kn.spectrum(p, k)
    table = spark.createDataFrame([(i, float(x)) for i, x in enumerate(pi)], "state int, pi double")
    found, vectors = spectral.spectrum(spectral.symmetric(edges_of(spark, p), table), k, 1e-8)
    assert np.abs(found - values).max() < 1e-8
    v = np.stack(vectors.toPandas().sort_values("state").v) / np.sqrt(pi)[:, None]
    for j in range(k):
        a, b = v[:, j] / np.abs(v[:, j]).max(), phi[:, j] / np.abs(phi[:, j]).max()
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-4


def test_small_matrices(spark):
    p = slow(15, 0.3)
    pi, values, phi = spectral.reversible_spectrum(edges_of(spark, p), 3)
    want_pi, want, want_phi = kn.spectrum(p, 3)
    assert np.abs(values - want).max() < 1e-9
    assert np.abs(pi.toPandas().sort_values("state").pi.to_numpy() - want_pi).max() < 1e-9
    got = np.stack(phi.toPandas().sort_values("state").phi)
    assert np.abs(np.abs(got / np.linalg.norm(got, axis=0)) - np.abs(want_phi / np.linalg.norm(want_phi, axis=0))).max() < 1e-6


def test_timescales_of_counts(spark):
    n = np.round(slow(15, 0.3) * 1000)
    n[3, 14] = 0
    n = np.vstack([np.hstack([n, np.zeros((15, 1))]), np.r_[np.zeros(3), 5, np.zeros(12)]])  # a state that nothing leads to
    counts = edges_of(spark, n).withColumnRenamed("p", "n")
    got = spectral.timescales(counts, 2.0, 3)
    want = kn.timescales(n[:15, :15] / n[:15, :15].sum(axis=1, keepdims=True), 2.0, 3)
    assert np.allclose(got, want, rtol=1e-6, equal_nan=True)
