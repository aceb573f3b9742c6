import itertools

import numpy as np
import pytest
from echoframe.operators import estimate as e

RNG = np.random.default_rng(4)


def _speckle(n, m):
    z = np.fft.fft2(RNG.normal(size=(n, m)) + 1j * RNG.normal(size=(n, m)))
    z[np.abs(np.fft.fftfreq(n)) > 0.3] = 0
    z[:, np.abs(np.fft.fftfreq(m)) > 0.3] = 0
    return np.fft.ifft2(z)


def test_registration_recovers_a_shift():
    z = _speckle(128, 96)
    ramp = np.exp(-2j * np.pi * (np.fft.fftfreq(128) * 3.4)[:, None] + 2j * np.pi * (np.fft.fftfreq(96) * 2.25)[None])
    a, b = (np.log10(np.abs(v) ** 2 + 1e-3) for v in (z, np.fft.ifft2(np.fft.fft2(z) * ramp)))
    di, dj, score = e.displacement(a, b)
    assert di == pytest.approx(3.4, abs=0.15) and dj == pytest.approx(-2.25, abs=0.15) and score > 5
    assert e.displacement(a, np.log10(np.abs(_speckle(128, 96)) ** 2 + 1e-3))[2] < 6


def test_tiles(spark):
    z = _speckle(128, 128)
    a = np.log10(np.abs(z) ** 2 + 1e-3)
    b = np.roll(a, (2, -3), (0, 1))
    df = spark.createDataFrame([(i, j, float(a[i, j]), float(b[i, j])) for i in range(128) for j in range(100)], "i long, j long, a double, b double")
    rows = e.tile_shifts(df).collect()
    assert len(rows) == 2 and all(abs(r.di - 2) < 0.3 and abs(r.dj + 3) < 0.3 and r.z > 5 for r in rows)


def test_fringe():
    i, j = np.mgrid[:96, :80]
    x = np.exp(2j * np.pi * (0.04 * i - 0.11 * j)) + 1.5 * (RNG.normal(size=i.shape) + 1j * RNG.normal(size=i.shape))
    fi, fj, found = e.fringe(x)
    assert fi == pytest.approx(0.04, abs=2e-3) and fj == pytest.approx(-0.11, abs=2e-3) and found
    assert not e.fringe(RNG.normal(size=i.shape) + 1j * RNG.normal(size=i.shape))[2]


def test_map_drift():
    n = 256
    image = np.zeros((n, 60), np.complex128)
    image[RNG.integers(40, 216, 60), np.arange(60)] = 1
    k = np.fft.fftfreq(n) * 2
    blurred = np.fft.ifft(np.fft.fft(image, axis=0) * np.exp(1j * 30 * k**2)[:, None], axis=0)
    assert e.drift(blurred) == pytest.approx(30, abs=1.5)
    assert abs(e.drift(image)) < 1


def test_robust_surface():
    x, y = RNG.uniform(-1, 1, (2, 60))
    v = 1 + 2 * y - x + 0.5 * x * y
    v[:8] += 50
    assert np.allclose(e.surface(x, y, v), [1, 2, 0, -1, 0.5, 0], atol=1e-6)


def test_zero_doppler_point():
    p, v = np.array([7.0e6, 0, 0]), np.array([0, 7500.0, 0])
    height = lambda q: np.linalg.norm(q) - 6.371e6
    q = e.zero_doppler(p, v, 8e5, 1.0, height, 1000.0)
    assert np.linalg.norm(q - p) == pytest.approx(8e5) and (q - p) @ v == pytest.approx(0, abs=1e-3) and height(q) == pytest.approx(1000, abs=1e-3)


def test_splits_by_brute_force():
    for n, tile, levels in ((1000, 64, 3), (4096, 32, 3), (60, 64, 2), (700, 16, 2)):
        need = -(-n // tile)
        options = [f for k in range(levels + 1) for f in itertools.combinations_with_replacement(range(2, 9), k) if np.prod(f or (1,)) >= need]
        got = e.splits(n, tile, levels)
        assert np.prod(got or (1,)) >= need
        assert np.prod(got or (1,)) <= min([np.prod(f or (1,)) for f in options], default=need)
