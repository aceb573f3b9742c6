"""Image formation by transforms and factors against direct sums and known places of targets."""

import numpy as np
import pytest
from echoframe.operators import focus, lines

from .test_lines import _array, _lines

C = 299792458.0
RNG = np.random.default_rng(11)


def _spotlight(n=64, k=48, fmin=9.4e9, df=3e6, step=3.0):
    ant = np.stack([np.full(n, -8000.0), (np.arange(n) - n / 2) * step, np.full(n, 5000.0)], 1)
    pos, amp = np.array([[0, 0, 0], [9, -6, 0], [-12, 10, 0.0]]), np.array([1, 0.8, 0.6])
    dr = np.linalg.norm(pos[None] - ant[:, None], axis=-1) - np.linalg.norm(ant, axis=1)[:, None]
    f = fmin + np.arange(k) * df
    return ant, (amp[None, :, None] * np.exp(-4j * np.pi / C * dr[..., None] * f)).sum(1), f


def _pulses(spark, ant, s):
    return spark.createDataFrame([(p, *map(float, a), z.real.tolist(), z.imag.tolist()) for p, (a, z) in enumerate(zip(ant, s))], "p long, ax double, ay double, az double, re array<double>, im array<double>")


@pytest.mark.parametrize("algorithm", ["factorized", "profiles", "exact"])
def test_formation_by_name_matches_the_direct_sum(spark, algorithm):
    ant, s, f = _spotlight()
    grid = focus.Grid(40, 36, 1.0, 1.0)
    options = {"factorized": {"tile": 8}, "profiles": {"upsample": 32, "tile": 16}, "exact": {}}[algorithm]
    got = np.zeros((40, 36), complex)
    for r in focus.form(_pulses(spark, ant, s), grid, fmin=f[0], df=f[1] - f[0], k=len(f), algorithm=algorithm, **options).collect():
        got[r.i, r.j] = complex(r.re, r.im)
    i, j = np.mgrid[:40, :36]
    x = grid.points(i, j).reshape(-1, 3)
    dr = np.linalg.norm(x[None] - ant[:, None], axis=-1) - np.linalg.norm(ant, axis=1)[:, None]
    want = sum(np.exp(4j * np.pi / C * np.outer(dr[p], f)) @ s[p] for p in range(len(ant))).reshape(40, 36)
    assert 20 * np.log10(np.linalg.norm(got - want) / np.linalg.norm(want)) < {"factorized": -30, "profiles": -45, "exact": -180}[algorithm]
    with pytest.raises(ValueError):
        focus.form(None, grid, fmin=1, df=1, k=1, algorithm="none")


def _stripmap():
    fc, fs, prf, v, r0, n, m = 9.6e9, 120e6, 600.0, 200.0, 5000.0, 256, 96
    eta = (np.arange(n) - n / 2) / prf
    r = np.sqrt(r0**2 + (v * eta) ** 2)
    t = np.arange(m) / fs
    data = np.sinc(80e6 * (t[None] - m / 2 / fs - 2 * (r - r0)[:, None] / C)) * np.exp(-4j * np.pi * fc / C * r)[:, None] * (np.abs(eta) < 0.18)[:, None]
    return data, {"fc": fc, "fs": fs, "prf": prf, "speed": v, "r0": r0}


@pytest.mark.parametrize("name", ["omega_k", "range_doppler"])
def test_stripmap_focuses_a_point(spark, name):
    data, p = _stripmap()
    out = np.abs(_array(getattr(focus, name)(_lines(spark, data).repartition(4), len(data), **p)))
    peak = np.unravel_index(out.argmax(), out.shape)
    assert out.shape == data.shape and abs(peak[0] - 128) <= 1 and abs(peak[1] - 48) <= 1
    assert out.max() > 20 * np.median(out) and out.max() > 3 * np.abs(data).max()
    if name == "omega_k":
        assert np.allclose(out, np.abs(lines.omega_k(data, **p)), atol=1e-6 * out.max())


def test_polar_format_places_targets(spark):
    ant, s, f = _spotlight(n=96, k=64, df=4e6, step=6.0)
    image, da, dr = focus.polar_format(_pulses(spark, ant, s), fmin=f[0], df=f[1] - f[0], k=64, count=96)
    out = np.abs(_array(image))
    assert out.shape == (96, 64)
    for x, y in ((0, 0), (9, -6), (-12, 10)):
        i, j = 48 + round(y / da), 32 + round(x / dr)
        near = out[i - 2 : i + 3, j - 2 : j + 3]
        assert near.max() > 8 * np.median(out)


def test_distributed_phase_gradient(spark):
    n = 128
    image = np.zeros((n, 40), np.complex128)
    image[RNG.integers(30, 98, 40), np.arange(40)] = 1
    k = np.arange(n) - n / 2
    error = 3 * (2 * k / n) ** 2 + 0.8 * np.cos(2 * np.pi * 2 * k / n)
    blurred = np.fft.ifft(np.fft.ifftshift(np.fft.fftshift(np.fft.fft(image, axis=0), axes=0) * np.exp(1j * error)[:, None], axes=0), axis=0)
    out, found = focus.phase_gradient(_lines(spark, blurred.T).repartition(3), n, iterations=6)
    rest = error - found
    rest -= np.polyval(np.polyfit(k, rest, 1), k)
    assert np.sqrt(np.mean(rest**2)) < 0.2
    sharp = lambda z: (np.abs(z) ** 4).sum() / (np.abs(z) ** 2).sum() ** 2
    assert sharp(_array(out)) > 1.5 * sharp(blurred)
