import itertools

import numpy as np
import pytest
from echoframe.operators import formation, lines, signal
from pyspark.sql import functions as F

RNG = np.random.default_rng(5)


def _lines(spark, z):
    return spark.createDataFrame([(k, row.real.tolist(), row.imag.tolist()) for k, row in enumerate(z)], lines.SCHEMA)


def _array(df):
    return np.array([np.array(r.re) + 1j * np.array(r.im) for r in df.orderBy("line").collect()])


@pytest.fixture(scope="module")
def noise():
    return RNG.normal(size=(6, 40)) + 1j * RNG.normal(size=(6, 40))


def test_corner_turn_and_pixels(spark, noise):
    df = _lines(spark, noise)
    assert np.array_equal(_array(lines.corner_turn(df)), noise.T)
    assert np.array_equal(_array(lines.to_lines(lines.to_pixels(df))), noise)


def test_range_compression_is_correlation(spark, noise):
    replica = RNG.normal(size=9) + 1j * RNG.normal(size=9)
    want = [[sum(z[k + m] * np.conj(replica[m]) for m in range(9) if k + m < 40) for k in range(40)] for z in noise]
    assert np.allclose(_array(lines.range_compress(_lines(spark, noise), replica)), want)


def test_resampling_and_shift_of_band_limited_lines(spark):
    n, t = 64, np.arange(64)
    tone = lambda x: np.exp(2j * np.pi * 5 * x / n) + 0.5 * np.exp(-2j * np.pi * 11 * x / n)
    df = _lines(spark, tone(t)[None])
    at = np.linspace(10, 50, 33) + 0.3
    assert np.abs(_array(lines.resample(df, lambda _: at))[0] - tone(at)).max() < 2e-3
    assert np.allclose(_array(lines.shift(df, 0.37))[0], tone(t - 0.37))
    assert np.allclose(_array(lines.band_limit(df, 2 * 6 / n))[0], np.exp(2j * np.pi * 5 * t / n))


def test_spline_reproduces_cubics_and_percentile(spark):
    t = np.sort(RNG.uniform(0, 9, 12))
    cubic = lambda x: 1 + x - 0.3 * x**2 + 0.05 * x**3
    x = np.linspace(0, 9, 50)
    assert np.allclose(lines.not_a_knot(t, cubic(t))(x), cubic(x))
    v = RNG.gamma(2, size=3000)
    got = lines.spline_percentile(spark.createDataFrame([(float(a),) for a in v], "v double"), "v", 99)
    whole = lines.not_a_knot(np.arange(3000.0), np.sort(v))(np.array([0.99 * 3000 - 0.5]))[0]
    assert got == pytest.approx(whole, rel=1e-9)


def test_windows():
    for kind in ("uniform", "hann", "hamming", "kaiser", "taylor"):
        w = lines.window(kind, 65)
        assert np.allclose(w, w[::-1]) and w.argmax() == 32 or kind == "uniform"
    assert lines.window("taylor", 200).mean() == pytest.approx(1, abs=1e-3)
    assert lines.half_power_width(lines.window("uniform", 256)) == pytest.approx(0.886, abs=2e-3)
    with pytest.raises(ValueError):
        lines.window("none", 4)


def test_smooth_sizes():
    for n in (1, 2, 7, 11, 97, 1000, 1025):
        best = min(2**a * 3**b * 5**c for a, b, c in itertools.product(range(12), range(8), range(6)) if 2**a * 3**b * 5**c >= n)
        assert lines.smooth_size(n) == best


def test_image_formation_matches_direct_sum(spark):
    fmin, df, k, n = 9.4e9, 2.5e6, 32, 24
    ant = np.stack([np.full(n, -8000.0), (np.arange(n) - n / 2) * 4.0, np.full(n, 5000.0)], 1)
    pos, amp = np.array([[0, 0, 0], [6, -4, 0], [-8, 3, 0.0]]), np.array([1, 0.7, 0.5])
    s = spark.createDataFrame([(*map(float, p), float(a)) for p, a in zip(pos, amp)], "x double, y double, z double, amp double")
    pulses = spark.createDataFrame([(i, *map(float, a)) for i, a in enumerate(ant)], "p int, ax double, ay double, az double")
    history = formation.simulate(s, pulses, fmin, df, k)
    per_pulse = lines.to_lines(history.withColumnRenamed("p", "i").withColumnRenamed("k", "j")).withColumnRenamed("line", "p").join(pulses, "p")
    got = {(r.i, r.j): r.re + 1j * r.im for r in formation.form_image(per_pulse, fmin=fmin, df=df, nx=24, ny=20, spx=1.0, spy=1.0, tile=16, upsample=32).collect()}
    points = spark.createDataFrame([(i * 20 + j, float(i - 12), float(j - 10), 0.0) for i in range(24) for j in range(20)], "id long, x double, y double, z double")
    want = {divmod(r.id, 20): r.re + 1j * r.im for r in formation.backproject(history, pulses, points, fmin, df).collect()}
    a, b = np.array([got[q] for q in sorted(want)]), np.array([want[q] for q in sorted(want)])
    assert 20 * np.log10(np.linalg.norm(a - b) / np.linalg.norm(b)) < -45
    assert max(want, key=lambda q: abs(want[q])) == (12, 10)


def test_autofocus_and_point_target():
    n = 128
    image = np.zeros((n, 40), np.complex128)
    image[RNG.integers(30, 98, 40), np.arange(40)] = 1
    k = np.arange(n) - n / 2
    error = 3 * (2 * k / n) ** 2 + 0.8 * np.cos(2 * np.pi * 2 * k / n)
    blurred = np.fft.ifft(np.fft.ifftshift(np.fft.fftshift(np.fft.fft(image, axis=0), axes=0) * np.exp(1j * error)[:, None], axes=0), axis=0)
    found = lines.phase_gradient(blurred)
    rest = error - found
    rest -= np.polyval(np.polyfit(k, rest, 1), k)
    assert np.sqrt(np.mean(rest**2)) < 0.15
    x = np.arange(64)
    spot = np.outer(np.sinc((x - 30.25) / 2), np.sinc((x - 33.5) / 3))
    got = lines.point_target(spot, 30, 33)
    assert got["i"] == pytest.approx(30.25, abs=0.07) and got["width_j"] == pytest.approx(0.886 * 3, rel=0.05)


def test_omega_k_focuses_a_point():
    fc, fs, prf, v, r0, n, m = 9.6e9, 120e6, 600.0, 200.0, 5000.0, 512, 128
    eta = (np.arange(n) - n / 2) / prf
    r = np.sqrt(r0**2 + (v * eta) ** 2)
    t = np.arange(m) / fs
    data = np.sinc(80e6 * (t[None] - m / 2 / fs - 2 * (r - r0)[:, None] / 299792458.0)) * np.exp(-4j * np.pi * fc / 299792458.0 * r)[:, None] * (np.abs(eta) < 0.3)[:, None]
    out = np.abs(lines.omega_k(data, fc=fc, fs=fs, prf=prf, speed=v, r0=r0))
    peak = np.unravel_index(out.argmax(), out.shape)
    assert abs(peak[0] - n // 2) <= 1 and abs(peak[1] - m // 2) <= 1
    assert out.max() > 20 * np.median(out) and out.max() > 3 * np.abs(data).max()


def test_buckets_by_brute_force():
    counts = [100, 300, 310, 900, 905, 2000]
    need = sorted({256 * -(-c // 256) for c in counts})
    cost = lambda s: 0.7 * len(s) + sum(min(b for b in s if b >= 256 * -(-c // 256)) / (256 * -(-c // 256)) - 1 for c in counts)
    best = min(cost(s) for k in range(1, len(need) + 1) for s in itertools.combinations(need, k) if s[-1] == need[-1])
    assert cost(lines.buckets(counts, 0.7)) == pytest.approx(best)


def test_decimator_passes_its_band(spark):
    taps = signal.kaiser_decimator(4, 0.6)
    assert sum(taps) == pytest.approx(1)
    h = np.abs(np.fft.fft(taps, 4096))
    assert np.abs(h[: int(4096 * 0.6 / 8)] - 1).max() < 0.01 and h[int(4096 * 1.4 / 8) : 2048].max() < 0.01
    assert spark.range(1).select(F.lit(1)).count() == 1
