"""Echoes, areas and the chain from files to products, by brute force and round trips."""

import numpy as np
import pytest
from echoframe import sources
from echoframe.operators import areas, chain, echo
from echoframe.sources import cphd, nitf
from pyspark.sql import functions as F

from .test_lines import _array, _lines

C = 299792458.0
RNG = np.random.default_rng(12)
TARGETS = np.array([[0, 0, 0], [10, -8, 0], [-12, 9, 0.0]])


def _write(spark, path, shift=(0.0, 0.0, 0.0), sgn=-1, n=48, k=40):
    """A spotlight file about a point on the equator: x across (azimuth), y up the look, z away from the Earth."""
    origin = np.array([6378137.0, 0, 0])
    axes = np.array([[0, 1.0, 0], [0, 0, 1.0], [1.0, 0, 0]])  # local x, y, z in Earth-fixed axes
    ant = np.stack([(np.arange(n) - n / 2) * 4.0, np.full(n, -8000.0), np.full(n, 5000.0)], 1)
    f = 9.4e9 + np.arange(k) * 3e6
    dr = np.linalg.norm((TARGETS + shift)[None] - ant[:, None], axis=-1) - np.linalg.norm(ant, axis=1)[:, None]
    s = np.exp(-4j * np.pi / C * dr[..., None] * f).sum(1)
    s = s if sgn < 0 else s.conj()
    place = lambda a: (origin + a @ axes).tolist()
    rows = [(p, place(ant[p]), place(ant[p]), origin.tolist(), p * 0.01, 9.4e9, 3e6, s[p].real.tolist(), s[p].imag.tolist()) for p in range(n)]
    cphd.write(spark.createDataFrame(rows, "p long, tx array<double>, rcv array<double>, srp array<double>, tx_time double, sc0 double, scss double, re array<double>, im array<double>"), path)
    if sgn > 0:
        raw = open(path, "rb").read()
        open(path, "wb").write(raw.replace(b"<SGN>-1</SGN>", b"<SGN>+1</SGN>"))


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    sources.register(spark)
    folder = tmp_path_factory.mktemp("chain")
    _write(spark, f"{folder}/a.cphd")
    _write(spark, f"{folder}/b.cphd", (3.0, -2.0, 0.0))
    _write(spark, f"{folder}/c.cphd", sgn=1)
    return folder


def _image(df, shape):
    z = np.zeros(shape, complex)
    for r in df.collect():
        z[r.i, r.j] = complex(r.re, r.im)
    return z


@pytest.mark.parametrize("name", ["a", "c"])
def test_a_file_becomes_an_image(spark, files, name):
    """Targets appear where they are, for both phase signs."""
    image, scene, grid = chain.form_file(spark, f"{files}/{name}.cphd", (48, 48), (1.0, 1.0), algorithm="exact")
    z = np.abs(_image(image, (48, 48)))
    assert 0.5 < scene.resolution[0] < 3 and 0.5 < scene.resolution[1] < 3
    for x, y, _ in TARGETS:
        assert z[24 + int(x), 24 + int(y)] > 0.8 * z.max()


def test_products(spark, files, tmp_path):
    image = chain.process(spark, f"{files}/a.cphd", str(tmp_path / "a.png"), (32, 32), spacing=(1.0, 1.0), weighting="sva")
    back = {r.i: r["values"] for r in spark.read.format("png").load(str(tmp_path / "a.png")).collect()}
    assert len(back) == 32 and max(max(v) for v in back.values()) == 255 and image.count() == 1024
    chain.process(spark, f"{files}/a.cphd", str(tmp_path / "a.nitf"), (32, 24), spacing=(1.0, 1.0), product="nitf")
    assert sum(s.rows for s in nitf.read_layout(str(tmp_path / "a.nitf"))[0]) == 32
    for wrong in ({"product": "x"}, {"weighting": "x"}):
        with pytest.raises(ValueError):
            chain.process(spark, f"{files}/a.cphd", str(tmp_path / "b"), (8, 8), spacing=(1.0, 1.0), **wrong)


def test_a_quick_look_reads_what_its_pixels_need(spark, files, tmp_path):
    pulses, samples = chain.quicklook(spark, f"{files}/a.cphd", str(tmp_path / "q.png"), size=16, extent=64.0)
    assert pulses < 48 and samples < 40 and spark.read.format("png").load(str(tmp_path / "q.png")).count() == 16


def test_stacks(spark, files):
    mean = chain.process_stack(spark, [f"{files}/a.cphd", f"{files}/a.cphd"], (24, 24), (1.0, 1.0), registered=False)
    assert mean.count() == 576
    same = chain.process_stack(spark, [f"{files}/a.cphd", f"{files}/a.cphd"], (24, 24), (1.0, 1.0), product="interferogram", registered=False)
    assert same.agg(F.max(F.abs("phase")), F.min("coherence")).first() == pytest.approx((0, 1), abs=1e-6)
    with pytest.raises(ValueError):
        chain.process_stack(spark, [f"{files}/a.cphd"], (8, 8), (1.0, 1.0))


def test_displaced_images_are_found_and_moved_back(spark):
    z = np.fft.ifft2(np.where(np.abs(np.fft.fftfreq(64))[:, None] + np.abs(np.fft.fftfreq(64)) < 0.35, np.fft.fft2(RNG.normal(size=(64, 64)) + 1j * RNG.normal(size=(64, 64))), 0))
    moved = np.roll(z, (2, -3), (0, 1))
    df = lambda a: spark.createDataFrame([(i, j, float(a[i, j].real), float(a[i, j].imag)) for i in range(64) for j in range(64)], "i long, j long, re double, im double")
    pair = df(z).selectExpr("i", "j", "re as ar", "im as ai").join(df(moved).selectExpr("i", "j", "re as br", "im as bi"), ["i", "j"])
    by = chain.register(pair)
    assert by == pytest.approx((2, -3), abs=0.3)
    back = _image(chain.displaced(df(moved), -2.0, 3.0), (64, 64))
    assert np.allclose(back[4:-4, 4:-4], z[4:-4, 4:-4], atol=1e-9)


def test_cphd_channels_support_and_trim(spark, files, tmp_path):
    path = f"{files}/a.cphd"
    assert cphd.layout(path, "1").channel == "1" and not cphd.layout(path, 0).conjugate and cphd.layout(f"{files}/c.cphd", 0).conjugate
    with pytest.raises(ValueError, match="no channel HV"):
        cphd.layout(path, "HV")
    with pytest.raises(ValueError, match="no support array"):
        cphd.support(path, "gain")
    raw = bytearray(open(path, "rb").read())
    x = cphd.layout(path, 0)
    for p in (0, 1, 20, 47):
        at = x.record_at + p * x.record.itemsize + x.record.fields["TxPos"][1]
        raw[at : at + 8] = np.array([np.nan], ">f8").tobytes()
    bad = tmp_path / "bad.cphd"
    bad.write_bytes(bytes(raw))
    got = {r.p: r for r in spark.read.format("cphd").option("trim", "true").option("rows", 7).load(str(bad)).collect()}
    want = {r.p: r for r in spark.read.format("cphd").load(path).collect()}
    assert sorted(got) == list(range(2, 47))
    assert all(got[p].re == want[p].re and np.allclose(got[p].tx, want[p].tx) for p in got)


def test_regions_by_brute_force(spark):
    mask = RNG.random((40, 50)) < 0.55
    df = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(mask))], "i long, j long")
    label, got = {}, {(r.i, r.j): r.region for r in areas.regions(df).collect()}
    for start in sorted(got):
        if start not in label:
            todo = [start]
            while todo:
                i, j = todo.pop()
                if (i, j) in got and (i, j) not in label:
                    label[i, j] = start[0] * (1 << 31) + start[1]
                    todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
    assert got == label
    assert areas.regions(df.limit(0)).count() == 0


def test_chebyshev_series(spark):
    x = np.linspace(-1, 1, 60)
    y = 2 + x + 0.4 * x**3
    order, c = areas.chebyshev_fit(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), F.col("x"), F.col("y"), within=0.01)
    assert order == 3 and np.allclose(np.polynomial.chebyshev.chebval(x, c), y, rtol=1e-3)


def test_spectra_grids_and_delays(spark):
    z = RNG.normal(size=(9, 32)) + 1j * RNG.normal(size=(9, 32))
    spectrum = np.fft.fft(z, axis=1)
    spectrum[:, 10:20] *= 0.01
    df = _lines(spark, np.fft.ifft(spectrum, axis=1))
    energy = {r.b: r.energy for r in echo.mean_spectrum(df).collect()}
    assert np.allclose([energy[b] for b in range(32)], (np.abs(spectrum) ** 2).mean(0))
    assert 12 <= echo.spectral_gap(df, 32).first().gap <= 17
    first, count = echo.occupied_band(df, 32)
    assert 19 <= first <= 21 and 20 <= count <= 23
    grid = np.arange(32) * 2e6 + 9e9
    tone = np.exp(2j * np.pi * np.arange(40) * 0.07)
    same = _array(echo.regrid_frequency(_lines(spark, tone[None]), lambda _: 9e9 - 8e6, lambda _: 2e6, grid[6:20]))[0]
    assert np.allclose(same, tone[10:24], atol=1e-3)
    t = np.sort(RNG.uniform(0, 10, 30))
    cubic = np.stack([t**2, 1 - t], 1)
    assert np.allclose(_array(echo.regrid_pulses(_lines(spark, cubic), t, np.linspace(1, 9, 12))).real, np.stack([np.linspace(1, 9, 12) ** 2, 1 - np.linspace(1, 9, 12)], 1), atol=1e-6)
    replica = np.exp(1j * np.pi * np.arange(16) ** 2 / 20)
    late = np.zeros((1, 64), complex)
    late[0, 21:37] = replica
    assert echo.internal_delay(_lines(spark, late), replica, 10.0).first().delay == pytest.approx(2.1, abs=0.01)
    level = echo.noise_level(_lines(spark, z[:8]), 4).first()
    power = np.abs(np.fft.fft(np.fft.ifft(z[:8], axis=1), axis=0)) ** 2
    cells = power.reshape(4, 2, 4, 8).mean((1, 3))
    assert (level.noise, level.clutter) == pytest.approx((cells.min(), cells.max()))


def test_frequency_samples_of_an_echo(spark):
    fs, fc, n = 1e8, 9.6e9, 64
    delay, start, reference = 3.1e-7, 0.0, 3e-7
    t = np.arange(n) / fs
    rc = np.sinc(6e7 * (t - delay)) * np.exp(-2j * np.pi * fc * delay)
    out = _array(echo.to_history(_lines(spark, rc[None]), fs=fs, fc=fc, start=start, band=4e7, reference=lambda _: reference))[0]
    f = np.fft.fftshift(np.fft.fftfreq(n, 1 / fs))
    f = f[np.abs(f) <= 2e7]
    want = np.exp(-2j * np.pi * (fc + f) * (delay - reference))
    assert np.abs(np.angle(out / want)).max() < 0.2
