"""Patches, maps, scenes and records against direct sums, round trips and plain versions."""

import struct

import numpy as np
import pytest
from echoframe.operators import focus, geometry, maps, patches, scenes
from echoframe.sources import records
from pyspark.sql import functions as F

from .test_focus import _pulses, _spotlight, _stripmap
from .test_lines import _array, _lines

C = 299792458.0
RNG = np.random.default_rng(21)


def test_mosaic_sums_each_patch_over_its_pulses(spark):
    ant, s, f = _spotlight(n=24, k=12)
    grid = focus.Grid(20, 12, 1.0, 1.0)
    spans = spark.createDataFrame([(0, 0, 0, 15), (1, 0, 5, 23), (2, 0, 3, 4)], "ti long, tj long, first long, last long")
    got = {(r.i, r.j): complex(r.re, r.im) for r in patches.mosaic(_pulses(spark, ant, s), spans, grid, fmin=f[0], df=f[1] - f[0], patch=8, run=7).collect()}
    assert len(got) == 20 * 8
    for i, j in ((0, 0), (9, 7), (19, 3)):
        lo, hi = [(0, 15), (5, 23), (3, 4)][i // 8]
        x = grid.points(np.array(float(i)), np.array(float(j)))
        dr = np.linalg.norm(x - ant[lo : hi + 1], axis=1) - np.linalg.norm(ant[lo : hi + 1], axis=1)
        assert got[i, j] == pytest.approx((s[lo : hi + 1] * np.exp(4j * np.pi / C * dr[:, None] * f)).sum(), abs=1e-6)


def test_time_domain_sum_peaks_at_the_target(spark):
    data, p = _stripmap()
    n = len(data)
    pulses = spark.createDataFrame([(k, 0.0, (k - n / 2) / p["prf"] * p["speed"], 0.0) for k in range(n)], "p long, ax double, ay double, az double")
    points = spark.createDataFrame([(i * 9 + j, 5000.0 + (j - 4) * 1.0, (i - 4) * 0.5, 0.0) for i in range(9) for j in range(9)], "id long, x double, y double, z double")
    start = 2 * p["r0"] / C - data.shape[1] / 2 / p["fs"]
    got = {r.id: abs(complex(r.re, r.im)) for r in patches.time_domain(_lines(spark, data), pulses, points, fs=p["fs"], fc=p["fc"], start=start, beam=0.01).collect()}
    seen = (np.abs((np.arange(n) - n / 2) / p["prf"]) < 0.18).sum()  # all pulses of the strip that hold an echo
    assert max(got, key=got.get) == 4 * 9 + 4 and got[40] == pytest.approx(seen, rel=0.05)


def test_quadratic_phase_by_sets_and_blocks(spark):
    n = 128
    image = np.zeros((n, 64), np.complex128)
    image[RNG.integers(20, 108, 64), np.arange(64)] = 1
    k = np.fft.fftfreq(n) * 2
    blurred = np.fft.ifft(np.fft.fft(image, axis=0) * np.exp(1j * 20 * k**2)[:, None], axis=0)
    out, phase = patches.quadratic_autofocus(_lines(spark, blurred.T), sets=4)
    assert phase == pytest.approx(20, abs=2.5)
    assert np.abs(_array(out)).max() > 2 * np.abs(blurred).max()
    blocks = spark.createDataFrame([(i, j, float(blurred[i, j].real), float(blurred[i, j].imag)) for i in range(n) for j in range(64)], "i long, j long, re double, im double")
    found, surface = patches.phase_surface(blocks, block=64)
    assert found.count() == 2 and len(surface) >= 1
    with pytest.raises(ValueError):
        patches.focus_stripmap(None, 1, "none")


def test_geolocation_keeps_range_and_doppler(spark):
    a, v = np.array([7.0e6, 0, 2e5]), np.array([100.0, 7500.0, 50.0])
    p = np.array([[6.378e6 + d, 4e3 * d / 100, -5e5 + d] for d in (0.0, 100.0, 900.0)])
    df = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "id long, x double, y double, z double")
    for r in maps.geolocate(df, tuple(a), tuple(v), 200.0).collect():
        q = np.array([r.x, r.y, r.z])
        assert np.linalg.norm(q - a) == pytest.approx(np.linalg.norm(p[r.id] - a), rel=1e-12) and (q - a) @ v == pytest.approx((p[r.id] - a) @ v, rel=1e-9)
        assert maps._height(q[None])[0] == pytest.approx(200.0, abs=1e-2)


def test_maps_tiles_and_gains(spark):
    grid = maps.map_grid(spark, 10.0, 20.0, 0.5, 4, 5)
    image = spark.range(100).select(F.floor(F.col("id") / 10).alias("i"), (F.col("id") % 10).alias("j"), (F.floor(F.col("id") / 10) * 2.0 + F.col("id") % 10).alias("v"))
    from echoframe.functions import geodesy as g

    def to_pixel(p):
        lat, lon, _ = g.to_geodetic(p)
        return (lat - 9.5) * 2, (lon - 20.0) * 2

    got = {r.id: r.v for r in maps.geocode(image, "v", grid, to_pixel).collect()}
    assert all(got[k] == pytest.approx(2.0 * (k // 5 + 1) + k % 5, abs=1e-5) for k in got if got[k] is not None) and sum(v is not None for v in got.values()) >= 16
    tiles = spark.createDataFrame([(1, 0, 0, 5.0), (0, 0, 0, None), (2, 0, 0, 7.0), (2, 0, 1, 8.0), (1, 0, 1, float("nan"))], "tile int, i long, j long, h double")
    assert sorted(map(tuple, maps.merged_tiles(tiles).collect())) == [(0, 0, 5.0), (0, 1, 8.0)]
    table = image.select("i", "j", F.col("v").alias("gain"))
    points = spark.createDataFrame([(0, 0.25, -0.9), (1, 9.0, 0.0)], "id long, u double, v double")
    assert sorted(map(tuple, maps.gain(table, points, (0.0, -1.0), (0.1, 0.2)).collect())) == [(0, pytest.approx(2.5 * 2 + 0.5)), (1, None)]
    x, y, z = spark.range(1).select(*maps.boresight(F.lit(0.0), F.lit(0.0), F.lit(0.0))).first()
    assert (x, y, z) == pytest.approx((0, 0, -1))
    frame = geometry.slant_frame((0.0, 0.0, 0.0), (-8000.0, 0.0, 5000.0), (0.0, 100.0, 0.0))
    flat = spark.range(400).select((F.floor(F.col("id") / 20)).alias("i"), (F.col("id") % 20).alias("j"), F.lit(3.0).alias("re"), F.lit(-1.0).alias("im"))
    out = maps.to_plane(flat, frame, (-10.0, -10.0, 1.0, 1.0), (0.5, 0.5), (6, 6), (-1.0, -1.0)).collect()
    assert len(out) == 36 and all((r.re, r.im) == pytest.approx((3.0, -1.0)) for r in out if r.re is not None) and any(r.re is not None for r in out)


def test_scenes(spark):
    t = scenes.track(spark, 5, resolution=0.5, r0=1e4, graze=30.0, fc=9.6e9).orderBy("p").collect()
    assert t[0].ay == pytest.approx(-t[4].ay) and t[2].ay == pytest.approx(0) and np.hypot(t[2].ax, t[2].az) == pytest.approx(1e4)
    turn = 2 * np.arctan(t[4].ay / -t[4].ax)
    assert C / 9.6e9 / (2 * turn * np.cos(np.radians(30))) == pytest.approx(0.5, rel=1e-6)
    fmin, step = scenes.band(0.5, 30.0, 9.6e9, 101)
    assert fmin + 50 * step == pytest.approx(9.6e9) and scenes.points(spark, 3, 2.0).agg(F.sum("x"), F.max("y")).first() == (0.0, 2.0)
    c = scenes.clutter(spark, 20000, 100.0)
    row = c.agg(F.avg("amp"), F.stddev("amp"), F.min("x"), F.max("x")).first()
    assert abs(row[0]) < 0.05 and row[1] == pytest.approx(1, abs=0.05) and -50 <= row[2] < -49 < 49 < row[3] <= 50
    assert sorted(scenes.clutter(spark, 50, 1.0).collect()) == sorted(scenes.clutter(spark, 50, 1.0).repartition(3).collect())
    have = {r.name: r.version for r in scenes.capabilities(spark).collect()}
    assert have["spark"] == spark.version and have["numpy"] == np.__version__
    with pytest.raises(ImportError, match="reading needs no_such_module"):
        scenes.require("no_such_module", "reading")
    assert scenes.block_rows(100, 2, 1 << 20, 4) == int((1 << 20) * 0.5 / 4 / 200)
    with pytest.warns(ResourceWarning):
        assert scenes.block_rows(1 << 30, 2, 1 << 20, 4) == 1


def test_records_metadata_and_rasters(spark, tmp_path):
    body = b"".join(struct.pack(">i4si", k, bytes([1, 2, 3, k]), 12 + 8) + f"{k * 1.5:8.2f}".encode() for k in range(1, 4))
    (tmp_path / "LED").write_bytes(body)
    files = spark.read.format("binaryFile").load(str(tmp_path / "LED"))
    got = records.ceos_records(files).orderBy("number").collect()
    assert [(r.number, r.at, r.length, bytes(r.kind)) for r in got] == [(k, (k - 1) * 20, 20, bytes([1, 2, 3, k])) for k in (1, 2, 3)]
    assert files.select(records.fixed_field("content", 12, 8), records.fixed_field("content", 0, 4)).first()[0] == 1.5
    (tmp_path / "bad").write_bytes(body[:-3])
    with pytest.raises(Exception, match="bad: "):
        records.ceos_records(spark.read.format("binaryFile").load(str(tmp_path / "bad"))).collect()
    xml = records.image_metadata((20, 30), (0.5, 0.6), (0.7, 0.8), (9e9, 9.6e9), (1.0, 2.0, 3.0), (4.0, 5.0, 6.0), "x")
    tree = records.metadata_tree(xml)
    assert tree["namespace"] == "urn:SICD:1.3.0" and tree["SICD"]["Grid"]["Col"]["SS"] == "0.5" and tree["SICD"]["ImageData"]["NumCols"] == "20"
    rows = {r.name: r.value for r in records.metadata_rows(spark, xml).collect()}
    assert rows["SICD.SCPCOA.ARPPos.Z"] == "6.0" and rows["SICD.Grid.Row.ImpRespWid"] == "0.8"
    with pytest.raises(ValueError, match="entities"):
        records.metadata_tree(b"<!DOCTYPE a><a/>")
    pixels = spark.createDataFrame([(i, j, float(i * 10 + j)) for i in range(3) for j in range(4) if (i, j) != (1, 2)], "i long, j long, v double")
    path = tmp_path / "a.tif"
    records.write_geotiff(pixels, "v", str(path), (10.0, 20.0), (0.5, 0.25))
    raw = path.read_bytes()
    count = struct.unpack("<H", raw[8:10])[0]
    tags = {t: (k, n, v) for t, k, n, v in (struct.unpack("<HHII", raw[10 + 12 * x : 22 + 12 * x]) for x in range(count))}
    image = np.frombuffer(raw, "<f4", 12, tags[273][2]).reshape(3, 4)
    assert image[0].tolist() == [20, 21, 22, 23] and np.isnan(image[1, 2]) and (tags[256][2], tags[257][2]) == (4, 3)
    assert struct.unpack("<6d", raw[tags[33922][2] : tags[33922][2] + 48])[3:5] == (20.0, 11.5)
    records.write_raster(pixels, str(tmp_path / "r"), crs="EPSG:4326", origin=[10, 20])
    assert spark.read.parquet(str(tmp_path / "r")).count() == 11 and "EPSG" in spark.read.text(str(tmp_path / "r.json")).first()[0]
