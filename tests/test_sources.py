import numpy as np
import pytest
from echoframe import sources
from echoframe.sources import cphd, nitf, png
from echoframe.streaming.accumulate import running_sum, windowed_mean
from hypothesis import given, settings
from hypothesis import strategies as st

RNG = np.random.default_rng(8)


@pytest.fixture(scope="module")
def formats(spark):
    sources.register(spark)
    return spark


@pytest.fixture(scope="module")
def file(formats, tmp_path_factory):
    rows = [(p, [1.0 * p, 2.0, 3.0], [1.5 * p, 2.0, 3.0], [0.0, 0.0, p * 0.5], p * 0.01, 9e9, 1e6, RNG.normal(size=12).tolist(), RNG.normal(size=12).tolist()) for p in range(50)]
    df = formats.createDataFrame(rows, "p long, tx array<double>, rcv array<double>, srp array<double>, tx_time double, sc0 double, scss double, re array<double>, im array<double>")
    path = str(tmp_path_factory.mktemp("cphd") / "a.cphd")
    cphd.write(df, path)
    return path, rows


def test_phase_history_round_trip_and_ranges(formats, file):
    path, rows = file
    got = sources.read_collection(formats, path, rows=7).orderBy("p").collect()
    assert [(r.p, r.tx, r.rcv, r.srp, r.tx_time, r.sc0, r.scss) for r in got] == [r[:7] for r in rows]
    assert np.allclose([r.re for r in got], [r[7] for r in rows]) and np.allclose([r.im for r in got], [r[8] for r in rows])
    part = formats.read.format("cphd").option("pulses", "10:20").option("samples", "3:5").load(path).orderBy("p").collect()
    assert [r.p for r in part] == list(range(10, 20)) and part[0].sc0 == 9e9 + 3e6
    assert np.allclose(part[0].re, rows[10][7][3:5])
    assert formats.read.format("cphd").option("metadata", "true").load(path).filter("re is not null").count() == 0


@pytest.mark.parametrize("change", [lambda b: b"x" + b, lambda b: b[:3000], lambda b: b.replace(b"XML_BLOCK_SIZE := ", b"XML_BLOCK_SIZE := 9999"), lambda b: b.replace(b"\x0c\n", b"  "), lambda b: b.replace(b"CF8", b"QQ8"), lambda b: b.replace(b"<Data>", b"<Dat >"), lambda b: b.replace(b"PVP_BLOCK_SIZE := ", b"PVP_BLOCK_SIZE := -"), lambda b: b.replace(b"?><CPHD", b"?><!DOCTYPE a><CPHD"), lambda b: b.replace(b"<NumVectors>50", b"<NumVectors>5000")])
def test_hostile_files_are_refused_by_name(file, tmp_path, change):
    bad = tmp_path / "bad.cphd"
    bad.write_bytes(change(open(file[0], "rb").read()))
    with pytest.raises(ValueError, match="bad.cphd: "):
        cphd.layout(str(bad), 0)


def test_unreadable_kinds(formats):
    with pytest.raises(ImportError):
        sources.read_collection(formats, "a.h5")
    with pytest.raises(ValueError):
        sources.read_collection(formats, "a.xyz")


def test_complex_image_round_trip(formats, tmp_path):
    z = RNG.normal(size=(23, 9, 2)).astype(np.float32)
    df = formats.createDataFrame([(k, row[:, 0].tolist(), row[:, 1].tolist()) for k, row in enumerate(z)], "line long, re array<float>, im array<float>")
    path = str(tmp_path / "a.nitf")
    nitf.write(df, path, b"<SICD>x</SICD>", most_rows=10)
    got = formats.read.format("nitf").option("rows", 4).load(path).orderBy("line").collect()
    assert np.array_equal(np.array([np.column_stack([r.re, r.im]) for r in got], np.float32), z)
    assert sorted({r.segment for r in got}) == [0, 1, 2]
    assert nitf.read_layout(path)[1] == b"<SICD>x</SICD>"
    bad = tmp_path / "bad.nitf"
    data = open(path, "rb").read()
    for change in (data[:300], data[:-5], data.replace(b"NITF02.10", b"NITF02.00"), data.replace(b"NC2", b"C82"), data[:360] + b"0x3" + data[363:]):
        bad.write_bytes(change)
        with pytest.raises(ValueError, match="bad.nitf: "):
            nitf.read_layout(str(bad))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 9), st.sampled_from([1, 3, 4]), st.integers(0, 2**31))
def test_png_round_trip(rows, columns, channels, seed):
    pixels = np.random.default_rng(seed).integers(0, 256, (rows, columns, channels), dtype=np.uint8)
    assert np.array_equal(png.decode(png.encode(pixels), "x"), pixels)


def test_png_files(formats, tmp_path):
    values = RNG.integers(0, 256, (7, 11))
    df = formats.createDataFrame([(i, j, int(values[i, j])) for i in range(7) for j in range(11)], "i long, j long, value int")
    path = str(tmp_path / "a.png")
    png.write(df, path)
    got = formats.read.format("png").load(path).orderBy("i").collect()
    assert np.array_equal([r["values"] for r in got], values)
    for bad in (b"no", open(path, "rb").read()[:40], open(path, "rb").read().replace(b"IDAT", b"IDAX")):
        with pytest.raises(ValueError, match="x: "):
            png.decode(bad, "x")


def test_streams(formats, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", m % 2, 0, float(m), 1.0, -1.0) for m in range(20)]
    formats.createDataFrame(rows, "t string, i long, j long, p double, re double, im double").selectExpr("cast(t as timestamp) t", "i", "j", "p", "re", "im").write.parquet(f"{tmp_path}/in")
    stream = formats.readStream.schema("t timestamp, i long, j long, p double, re double, im double").parquet(f"{tmp_path}/in")
    for name, df, mode in (("means", windowed_mean(stream, "t", "10 minutes", "1 minute"), "append"), ("sums", running_sum(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r.i, r.p, r.n) for r in formats.table("means").collect()) == [(0, 4.0, 5), (1, 5.0, 5)]
    assert sorted((r.i, r.re, r.im) for r in formats.table("sums").collect()) == [(0, 10.0, -10.0), (1, 10.0, -10.0)]
