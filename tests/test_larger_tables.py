"""Queries that larger tables stopped: their whole results by brute force, and how their work is spread."""

import numpy as np
import pyarrow as pa
import pytest
from echoframe.plans import catalog
from pyspark import TaskContext
from pyspark.sql import functions as F

QUERIES = catalog.load()[0]
RNG = np.random.default_rng(5)


def _tasks(df) -> int:
    """Tasks that give rows."""
    return df.select(F.spark_partition_id().alias("t")).distinct().count()


@pytest.fixture
def folder(spark, tmp_path):
    def put(**tables):
        for name, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def test_block_starts_are_spread_and_whole(spark, folder):
    keys = [*range(60, 230), 140_000, 262_208]
    d = folder(part=spark.createDataFrame([(k,) for k in keys], "p_partkey long"))
    out = QUERIES["block_starts"](spark, d)
    want = {(n, min(s, n - 64)) for n in keys if n >= 64 for s in range(0, n - 32, 32)}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    assert _tasks(out) > 1


def test_image_segments_are_spread_and_whole(spark, folder):
    parts = [(k, 1 + k % 50) for k in [*range(120), 80_000, 90_001]]
    d = folder(part=spark.createDataFrame(parts, "p_partkey long, p_size int"))
    out = QUERIES["image_segments"](spark, d)
    want = {(p, s, min(13 * p + 1, s + k)) for p, size in parts for k in [min(999, 100000 // (size * 8))] for s in range(0, 13 * p + 1, k)}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    assert _tasks(out) > 1


def _track(n):
    return np.stack([np.full(n, -8660.254), (np.arange(n) - 4.5) * 2.5, np.full(n, 5000.0)], 1)


def test_coincident_scatterers_meet_pulses_once(spark, monkeypatch):
    """3,000 scatterers at 12 places: the echoes of all, from blocks of the 12, in more than one task."""
    from echoframe.operators import formation

    at, amp, a = RNG.integers(0, 12, 3000), RNG.random(3000), _track(700)
    xyz = np.stack([np.arange(12) * 0.4, np.arange(12) * -0.3, np.zeros(12)], 1)
    f = 9.4e9 + np.arange(4) * 2.5e6
    dr = np.linalg.norm(xyz[None] - a[:, None], axis=-1) - np.linalg.norm(a, axis=1)[:, None]
    want = (np.bincount(at, amp, 12) * np.exp(-4j * np.pi / 299792458.0 * dr * f[:, None, None])).sum(-1).T
    sizes, whole = [], formation._blocks

    def counted(df, key, *rest):
        sizes.append(df.count())
        return whole(df, key, *rest)

    monkeypatch.setattr(formation, "_blocks", counted)
    scatterers = spark.createDataFrame([(*map(float, xyz[k]), float(v)) for k, v in zip(at, amp)], "x double, y double, z double, amp double")
    pulses = spark.createDataFrame([(p, *map(float, r)) for p, r in enumerate(a)], "p long, ax double, ay double, az double")
    out = formation.simulate(scatterers.coalesce(1), pulses.coalesce(1), f[0], 2.5e6, 4)
    got = np.full(want.shape, np.nan, complex)
    for r in out.collect():
        got[r.p, r.k] = complex(r.re, r.im)
    assert np.allclose(got, want, atol=1e-6 * np.abs(want).max())
    assert sizes == [700, 12]


def test_pulses_of_one_partition_are_imaged_in_many_tasks(spark, monkeypatch):
    from echoframe.operators import formation

    def marks(plan):
        def run(tables):
            for table in tables:
                if table.num_rows:
                    zero = pa.array([np.zeros(plan["tile"] ** 2)])
                    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([0]), zero, zero], schema=formation._TILE)

        return run

    monkeypatch.setattr(formation, "_tiles", marks)
    pulses = spark.createDataFrame([(p, *map(float, r), [1.0], [0.0]) for p, r in enumerate(_track(200))], "p long, ax double, ay double, az double, re array<double>, im array<double>").coalesce(1)
    out = formation.form_image(pulses, fmin=9e9, df=1e6, nx=4000, ny=4, spx=1.0, spy=1.0, tile=4)
    assert out.select(F.floor(F.col("i") / 4)).distinct().count() > 1


def test_backprojection_counts_its_pulses_without_their_echoes(spark):
    from echoframe.operators import formation

    read = spark.sparkContext.accumulator(0)

    def seen(tables):
        for table in tables:
            read.add(table.num_rows)
            yield table

    history = spark.range(300).selectExpr("id as p", "0 as k", "1.0D as re", "0.0D as im").mapInArrow(seen, "p long, k int, re double, im double")
    pulses = spark.createDataFrame([(p, *map(float, r)) for p, r in enumerate(_track(300))], "p long, ax double, ay double, az double")
    points = spark.range(5).selectExpr("id", "0.0D as x", "double(id) as y", "0.0D as z")
    out = formation.backproject(history, pulses, points, 9e9, 1e6)
    assert read.value == 0
    dr = np.linalg.norm(np.array([[0, y, 0] for y in range(5)])[None] - _track(300)[:, None], axis=-1) - np.linalg.norm(_track(300), axis=1)[:, None]
    want = np.exp(4j * np.pi * 9e9 / 299792458.0 * dr).sum(0)
    assert np.allclose([complex(r.re, r.im) for r in out.orderBy("id").collect()], want, atol=1e-6)
    assert read.value == 300


def test_echoes_by_strips_and_by_place(spark):
    """Targets and pulses of which many share a place, against the sum over all pairs; their pairs are not made."""
    from echoframe.operators import echo

    targets = [(float(x), float(y), 0.0, float(v)) for x, y, v in zip(RNG.integers(-3, 3, 400) * 5, RNG.integers(0, 30, 400) * 40, RNG.random(400))]
    pulses = [(p, -8660.254, float(p % 9 * 150), 5000.0) for p in range(45)]
    t = spark.createDataFrame(targets, "x double, y double, z double, amp double")
    a = spark.createDataFrame(pulses, "p long, ax double, ay double, az double")
    how = {"fs": 6e7, "start": 6.62e-5, "rate": 4e13, "length": 1e-6, "fc": 1e9, "beam": 0.01}
    out = echo.chirp_echoes(t, a, 96, **how)
    want = np.zeros((45, 96), complex)
    reached = np.zeros((45, 96), bool)
    n = np.arange(96)
    for p, *at in pulses:
        for *xyz, amp in targets:
            r = np.linalg.norm(np.subtract(xyz, at))
            s = how["start"] + n / how["fs"] - 2 * r / 299792458.0
            inside = (np.abs(s) <= how["length"] / 2) & (abs(xyz[1] - at[1]) <= 0.01 * r)
            want[p] += np.where(inside, amp * np.exp(2j * np.pi * (0.5 * how["rate"] * s**2 - how["fc"] * 2 * r / 299792458.0)), 0)
            reached[p] |= inside
    got = {(r.p, r.n): complex(r.re, r.im) for r in out.collect()}
    assert set(got) == {(p, k) for p, k in np.argwhere(reached).tolist()}
    assert all(abs(v - want[p, k]) < 1e-6 for (p, k), v in got.items())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_polar_format_of_many_pulses_reads_them_once(spark):
    from echoframe.operators import focus

    n, read = 3000, spark.sparkContext.accumulator(0)

    def seen(tables):
        for table in tables:
            read.add(table.num_rows)
            yield table

    track = spark.createDataFrame([(p, *map(float, r)) for p, r in enumerate(_track(n) - [0, n * 1.25, 0])], "p long, ax double, ay double, az double")
    pulses = track.selectExpr("*", "array_repeat(1.0D, 8) re", "array_repeat(0.0D, 8) im").mapInArrow(seen, "p long, ax double, ay double, az double, re array<double>, im array<double>")
    image, _, _ = focus.polar_format(pulses, fmin=9.4e9, df=2.5e6, k=8, count=n, track=track)
    assert read.value == 0 and len(image._jdf.queryExecution().analyzed().toString()) < 100_000
    power = np.array([np.square(r.re) + np.square(r.im) for r in image.orderBy("line").collect()])
    assert read.value == n
    wide = power.shape[1]  # 3,000 pulses share no band of 20 MHz, so the image has the wavenumbers of them all
    assert len(power) == n and wide > 8
    assert np.unravel_index(power.argmax(), power.shape) == (n // 2, wide // 2)


def test_pauli_keeps_boxes_at_the_edge(spark, folder):
    z = RNG.normal(size=(10, 64)).astype(np.float32)  # halves of five lines: the last box has one
    d = folder(embeddings=spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(z)], "vec_id long, embedding array<float>"))
    c = z.astype(float)[:, :32] + 1j * z.astype(float)[:, 32:]
    p = np.abs(c[:5] + c[5:]) ** 2 / 2
    got = {(r.bi, r.bj): r.surface for r in QUERIES["pauli"](spark, d).collect()}
    assert got == pytest.approx({(i, j): p[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].mean() for i in range(3) for j in range(16)}, abs=2e-6)


def test_lags_across_tiles_without_a_join_of_pixels(spark):
    from echoframe.operators import signal

    i, j = RNG.integers(-300, 600, 4000), RNG.integers(250, 262, 4000)
    a = {(int(x), int(y)): float(v) for x, y, v in zip(i, j, RNG.random(4000))}
    b = {(x - 2, y + 1): v for (x, y), v in a.items()}
    frame = lambda z: spark.createDataFrame([(*at, v) for at, v in z.items()], "i long, j long, v double")
    out = signal.correlate(frame(a), frame(b), 3)
    for r in out.collect():
        terms = [v * b[x + r.di, y + r.dj] for (x, y), v in a.items() if (x + r.di, y + r.dj) in b]
        assert r.c == pytest.approx(np.mean(terms), abs=1e-12)
    assert out.count() == 49
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_factors_read_pulses_once_if_their_track_is_known(spark):
    from echoframe.operators import focus

    read = spark.sparkContext.accumulator(0)

    def seen(tables):
        for table in tables:
            read.add(table.num_rows)
            yield table

    track = spark.createDataFrame([(p, *map(float, r)) for p, r in enumerate(_track(20))], "p long, ax double, ay double, az double")
    pulses = track.selectExpr("*", "array_repeat(1.0D, 8) re", "array_repeat(0.0D, 8) im").mapInArrow(seen, "p long, ax double, ay double, az double, re array<double>, im array<double>")
    out = focus.factorized(pulses, focus.Grid(8, 8, 0.5, 0.5), fmin=9.4e9, df=2.5e6, k=8, tile=8, track=track)
    assert read.value == 0
    assert out.count() == 64 and read.value == 20


def test_overlaps_are_spread_and_whole(spark, folder):
    keys = range(300)
    d = folder(customer=spark.createDataFrame([(k, k % 2) for k in keys], "c_custkey long, c_nationkey int"))
    out = QUERIES["support_overlap"](spark, d)
    span = {k: (k % 90, k % 90 + 10 + k % 7) for k in keys}
    want = {(a, b) for a in keys for b in keys if a < b and (a - b) % 2 == 0 and span[a][0] < span[b][1] and span[b][0] < span[a][1]}
    got = [(r.a, r.b) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    assert _tasks(out) > 1


@pytest.mark.parametrize(("name", "most"), [("block_starts", 0.5), ("image_segments", 1)])
def test_steps_take_little_disk(spark, folder, tmp_path, name, most):
    """Rows come in an order that encodes well: bytes of a row as Parquet (row after row of the table it takes several times as many)."""
    d = folder(part=spark.createDataFrame([(k, 1 + k % 2 * 40) for k in range(1_000_000, 1_000_040)], "p_partkey long, p_size int"))
    QUERIES[name](spark, d).write.parquet(f"{tmp_path}/out")
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert size < most * spark.read.parquet(f"{tmp_path}/out").count()


def test_factors_exchange_pulses_once_and_tiles_of_any_size(spark):
    """37 pixels do not halve evenly: tiles of all levels keep common edges; no exchange below the tiles that pulses are sent to."""
    from echoframe.operators import focus

    n, k, f = 96, 24, 9.4e9 + np.arange(24) * 2.5e6
    a, at = _track(n) - [0, n * 1.25 - 11.25, 0], np.array([[7.5, -6.5, 0], [-8.0, 8.0, 0], [3.0, 8.5, 0]])
    dr = np.linalg.norm(at[None] - a[:, None], axis=-1) - np.linalg.norm(a, axis=1)[:, None]
    s = np.exp(-4j * np.pi / 299792458.0 * dr[..., None] * f).sum(1)
    pulses = spark.createDataFrame([(p, *map(float, x), z.real.tolist(), z.imag.tolist()) for p, (x, z) in enumerate(zip(a, s))], "p long, ax double, ay double, az double, re array<double>, im array<double>")
    grid = focus.Grid(37, 37, 0.5, 0.5)
    out = focus.factorized(pulses, grid, fmin=f[0], df=2.5e6, k=k, tile=6)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2
    got = np.full((37, 37), np.nan, complex)
    for r in out.collect():
        got[r.i, r.j] = complex(r.re, r.im)
    x = grid.points(*np.meshgrid(np.arange(37), np.arange(37), indexing="ij"))
    back = np.linalg.norm(x[None] - a[:, None, None], axis=-1) - np.linalg.norm(a, axis=1)[:, None, None]
    want = sum((s[:, m, None, None] * np.exp(4j * np.pi / 299792458.0 * back * f[m])).sum(0) for m in range(k))
    assert np.abs(got - want).max() < 10 ** (-30 / 20) * np.abs(want).max()


def test_corner_turn_and_pixels_make_no_row_of_a_sample(spark):
    """Lines of different lengths in any order, and lines of zeros that stay where they are."""
    from echoframe.operators import lines

    z = {7: [1.0, 2.0, 3.0], 2: [4.0] * 40, 5: [0.0]}
    df = spark.createDataFrame([(k, v, [-x for x in v]) for k, v in z.items()], lines.SCHEMA).repartition(3)
    out = lines.corner_turn(df)
    assert {r.line: (r.re, r.im) for r in out.collect()} == {c: (w := [z[k][c] for k in (2, 5, 7) if len(z[k]) > c], [-x for x in w]) for c in range(40)}
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    whole = lines.corner_turn(df, (9, 40))
    assert {r.line: r.re for r in whole.collect()} == {c: [z[k][c] if len(z.get(k, [])) > c else 0.0 for k in range(9)] for c in range(40)}
    pixels = lines.to_pixels(df)
    assert {(r.i, r.j): r.re for r in pixels.collect()} == {(k, c): x for k, v in z.items() for c, x in enumerate(v)}
    assert "Generate" not in pixels._jdf.queryExecution().executedPlan().toString()


def test_rounding_of_many_rows_gives_the_same(spark):
    from echoframe.plans import rasters

    x = [*(RNG.normal(size=2000) * 10.0 ** RNG.integers(-6, 16, 2000)), 0.0005, -0.0015, 1.0005, -0.0, 1e300, float("nan"), float("inf"), 0.0004999999999, None]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(x)], "i long, x double")
    a, b = (sorted(map(str, rasters.rounded(df, 3, many=m).collect())) for m in (True, False))
    assert a == b
