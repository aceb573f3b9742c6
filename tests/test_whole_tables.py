"""Queries read whole tables: small fixtures beyond the row numbers that were once fixed, by brute force."""

import numpy as np
import pytest
from echoframe.operators import formation
from echoframe.plans import catalog, geometry_queries, rasters
from pyspark.sql import functions as F

QUERIES = catalog.load()[0]


@pytest.fixture(scope="module")
def larger(spark, tmp_path_factory):
    """621 embeddings, 260 parts, 13 suppliers and 10,500 orders."""
    d = str(tmp_path_factory.mktemp("larger"))
    z = np.random.default_rng(2).normal(size=(621, 64)).astype(np.float32)
    spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(z)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.range(260).select(F.col("id").alias("p_partkey"), (F.col("id") + 900.0).alias("p_retailprice")).write.parquet(f"{d}/part.parquet")
    spark.range(13).select(F.col("id").alias("s_suppkey")).write.parquet(f"{d}/supplier.parquet")
    spark.range(10_500).select(F.col("id").alias("o_orderkey")).write.parquet(f"{d}/orders.parquet")
    return d, z.astype(float)[:, :32] + 1j * z.astype(float)[:, 32:]


def test_pair_is_the_two_halves(spark, larger):
    d, z = larger
    a, b = np.full((310, 32), np.nan, complex), np.full((310, 32), np.nan, complex)
    for r in rasters.pair(spark, d).collect():
        a[r.i, r.j], b[r.i, r.j] = complex(r.ar, r.ai), complex(r.br, r.bi)
    assert np.array_equal(a, z[:310]) and np.array_equal(b, z[310:620])


def test_coherence_summary_by_brute_force(spark, larger):
    d, z = larger
    a, b = z[:310], z[310:620]

    def box(x):
        padded = np.pad(x, 3, mode="edge")
        return sum(padded[i : i + x.shape[0], j : j + x.shape[1]] for i in range(7) for j in range(7)) / 49

    g = np.abs(box(a * b.conj())) / np.sqrt(box(np.abs(a) ** 2) * box(np.abs(b) ** 2))
    want = [np.median(g), np.quantile(g, 0.9), g.mean(), (g > 0.5).mean(), (g > 0.7).mean()]
    assert np.allclose(list(QUERIES["coherence_summary"](spark, d).first()), want, atol=2e-6)


def test_echoes_of_every_scatterer_at_every_pulse(spark, larger):
    k, p = np.arange(260), np.arange(13)
    x, y, amp = (k % 40 - 20) * 0.4, (k // 40 % 40 - 20) * 0.4, (k + 900) / 1000
    ax, ay, az = -8660.254, (p - 4.5) * 2.5, 5000.0
    away = np.sqrt((x - ax) ** 2 + (y - ay[:, None]) ** 2 + az**2) - np.sqrt(ax**2 + ay**2 + az**2)[:, None]
    f = geometry_queries._FMIN + np.arange(geometry_queries._K) * geometry_queries._DF
    want = (amp * np.exp(-4j * np.pi * f[:, None, None] / 299792458.0 * away)).sum(-1).T
    got = np.full(want.shape, np.nan, complex)
    for r in formation.simulate(*geometry_queries._small(spark, larger[0]), geometry_queries._FMIN, geometry_queries._DF, geometry_queries._K).collect():
        got[r.p, r.k] = complex(r.re, r.im)
    assert np.allclose(got, want, atol=1e-4)


def test_gaps_are_filled_beyond_ten_thousand_orders(spark, larger):
    out = QUERIES["fill_gaps"](spark, larger[0]).groupBy("id").agg(F.count("*").alias("n"), F.max("x").alias("x")).collect()
    rows = [r for r in range(525) if r % 7 != 3]
    assert sorted((r.id, r.n, r.x) for r in out) == [(i, rows[-1] + 1, 2.0 * rows[-1]) for i in range(20)]


def test_every_line_is_resampled(spark, larger):
    d, z = larger
    out = QUERIES["line_resampling"](spark, d).filter("i % 10 = 0 and j = 16")
    got = {r.i: complex(r.re, r.im) for r in out.collect()}
    assert sorted(got) == list(range(0, 621, 10))
    assert all(abs(v - z[i, 16]) < 1e-5 for i, v in got.items())
