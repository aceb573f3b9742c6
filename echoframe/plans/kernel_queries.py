"""Queries of the line kernels; their twins write the transforms out as sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import formation, lines
from . import rasters as r
from .catalog import query
from .geometry_queries import _DF, _FMIN, _K, _SMALL, _small


def _lines(spark, d):
    return lines.to_lines(r.scene(spark, d))


_X = f"WITH {r.SCENE}, x AS (SELECT i, j, re, im FROM scene)"
_TURN = "cos(2 * pi() * {c}) AS c, sin(2 * pi() * {c}) AS s"
#: Spectra f (i, b, re, im) of the 32-sample lines x.
_SPECTRUM = f"""{_X}, t AS (SELECT i, unnest(range(32)) AS b, j, re, im FROM x), u AS (SELECT *, {_TURN.format(c="(-(b * j % 32) / 32e0)")} FROM t),
f AS (SELECT i, b, sum(re * c - im * s) AS re, sum(re * s + im * c) AS im FROM u GROUP BY i, b)"""


def _back(spectrum: str) -> str:
    """Lines (i, j, re, im) from a table of spectra."""
    return f"""{_SPECTRUM}, g AS ({spectrum}), v AS (SELECT *, {_TURN.format(c="(b * j % 32) / 32e0")} FROM (SELECT i, b, re, im, unnest(range(32)) AS j FROM g))
--
SELECT i, j, sum(re * c - im * s) / 32 AS re, sum(re * s + im * c) / 32 AS im FROM v GROUP BY i, j"""


def _pixels(df):
    return r.rounded(lines.to_pixels(df).select("i", "j", "re", "im"))


@query("corner_turn", r.rounded_sql(f"{_X}\n--\nSELECT j AS i, i AS j, re, im FROM x", "re im", "i j"))
def _(spark, d):
    return _pixels(lines.corner_turn(_lines(spark, d)))


_REPLICA = np.exp(1j * np.pi * np.arange(8) ** 2 / 9)


@query(
    "range_compression",
    r.rounded_sql(
        f"""{_X}, m AS (SELECT unnest(range(8)) AS m), p AS (SELECT m, cos(pi() * m * m / 9) AS c, sin(pi() * m * m / 9) AS s FROM m)
--
SELECT x.i, x.j, sum(y.re * c + y.im * s) AS re, sum(y.im * c - y.re * s) AS im FROM x, p, x y WHERE y.i = x.i AND y.j = x.j + m GROUP BY x.i, x.j""",
        "re im",
        "i j",
    ),
)
def _(spark, d):
    return _pixels(lines.range_compress(_lines(spark, d), _REPLICA))


@query("band_limit", r.rounded_sql(_back("SELECT * FROM f WHERE least(b, 32 - b) <= 8"), "re im", "i j"))
def _(spark, d):
    return _pixels(lines.band_limit(_lines(spark, d), 0.5))


@query("subpixel_shift", r.rounded_sql(_back(f"SELECT i, b, re * c - im * s AS re, re * s + im * c AS im FROM (SELECT *, {_TURN.format(c='(-(CASE WHEN b < 16 THEN b ELSE b - 32 END) * 0.3e0 / 32)')} FROM f)"), "re im", "i j"))
def _(spark, d):
    return _pixels(lines.shift(_lines(spark, d), 0.3))


@query(
    "range_gate",
    r.rounded_sql(
        f"""{_X}, t AS (SELECT i, b, j, re, im, {_TURN.format(c="(b * j % 32) / 32e0")} FROM (SELECT i, unnest(range(4, 16)) AS b, j, re, im FROM x)), g AS (SELECT i, b - 4 AS b, sum(re * c - im * s) / 32 AS re, sum(re * s + im * c) / 32 AS im FROM t GROUP BY i, b),
v AS (SELECT *, {_TURN.format(c="(-(b * j % 12) / 12e0)")} FROM (SELECT i, b, re, im, unnest(range(12)) AS j FROM g))
--
SELECT i, j, sum(re * c - im * s) AS re, sum(re * s + im * c) AS im FROM v GROUP BY i, j""",
        "re im",
        "i j",
    ),
)
def _(spark, d):
    """Frequency samples cut to 12 of their 32 range bins."""
    return _pixels(lines.range_gate(_lines(spark, d), 4, 12))


@query("line_resampling")
def _(spark, d):
    """Lines read at places a fraction of their number further; Kaiser-weighted sinc taps, so no SQL twin."""
    return _pixels(lines.resample(lines.to_lines(r.scene(spark, d)), lambda k: np.arange(32) + k % 10 / 10))


@query("range_profiles_image")
def _(spark, d):
    """A 32 x 32 image from interpolated range profiles, by tiles."""
    s, a = _small(spark, d)
    history = formation.simulate(s, a, _FMIN, _DF, _K)
    row = F.sort_array(F.collect_list(F.struct("k", "re", "im")))
    pulses = history.groupBy("p").agg(row.alias("v")).select("p", F.col("v.re").alias("re"), F.col("v.im").alias("im")).join(a, "p")
    return r.rounded(formation.form_image(pulses, fmin=_FMIN, df=_DF, nx=32, ny=32, spx=0.5, spy=0.5, tile=16), 3)


@query(
    "toolbox_percentile",
)
def _(spark, d):
    """Percentiles by the spline through ranks, one row each."""
    v = r.scene(spark, d).select(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("a"))
    return spark.createDataFrame([(p, round(lines.spline_percentile(v, "a", p), 6)) for p in (1.0, 50.0, 99.0)], "percent double, value double")


del _SMALL
