"""Queries of echoes, spectra, gates, areas and image formation by factors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import areas, echo, focus, formation, lines
from ..operators.estimate import tile_shifts
from . import rasters as r
from .catalog import query
from .geometry_queries import _DF, _FMIN, _K, _small
from .kernel_queries import _REPLICA, _SPECTRUM, _lines


@query("band_energy", r.rounded_sql(f"{_SPECTRUM}\n--\nSELECT CAST(b AS BIGINT) AS b, avg(re * re + im * im) AS energy FROM f GROUP BY b", "energy", "b"))
def _(spark, d):
    """Mean power of the lines' transforms."""
    return r.rounded(echo.mean_spectrum(_lines(spark, d)))


@query(
    "spectral_gap",
    f"""{_SPECTRUM}, e AS (SELECT CAST(b AS BIGINT) AS b, avg(re * re + im * im) AS energy FROM f GROUP BY b), s AS (SELECT (b + d) % 32 AS b, sum(energy) / 5 AS energy FROM e, (SELECT unnest([30, 31, 0, 1, 2]) AS d) GROUP BY ALL)
SELECT b AS gap FROM s ORDER BY round(energy, 9), b LIMIT 1""",
)
def _(spark, d):
    """The bin where the smoothed spectrum is least."""
    return echo.spectral_gap(_lines(spark, d), 32).select(F.col("gap").cast("long").alias("gap"))


_CORNERS = [(-40.0, -30.0, 0.0), (-40.0, 30.0, 0.0), (40.0, -30.0, 0.0), (40.0, 30.0, 0.0)]
_BIN = 299792458.0 / (2 * 256 * 2.5e6)
_SPANS = ", ".join(f"(sqrt(pow({x!r} - ax, 2) + pow({y!r} - ay, 2) + az * az) - own) / {_BIN!r}" for x, y, _ in _CORNERS)


@query(
    "gate_plan",
    f"""WITH a AS (SELECT o_orderkey AS p, -8660.254e0 AS ax, (o_orderkey - 500e0) * 0.25e0 AS ay, 5000e0 AS az FROM orders), w AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS own FROM a),
s AS (SELECT p, CAST(floor(least({_SPANS})) AS BIGINT) - 4 AS first, CAST(ceil(greatest({_SPANS})) AS BIGINT) + 4 AS last FROM w)
SELECT p, first, least(last - first + 1, 256) AS count FROM s""",
)
def _(spark, d):
    """The range bins that a scene of 80 m x 60 m spans at each pulse."""
    p = F.col("o_orderkey")
    pulses = r.table(spark, d, "orders").select(p.alias("p"), F.lit(-8660.254).alias("ax"), ((p - 500.0) * 0.25).alias("ay"), F.lit(5000.0).alias("az"))
    return echo.gate_plan(pulses, _CORNERS, 2.5e6, 256, 4).select("p", F.col("first").cast("long").alias("first"), F.col("count").cast("long").alias("count"))


_ECHO = {"fs": 6e7, "start": 6.62e-5, "rate": 4e13, "length": 1e-6, "fc": 1e9, "beam": 0.01}


@query(
    "chirp_echoes",
    r.rounded_sql(
        f"""WITH s AS (SELECT p_partkey AS id, (p_partkey % 40 - 20) * 5e0 AS x, p_partkey % 400 * 4e0 AS y, 0e0 AS z, p_retailprice / 1000 AS amp FROM part), a AS (SELECT s_suppkey AS p, -8660.254e0 AS ax, s_suppkey % 100 * 15e0 AS ay, 5000e0 AS az FROM supplier),
m AS (SELECT p, amp, y - ay AS v, sqrt(pow(x - ax, 2) + pow(y - ay, 2) + pow(z - az, 2)) AS rng FROM s, a), q AS (SELECT p, amp, 2 * rng / 299792458e0 AS delay FROM m WHERE abs(v) <= {_ECHO["beam"]!r} * rng),
g AS (SELECT *, greatest(CAST(ceil((delay - {_ECHO["length"]!r} / 2 - {_ECHO["start"]!r}) * {_ECHO["fs"]!r}) AS BIGINT), 0) AS lo, least(CAST(floor((delay + {_ECHO["length"]!r} / 2 - {_ECHO["start"]!r}) * {_ECHO["fs"]!r}) AS BIGINT), 95) AS hi FROM q),
e AS (SELECT p, amp, delay, unnest(range(lo, hi + 1)) AS n FROM g WHERE lo <= hi), c AS (SELECT p, n, amp, 0.5e0 * {_ECHO["rate"]!r} * pow({_ECHO["start"]!r} + n / {_ECHO["fs"]!r} - delay, 2) - {_ECHO["fc"]!r} * delay AS c FROM e)
--
SELECT p, n, sum(amp * cos(2 * pi() * (c - round(c)))) AS re, sum(amp * sin(2 * pi() * (c - round(c)))) AS im FROM c GROUP BY p, n""",
        "re im",
        "p n",
        4,
    ),
)
def _(spark, d):
    """Raw chirp echoes of the targets in each pulse's beam: an interval join on delay."""
    k, p = F.col("p_partkey"), F.col("s_suppkey")
    targets = r.table(spark, d, "part").select(((k % 40 - 20) * 5.0).alias("x"), (k % 400 * 4.0).alias("y"), F.lit(0.0).alias("z"), (F.col("p_retailprice") / 1000).alias("amp"))
    pulses = r.table(spark, d, "supplier").select(p.alias("p"), F.lit(-8660.254).alias("ax"), (p % 100 * 15.0).alias("ay"), F.lit(5000.0).alias("az"))
    return r.rounded(echo.chirp_echoes(targets, pulses, 96, **_ECHO).select("p", F.col("n").cast("long").alias("n"), "re", "im"), 4)


@query(
    "pulse_delay",
    r.rounded_sql(
        f"""WITH {r.SCENE}, m AS (SELECT m, cos(pi() * m * m / 9) AS c, sin(pi() * m * m / 9) AS s FROM (SELECT unnest(range(8)) AS m)), q AS (SELECT x.i AS line, x.j - m AS k, sum(x.re * c + x.im * s) AS re, sum(x.im * c - x.re * s) AS im FROM scene x, m WHERE x.j >= m GROUP BY ALL),
a AS (SELECT line, k, sqrt(re * re + im * im) AS a FROM q), n AS (SELECT *, lag(a) OVER w AS u, lead(a) OVER w AS w FROM a WINDOW w AS (PARTITION BY line ORDER BY k)), t AS (SELECT line, arg_max(k, a) AS k FROM a GROUP BY line)
--
SELECT line, CASE WHEN k BETWEEN 1 AND 30 AND u - 2 * a + w <> 0 THEN k + 0.5e0 * (u - w) / (u - 2 * a + w) ELSE k END * 1e0 AS delay FROM n JOIN t USING (line, k)""",
        "delay",
        "line",
    ),
)
def _(spark, d):
    """The delay (samples) at which each line correlates best with the replica, refined by a parabola."""
    return r.rounded(echo.internal_delay(_lines(spark, d), _REPLICA, 1.0))


@query(
    "quality_area",
    f"""WITH RECURSIVE {r.SCENE}, p AS (SELECT i, j, re * re + im * im AS p FROM scene), t AS (SELECT * FROM p WHERE p > 0.03),
a(i, j) AS (SELECT i, j FROM t WHERE p > 0.12 UNION SELECT t.i, t.j FROM a JOIN t ON abs(t.i - a.i) + abs(t.j - a.j) = 1)
SELECT i, j FROM a""",
)
def _(spark, d):
    """Pixels above a level that are connected with a much brighter one."""
    p = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    values = r.scene(spark, d).select("i", "j", p.alias("p"))
    return areas.quality_area(values, F.col("p") > 0.03, F.col("p") > 0.12)


def _pulses(spark, d):
    s, a = _small(spark, d)
    history = formation.simulate(s, a, _FMIN, _DF, _K)
    row = F.sort_array(F.collect_list(F.struct("k", "re", "im")))
    return history.groupBy("p").agg(row.alias("v")).select("p", F.col("v.re").alias("re"), F.col("v.im").alias("im")).join(a, "p")


def _side(spark, d) -> int:
    """Pixels on a side of an image that grows with the tables."""
    return 32 * max(1, round((r.table(spark, d, "part").count() / 200) ** 0.5))


@query("factorized_image")
def _(spark, d):
    """An image whose size follows the tables, by factorised backprojection (tests hold it against the direct sum)."""
    n = _side(spark, d)
    return r.rounded(focus.factorized(_pulses(spark, d), focus.Grid(n, n, 0.5, 0.5), fmin=_FMIN, df=_DF, k=_K, tile=16, track=_small(spark, d)[1]), 3)


@query("polar_format_image")
def _(spark, d):
    """An image of the same pulses by polar format."""
    track = _small(spark, d)[1]
    return r.rounded(lines.to_pixels(focus.polar_format(_pulses(spark, d), fmin=_FMIN, df=_DF, k=_K, count=track.count(), track=track)[0]), 3, many=True)


def _stripmap(spark, n: int, m: int):
    """Range-compressed echoes of one point, a line for each pulse."""
    p = {"fc": 9.6e9, "fs": 120e6, "prf": 600.0, "speed": 200.0, "r0": 5000.0}

    def echoes(line: int, z: np.ndarray) -> np.ndarray:
        eta = (line - n / 2) / p["prf"]
        rng = np.sqrt(p["r0"] ** 2 + (p["speed"] * eta) ** 2)
        t = np.arange(m) / p["fs"]
        return np.sinc(80e6 * (t - m / 2 / p["fs"] - 2 * (rng - p["r0"]) / 299792458.0)) * np.exp(-4j * np.pi * p["fc"] / 299792458.0 * rng) * (abs(eta) < 0.3 * n / p["prf"])

    empty = spark.range(n).select(F.col("id").alias("line"), F.array(F.lit(0.0)).alias("re"), F.array(F.lit(0.0)).alias("im"))
    return lines.map_lines(empty, echoes), p


def _peak(image):
    return image.agg(F.max_by(F.struct("i", "j"), F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("at")).select("at.i", "at.j")


@query("omega_k_peak", "SELECT CAST(128 AS BIGINT) AS i, CAST(48 AS BIGINT) AS j")
def _(spark, d):
    """Where omega-k focuses the one target of a strip; the twin states where it was put."""
    echoes, p = _stripmap(spark, 256, 96)
    return _peak(lines.to_pixels(focus.omega_k(echoes, 256, **p)))


@query("range_doppler_peak", "SELECT CAST(128 AS BIGINT) AS i, CAST(48 AS BIGINT) AS j")
def _(spark, d):
    """The same by the range-Doppler algorithm."""
    echoes, p = _stripmap(spark, 256, 96)
    return _peak(lines.to_pixels(focus.range_doppler(echoes, 256, **p)))


@query("tile_displacement")
def _(spark, d):
    """Displacement of a power image against itself moved by (2, -3), in tiles of 32 pixels."""
    a = r.scene(spark, d).select("i", "j", F.log10(F.col("re") * F.col("re") + F.col("im") * F.col("im") + 1e-6).alias("a"))
    b = a.select((F.col("i") + 2).alias("i"), F.pmod(F.col("j") - 3, F.lit(32)).alias("j"), F.col("a").alias("b"))
    return r.rounded(tile_shifts(a.join(b, ["i", "j"]), 32, 8), 3)


@query("calibration_series")
def _(spark, d):
    """The lowest Chebyshev order that fits a gain curve within 0.1 dB, and its coefficients."""
    x = F.col("p_size") / 25.0 - 1
    order, c = areas.chebyshev_fit(r.table(spark, d, "part"), x, 2 + x + 0.3 * x * x)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(c)], "k long, coefficient double").filter(F.col("k") <= order)


