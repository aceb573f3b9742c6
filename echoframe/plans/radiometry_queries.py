"""Queries of radiometric levels, pair geometry and Earth-fixed grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geodesy as g
from ..operators import geometry, radiometry
from . import rasters as r
from .catalog import query
from .geometry_queries import _PLACES, _places


@query(
    "radiometric_levels",
    r.rounded_sql(
        """WITH p AS (SELECT p_partkey AS id, p_retailprice / 1000 AS power, 0.5e0 + p_size % 7 / 10e0 AS gain, 20e0 + p_size AS graze, 5e0 + p_size % 11 AS slope, p_size % 5 <> 0 AS seen FROM part),
n AS (SELECT *, 1e-3 * 2.5e0 / (400 * 0.8e0 * gain) AS nesz, power / (3.2e0 * 0.8e0) AS sigma0 FROM p)
--
SELECT id, 10 * log10(nesz) AS nesz_db, CASE WHEN seen THEN gain / (nesz * gain / 0.1e0 + 0.02e0) ELSE 0 END AS snr, sigma0, sigma0 / cos(radians(slope)) AS beta0, sigma0 / sin(radians(graze)) AS gamma0 FROM n""",
        "nesz_db snr sigma0 beta0 gamma0",
        "id",
    ),
)
def _(spark, d):
    size, gain = F.col("p_size"), 0.5 + F.col("p_size") % 7 / 10.0
    noise = radiometry.nesz(F.lit(1e-3), F.lit(2.5), F.lit(400.0), F.lit(0.8), gain)
    levels = radiometry.calibrated(F.col("p_retailprice") / 1000, F.lit(3.2), F.lit(0.8), 5.0 + size % 11, 20.0 + size)
    ratio = radiometry.snr(gain, noise * gain, F.lit(0.1), F.lit(0.02), size % 5 != 0)
    return r.rounded(r.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (10 * F.log10(noise)).alias("nesz_db"), ratio.alias("snr"), *(c.alias(n) for n, c in levels.items())))


@query(
    "pair_baseline",
    r.rounded_sql(
        """WITH c AS (SELECT s_suppkey AS id, s_suppkey // 8 AS k, radians(30 + s_suppkey % 37 / 20e0) AS g FROM supplier), q AS (SELECT a.id AS a, b.id AS b, a.g AS ga, b.g AS gb FROM c a JOIN c b ON a.k = b.k AND a.id < b.id),
w AS (SELECT *, greatest(9.3e9 * cos(ga), 9.3e9 * cos(gb)) AS lo, least(9.9e9 * cos(ga), 9.9e9 * cos(gb)) AS hi, tan(ga) - tan(gb) AS t FROM q)
--
SELECT a, b, greatest(hi - lo, 0) / (6e8 * cos(ga)) AS overlap, degrees(6e8 / 9.6e9 / tan((ga + gb) / 2)) AS critical_graze, CASE WHEN abs(t) > 1e-12 THEN 1 / ((lo + hi) / 299792458e0 * t) END AS height_of_ambiguity FROM w""",
        "overlap critical_graze height_of_ambiguity",
        "a b",
        5,
    ),
)
def _(spark, d):
    """Pairs of collections of one site; a site has eight at most."""
    c = r.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.floor(F.col("s_suppkey") / 8).alias("k"), (30 + F.col("s_suppkey") % 37 / 20.0).alias("g"))
    a, b = c.alias("a"), c.alias("b")
    met = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.id") < F.col("b.id")))
    out = radiometry.pair_geometry(F.lit(9.6e9), F.lit(6e8), F.col("a.g"), F.col("b.g"))
    return r.rounded(met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), *(v.alias(n) for n, v in out.items())), 5)


@query(
    "earth_grid",
    r.rounded_sql(
        f"""WITH {_PLACES}, c AS (SELECT *, radians(id % 360 * 1e0) AS az, radians(lat) AS la, radians(lon) AS lo FROM xyz),
a AS (SELECT *, -sin(lo) * sin(az) - sin(la) * cos(lo) * cos(az) AS x1, cos(lo) * sin(az) - sin(la) * sin(lo) * cos(az) AS y1, cos(la) * cos(az) AS z1,
  -sin(lo) * cos(az) + sin(la) * cos(lo) * sin(az) AS x2, cos(lo) * cos(az) + sin(la) * sin(lo) * sin(az) AS y2, -cos(la) * sin(az) AS z2 FROM c)
--
SELECT id, x - 500 * x1 - 400 * x2 AS ox, y - 500 * y1 - 400 * y2 AS oy, z - 500 * z1 - 400 * z2 AS oz FROM a""",
        "ox oy oz",
        "id",
        3,
    ),
)
def _(spark, d):
    """First pixel of a 1000 m x 800 m grid about each place, its first axis along an azimuth."""
    e, n, _ = g.enu(F.col("lat"), F.col("lon"))
    az = F.radians(F.col("id") % 360 * 1.0)
    first = [e[k] * F.sin(az) + n[k] * F.cos(az) for k in range(3)]
    second = [e[k] * F.cos(az) - n[k] * F.sin(az) for k in range(3)]
    at = geometry.vector("x", "y", "z")
    return r.rounded(_places(spark, d).select("id", *((at[k] - 500 * first[k] - 400 * second[k]).alias(f"o{x}") for k, x in enumerate("xyz"))), 3)
