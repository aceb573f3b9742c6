"""Queries of geometry, radar scalars, simulation and image formation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import cx, radar
from ..functions import geodesy as g
from ..operators import formation, geometry
from . import rasters as r
from .catalog import query

# Places on Earth from customer keys; the same in SQL.
_PLACES = """places AS (
  SELECT c_custkey AS id, (c_custkey * 7919 % 17000) / 100e0 - 85 AS lat, (c_custkey * 104729 % 36000) / 100e0 - 180 AS lon, CAST(c_custkey % 5000 AS DOUBLE) AS h FROM customer
), ecf AS (
  SELECT *, 6378137e0 / sqrt(1 - e2 * pow(sin(radians(lat)), 2)) AS n FROM places, (SELECT (1 / 298.257223563e0) * (2 - 1 / 298.257223563e0) AS e2, 6378137e0 * (1 - 1 / 298.257223563e0) AS b)
), xyz AS (
  SELECT *, (n + h) * cos(radians(lat)) * cos(radians(lon)) AS x, (n + h) * cos(radians(lat)) * sin(radians(lon)) AS y, (n * (1 - e2) + h) * sin(radians(lat)) AS z FROM ecf
)"""


def _places(spark, d):
    k = F.col("c_custkey")
    p = r.table(spark, d, "customer").select(k.alias("id"), (k * 7919 % 17000 / 100.0 - 85).alias("lat"), (k * 104729 % 36000 / 100.0 - 180).alias("lon"), (k % 5000).cast("double").alias("h"))
    x = g.to_ecf(F.col("lat"), F.col("lon"), F.col("h"))
    return p.select("*", *(c.alias(n) for c, n in zip(x, "xyz", strict=True)))


@query("geodetic_to_ecf", r.rounded_sql(f"WITH {_PLACES}\n--\nSELECT id, x, y, z FROM xyz", "x y z", "id", 3))
def _(spark, d):
    return r.rounded(_places(spark, d).select("id", "x", "y", "z"), 3)


@query(
    "ecf_to_geodetic",
    r.rounded_sql(
        f"""WITH {_PLACES}, t AS (SELECT *, sqrt(x * x + y * y) AS p, atan2(z * 6378137e0, sqrt(x * x + y * y) * b) AS th FROM xyz),
l AS (SELECT *, atan2(z + e2 / (1 - e2) * b * pow(sin(th), 3), p - e2 * 6378137e0 * pow(cos(th), 3)) AS la FROM t)
--
SELECT id, degrees(la) AS lat, degrees(atan2(y, x)) AS lon, p / cos(la) - 6378137e0 / sqrt(1 - e2 * pow(sin(la), 2)) AS h FROM l""",
        "lat lon h",
        "id",
        4,
    ),
)
def _(spark, d):
    out = g.to_geodetic(geometry.vector("x", "y", "z"))
    return r.rounded(_places(spark, d).select("id", *(c.alias(n) for c, n in zip(out, ("lat", "lon", "h"), strict=True))), 4)


@query("enu_axes", r.rounded_sql(f"WITH {_PLACES}\n--\nSELECT id, -sin(radians(lon)) AS ex, cos(radians(lon)) AS ey, -sin(radians(lat)) * cos(radians(lon)) AS nx, -sin(radians(lat)) * sin(radians(lon)) AS ny, cos(radians(lat)) AS nz, cos(radians(lat)) * cos(radians(lon)) AS ux, cos(radians(lat)) * sin(radians(lon)) AS uy, sin(radians(lat)) AS uz FROM places", "ex ey nx ny nz ux uy uz", "id"))
def _(spark, d):
    e, n, u = g.enu(F.col("lat"), F.col("lon"))
    return r.rounded(_places(spark, d).select("id", e[0].alias("ex"), e[1].alias("ey"), n[0].alias("nx"), n[1].alias("ny"), n[2].alias("nz"), u[0].alias("ux"), u[1].alias("uy"), u[2].alias("uz")))


@query(
    "scene_to_ecf",
    r.rounded_sql(
        f"""WITH {_PLACES}, s AS (SELECT *, id % 100 * 10e0 AS sx, id % 70 * 5e0 AS sy, id % 9 * 1e0 AS sz, radians(id % 360 * 1e0) AS hd, radians(lat) AS la, radians(lon) AS lo FROM xyz),
l AS (SELECT *, sx * cos(hd) + sy * sin(hd) AS e, -sx * sin(hd) + sy * cos(hd) AS nn FROM s)
--
SELECT id, x + e * -sin(lo) + nn * -sin(la) * cos(lo) + sz * cos(la) * cos(lo) AS x, y + e * cos(lo) + nn * -sin(la) * sin(lo) + sz * cos(la) * sin(lo) AS y, z + nn * cos(la) + sz * sin(la) AS z FROM l""",
        "x y z",
        "id",
        3,
    ),
)
def _(spark, d):
    i = F.col("id")
    at = g.placed((i % 100 * 10.0, i % 70 * 5.0, i % 9 * 1.0), F.col("lat"), F.col("lon"), F.col("h"), i % 360 * 1.0)
    return r.rounded(_places(spark, d).select("id", *(c.alias(n) for c, n in zip(at, "xyz", strict=True))), 3)


# Antennas 10 km east of each place's up direction, tracks along north.
_TRACKS = f"""{_PLACES}, axes AS (
  SELECT *, -sin(radians(lon)) AS ex, cos(radians(lon)) AS ey, -sin(radians(lat)) * cos(radians(lon)) AS nx, -sin(radians(lat)) * sin(radians(lon)) AS ny, cos(radians(lat)) AS nz,
    cos(radians(lat)) * cos(radians(lon)) AS ux, cos(radians(lat)) * sin(radians(lon)) AS uy, sin(radians(lat)) AS uz, id % 50 * 100e0 AS off FROM xyz
), tracks AS (
  SELECT *, x + 7000 * ex + off * nx + 6000 * ux AS ax, y + 7000 * ey + off * ny + 6000 * uy AS ay, z + off * nz + 6000 * uz AS az, 200 * nx + 10 * ex AS vx, 200 * ny + 10 * ey AS vy, 200 * nz AS vz FROM axes
)"""


def _tracks(spark, d):
    p = _places(spark, d)
    e, n, u = g.enu(F.col("lat"), F.col("lon"))
    off = F.col("id") % 50 * 100.0
    arp = [F.col("xyz"[k]) + 7000 * e[k] + off * n[k] + 6000 * u[k] for k in range(3)]
    vel = [200 * n[k] + 10 * e[k] for k in range(3)]
    return p.select("*", *(c.alias(f"a{x}") for c, x in zip(arp, "xyz", strict=True)), *(c.alias(f"v{x}") for c, x in zip(vel, "xyz", strict=True)))


@query(
    "troposphere_delay",
    r.rounded_sql(
        f"""WITH {_TRACKS}, t AS (SELECT id, lat, h, greatest(least(((ax - x) * ux + (ay - y) * uy + (az - z) * uz) / sqrt(pow(ax - x, 2) + pow(ay - y, 2) + pow(az - z, 2)), 1), sin(radians(5))) AS s FROM tracks)
--
SELECT id, 2 * 0.0022768e0 * 1013.25e0 * pow(greatest(1 - 2.25577e-5 * h, 0), 5.25588e0) / (1 - 0.00266e0 * cos(2 * radians(lat)) - 0.00028e0 * h / 1000) / s / 299792458e0 * 1e9 AS ns FROM t""",
        "ns",
        "id",
        5,
    ),
)
def _(spark, d):
    a = geometry.vector("ax", "ay", "az")
    return r.rounded(_tracks(spark, d).select("id", (g.troposphere_delay(a, a, geometry.vector("x", "y", "z")) * 1e9).alias("ns")), 5)


@query(
    "collection_angles",
    r.rounded_sql(
        f"""WITH {_TRACKS}, s AS (SELECT *, sqrt(pow(x - ax, 2) + pow(y - ay, 2) + pow(z - az, 2)) AS rng, sqrt(vx * vx + vy * vy + vz * vz) AS sp FROM tracks),
q AS (SELECT *, (x - ax) / rng AS lx, (y - ay) / rng AS ly, (z - az) / rng AS lz, vx / sp AS wx, vy / sp AS wy, vz / sp AS wz FROM s),
k AS (SELECT *, lx * ux + ly * uy + lz * uz AS lu, ((ay * wz - az * wy) * lx + (az * wx - ax * wz) * ly + (ax * wy - ay * wx) * lz) > 0 AS lft FROM q),
m AS (SELECT *, -lx + lu * ux AS gx, -ly + lu * uy AS gy, -lz + lu * uz AS gz, wy * lz - wz * ly AS cx, wz * lx - wx * lz AS cy, wx * ly - wy * lx AS cz, CASE WHEN lft THEN 1e0 ELSE -1e0 END AS sg FROM k),
o AS (SELECT *, sg * cx / sqrt(cx * cx + cy * cy + cz * cz) AS px, sg * cy / sqrt(cx * cx + cy * cy + cz * cz) AS py, sg * cz / sqrt(cx * cx + cy * cy + cz * cz) AS pz, sqrt(gx * gx + gy * gy + gz * gz) AS gn FROM m),
w AS (SELECT *, ux * px + uy * py + uz * pz AS up FROM o)
--
SELECT id, CASE WHEN lft THEN 'L' ELSE 'R' END AS side, rng AS slant_range, degrees(acos(least(1, wx * lx + wy * ly + wz * lz))) AS cone, degrees(asin(-lu)) AS graze,
  90 - degrees(asin(-lu)) AS incidence, -degrees(asin(((uy * gz - uz * gy) * px + (uz * gx - ux * gz) * py + (ux * gy - uy * gx) * pz) / gn)) AS twist, degrees(acos(least(1, up))) AS slope,
  (degrees(atan2(gx * ex + gy * ey, gx * nx + gy * ny + gz * nz)) + 360) % 360 AS azimuth,
  (degrees(atan2(-px * ex / up - py * ey / up, -(px * nx + py * ny + pz * nz) / up)) + 360) % 360 AS layover FROM w""",
        "slant_range cone graze incidence twist slope azimuth layover",
        "id side",
        4,
    ),
)
def _(spark, d):
    out = geometry.collection_angles(geometry.vector("x", "y", "z"), geometry.vector("ax", "ay", "az"), geometry.vector("vx", "vy", "vz"))
    return r.rounded(_tracks(spark, d).select("id", *(c.alias(n) for n, c in out.items() if n != "ground_range")), 4)


# A broadside collection looking along +x at the origin.
_ANT, _VEL = (-8660.254, 30.0, 5000.0), (1.0, 200.0, 0.5)
_E1, _E2 = (0.0, 1.0, 0.0), (1.0, 0.0, 0.0)
_GROUND = "ground AS (SELECT p_partkey AS id, (p_partkey * 37 % 200) - 100e0 AS x, (p_partkey * 53 % 180) - 90e0 AS y, p_partkey % 30 * 1e0 AS z FROM part)"


def _ground(spark, d):
    k = F.col("p_partkey")
    return r.table(spark, d, "part").select(k.alias("id"), (k * 37 % 200 - 100.0).alias("x"), (k * 53 % 180 - 90.0).alias("y"), (k % 30 * 1.0).alias("z"))


_SPEED = math.sqrt(sum(v * v for v in _VEL))
_W = tuple(v / _SPEED for v in _VEL)
_N = math.hypot(_W[1], _W[0])


@query(
    "project_to_image",
    r.rounded_sql(
        f"""WITH {_GROUND}, w AS (SELECT *, x - ({_ANT[0]!r}) AS wx, y - {_ANT[1]!r} AS wy, z - {_ANT[2]!r} AS wz FROM ground),
k AS (SELECT *, wx * wx + wy * wy + wz * wz AS r2, (wx * {_W[0]!r} + wy * {_W[1]!r} + wz * {_W[2]!r} + ({_ANT[0] * _W[0] + _ANT[1] * _W[1] + _ANT[2] * _W[2]!r})) / {_N**2!r} AS s FROM w),
p AS (SELECT *, s * {_W[0]!r} AS px, s * {_W[1]!r} AS py FROM k),
q AS (SELECT *, (px - ({_ANT[0]!r})) * {_W[1] / _N!r} + (py - {_ANT[1]!r}) * {-_W[0] / _N!r} AS b, pow(px - ({_ANT[0]!r}), 2) + pow(py - {_ANT[1]!r}, 2) + pow({_ANT[2]!r}, 2) - r2 AS c, (x - px) * {_W[1] / _N!r} + (y - py) * {-_W[0] / _N!r} AS lx FROM p),
l AS (SELECT *, CASE WHEN abs(-b - sqrt(b * b - c) - lx) < abs(-b + sqrt(b * b - c) - lx) THEN -b - sqrt(b * b - c) ELSE -b + sqrt(b * b - c) END AS l FROM q WHERE b * b - c >= 0)
--
SELECT id, (py + l * {-_W[0] / _N!r}) / 0.4e0 + 256 AS i, (px + l * {_W[1] / _N!r}) / 0.5e0 + 200 AS j FROM l""",
        "i j",
        "id",
        4,
    ),
)
def _(spark, d):
    i, j = geometry.project(geometry.vector("x", "y", "z"), _ANT, _VEL, (512, 400), (0.4, 0.5), _E1, _E2)
    return r.rounded(_ground(spark, d).select("id", i.alias("i"), j.alias("j")), 4)


def _frame():
    return geometry.slant_frame((0.0, 0.0, 0.0), _ANT, _VEL)


_FR = _frame()
_VV = math.hypot(_FR["v1"], _FR["v2"])
_SLANT = f"""{_GROUND}, w AS (SELECT *, x - ({_ANT[0]!r}) AS wx, y - {_ANT[1]!r} AS wy, z - {_ANT[2]!r} AS wz FROM ground),
k AS (SELECT *, (wx * {_VEL[0]!r} + wy * {_VEL[1]!r} + wz * {_VEL[2]!r}) / {_VV!r} AS al, wx * wx + wy * wy + wz * wz AS r2 FROM w),
m AS (SELECT *, sqrt(greatest(r2 - al * al, 0)) * {math.copysign(1.0, _FR["v1"])!r} AS pe FROM k),
slant AS (SELECT *, (al * {_FR["v1"]!r} - pe * ({_FR["v2"]!r})) / {_VV!r} AS a, (al * ({_FR["v2"]!r}) + pe * {_FR["v1"]!r}) / {_VV!r} - {_FR["r0"]!r} AS r FROM m)"""


@query("ground_to_slant", r.rounded_sql(f"WITH {_SLANT}\n--\nSELECT id, a, r FROM slant", "a r", "id", 4))
def _(spark, d):
    a, rr = geometry.ground_to_slant(_FR, geometry.vector("x", "y", "z"))
    return r.rounded(_ground(spark, d).select("id", a.alias("a"), rr.alias("r")), 4)


@query("slant_round_trip", r.rounded_sql(f"WITH {_GROUND}\n--\nSELECT id, x, y FROM ground", "x y", "id", 4))
def _(spark, d):
    """Ground to slant and back at the same height gives the point again."""
    a, rr = geometry.ground_to_slant(_FR, geometry.vector("x", "y", "z"))
    met = _ground(spark, d).select("id", "z", a.alias("a"), rr.alias("r"))
    x, y, _ = geometry.slant_to_ground(_FR, F.col("a"), F.col("r"), F.col("z"))
    return r.rounded(met.select("id", x.alias("x"), y.alias("y")), 4)


_POLYGON = [(-80.0, -60.0), (10.0, -85.0), (90.0, 0.0), (20.0, 5.0), (40.0, 80.0), (-70.0, 50.0)]
_EDGES = [(*a, *b) for a, b in zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1], strict=True)]


@query("point_in_polygon", f"WITH {_GROUND}, e(x1, y1, x2, y2) AS (VALUES {', '.join('(' + ', '.join(f'{v!r}e0' for v in e) + ')' for e in _EDGES)}) SELECT id, count(x1) % 2 = 1 AS inside FROM ground LEFT JOIN e ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY id")
def _(spark, d):
    return geometry.inside_polygon(_ground(spark, d), spark.createDataFrame(_EDGES, "x1 double, y1 double, x2 double, y2 double"))


@query("shoelace_area", r.rounded_sql("WITH p AS (SELECT l_suppkey % 50 AS g, row_number() OVER (PARTITION BY l_suppkey % 50 ORDER BY l_extendedprice, l_orderkey, l_partkey, l_linenumber, l_quantity, l_tax, l_discount) AS k, l_quantity AS x, l_tax * 100 AS y FROM lineitem), n AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS x1, coalesce(lead(y) OVER w, first(y) OVER w) AS y1 FROM p WINDOW w AS (PARTITION BY g ORDER BY k))\n--\nSELECT g, abs(sum(x * y1 - x1 * y)) / 2 AS area FROM n GROUP BY g", "area", "g", 4))
def _(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy((F.col("l_suppkey") % 50)).orderBy("l_extendedprice", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax", "l_discount"))
    p = r.table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("g"), k.alias("k"), F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"))
    return r.rounded(geometry.shoelace(p, "k", "g"), 4)


@query(
    "image_ratings",
    r.rounded_sql(
        """WITH t AS (SELECT exp(1 - ln(2e0) * 3.4761e0 / 0.4357e0) AS t), s AS (SELECT t, 0.4357e0 / (t * ln(2e0)) AS k FROM t),
v AS (SELECT p_partkey AS id, p_retailprice / 500 AS area, p_size * 1e0 AS snr FROM part), i AS (SELECT *, area * log2(1 + snr) AS d FROM v),
q AS (SELECT *, CASE WHEN d > t THEN 3.4761e0 + 0.4357e0 * log2(d) ELSE k * d END AS rating FROM i, s)
--
SELECT id, d AS density, rating, pow(2e0, (CASE WHEN rating > k * t THEN pow(2e0, (rating - 3.4761e0) / 0.4357e0) ELSE rating / k END) / area) - 1 AS snr FROM q""",
        "density rating snr",
        "id",
    ),
)
def _(spark, d):
    """Rating of a bandwidth area and SNR, and the SNR back from the rating."""
    area, snr = F.col("p_retailprice") / 500, F.col("p_size") * 1.0
    rated = radar.snr_rating(area, snr)
    return r.rounded(r.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (area * F.log2(1 + snr)).alias("density"), rated.alias("rating"), radar.snr_for(area, rated).alias("snr")))


@query("taylor_window", r.rounded_sql(f"SELECT c_custkey AS n, 1 {''.join(f' + 2 * ({c!r}) * cos(2 * pi() * {m} * (c_custkey - k / 2e0 + 0.5e0) / k)' for m, c in enumerate(radar.taylor_terms(), 1))} AS w FROM customer, (SELECT count(*) AS k FROM customer)".replace("SELECT c_", "\n--\nSELECT c_", 1), "w", "n"))
def _(spark, d):
    t = r.table(spark, d, "customer")
    met = t.crossJoin(F.broadcast(t.agg(F.count("*").alias("k"))))
    return r.rounded(met.select(F.col("c_custkey").alias("n"), radar.taylor(F.col("c_custkey"), F.col("k") * 1.0).alias("w")))


@query("antenna_patterns", r.rounded_sql("WITH u AS (SELECT p_partkey AS id, (p_partkey % 401 - 200) / 100e0 AS u FROM part)\n--\nSELECT id, CASE WHEN u = 0 THEN 1e0 ELSE pow(sin(pi() * u) / (pi() * u), 2) END AS sinc2, exp(-ln(2e0) * pow(u / 0.31882e0, 2)) AS gauss FROM u", "sinc2 gauss", "id"))
def _(spark, d):
    u = (F.col("p_partkey") % 401 - 200) / 100.0
    return r.rounded(r.table(spark, d, "part").select(F.col("p_partkey").alias("id"), radar.pattern(u).alias("sinc2"), radar.pattern(u, "gauss").alias("gauss")))


@query("doppler_axis", r.rounded_sql("WITH f AS (SELECT s_suppkey AS n, CASE WHEN s_suppkey < (k + 1) // 2 THEN s_suppkey ELSE s_suppkey - k END * 650e0 / k AS f FROM supplier, (SELECT count(*) AS k FROM supplier))\n--\nSELECT n, 120 + ((f - 120 + 325) % 650 + 650) % 650 - 325 AS f FROM f", "f", "n"))
def _(spark, d):
    """Unwrapped Doppler frequencies within half the pulse rate of the centroid."""
    t = r.table(spark, d, "supplier")
    n = F.col("s_suppkey")
    f = F.when(n < F.floor((F.col("k") + 1) / 2), n).otherwise(n - F.col("k")) * 650.0 / F.col("k")
    return r.rounded(t.crossJoin(F.broadcast(t.agg(F.count("*").alias("k")))).select(n.alias("n"), (120 + F.pmod(f - 120 + 325, F.lit(650.0)) - 325).alias("f")))


@query("chirp_replica", r.rounded_sql("WITH t AS (SELECT n, n / 5e7 AS t FROM (SELECT unnest(range(1000)) AS n)), c AS (SELECT n, -1e7 * t + 2e11 * t * t AS c FROM t)\n--\nSELECT n, cos(2 * pi() * (c - round(c))) AS re, sin(2 * pi() * (c - round(c))) AS im FROM c", "re im", "n"))
def _(spark, d):
    """exp(j 2 pi (f0 t + k t^2 / 2)) sampled at 50 MHz."""
    t = F.col("id") / 5e7
    re, im = cx.turn(-1e7 * t + 2e11 * t * t)
    return r.rounded(spark.range(1000).select(F.col("id").alias("n"), re.alias("re"), im.alias("im")))


@query(
    "orbit_hermite",
    r.rounded_sql(
        """WITH e AS (SELECT user_id % 40 AS u, epoch_us(ts) / 1000000 AS t, value AS x, value / 1000 AS v FROM events), s AS (SELECT u, t, avg(x) AS x, avg(v) AS v FROM e GROUP BY u, t),
l AS (SELECT *, lead(t) OVER w AS t1, lead(x) OVER w AS x1, lead(v) OVER w AS v1 FROM s WINDOW w AS (PARTITION BY u ORDER BY t)), q AS (SELECT u, k * 3600e0 + 1704067200 AS t FROM (SELECT unnest(range(40)) AS u), (SELECT unnest(range(0, 720, 6)) AS k)),
m AS (SELECT q.u, q.t, l.x, l.v, l.x1, l.v1, l.t1 - l.t AS h, (q.t - l.t) / (l.t1 - l.t) AS s FROM q ASOF LEFT JOIN l ON q.u = l.u AND q.t >= l.t)
--
SELECT u, t, (2 * s * s * s - 3 * s * s + 1) * x + (s * s * s - 2 * s * s + s) * h * v + (3 * s * s - 2 * s * s * s) * x1 + (s * s * s - s * s) * h * v1 AS x FROM m""",
        "t x",
        "u",
        3,
    ),
)
def _(spark, d):
    e = r.table(spark, d, "events").select((F.col("user_id") % 40).alias("u"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"), F.col("value").alias("x"), (F.col("value") / 1000).alias("v"))
    states = e.groupBy("u", "t").agg(F.avg("x").alias("x"), F.avg("v").alias("v"))
    times = spark.range(40).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(714), F.lit(6))).alias("k")).select("u", (F.col("k") * 3600.0 + 1704067200).alias("t"))
    return r.rounded(geometry.hermite(states, times, "u"), 3)


@query(
    "fill_gaps",
    r.rounded_sql(
        """WITH t AS (SELECT o_orderkey % 20 AS id, o_orderkey AS p, (o_orderkey // 20) * 2e0 AS x, (o_orderkey // 20) * 1e0 AS y, 0e0 AS z FROM orders WHERE o_orderkey // 20 % 7 <> 3),
n AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM t WINDOW w AS (PARTITION BY id ORDER BY p)), s AS (SELECT *, sqrt(pow(x1 - x, 2) + pow(y1 - y, 2) + pow(z1 - z, 2)) AS step FROM n),
m AS (SELECT *, CAST(coalesce(greatest(round(step / quantile_cont(step, 0.5) OVER (PARTITION BY id)), 1), 1) AS BIGINT) AS m FROM s), k AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n0 FROM m),
e AS (SELECT *, unnest(range(m)) AS k FROM k)
--
SELECT id, CAST(n0 + k AS BIGINT) AS n, CASE WHEN k = 0 THEN x ELSE (1 - k / m) * x + k / m * x1 END AS x, CASE WHEN k = 0 THEN y ELSE (1 - k / m) * y + k / m * y1 END AS y, CASE WHEN k = 0 THEN z ELSE (1 - k / m) * z + k / m * z1 END AS z, k > 0 AS inserted FROM e""",
        "x y z",
        "id n inserted",
    ),
)
def _(spark, d):
    k = F.col("o_orderkey")
    row = F.floor(k / 20)
    t = r.table(spark, d, "orders").filter(row % 7 != 3).select((k % 20).alias("id"), k.alias("p"), (row * 2.0).alias("x"), (row * 1.0).alias("y"), F.lit(0.0).alias("z"))
    return r.rounded(geometry.fill_gaps(t))


@query("beam_spans", "WITH a AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 1000) * 1e0 AS x FROM supplier), b AS (SELECT o_orderkey AS p, o_orderkey / 10e0 AS center FROM orders) SELECT id, min(p) AS first, max(p) AS last FROM a JOIN b ON abs(x - center) <= 25 GROUP BY id")
def _(spark, d):
    k = F.col("s_suppkey")
    patches = r.table(spark, d, "supplier").select(k.alias("id"), (k * 37 % 1000 * 1.0).alias("x"))
    pulses = r.table(spark, d, "orders").select(F.col("o_orderkey").alias("p"), (F.col("o_orderkey") / 10.0).alias("center"))
    return geometry.beam_spans(patches, pulses, 25.0, 25.0)


# A small scene: scatterers from part keys, a broadside track from supplier keys.
_FMIN, _DF, _K = 9.4e9, 2.5e6, 24
_SMALL = f"""s AS (SELECT (p_partkey % 40 - 20) * 0.4e0 AS x, (p_partkey // 40 % 40 - 20) * 0.4e0 AS y, 0e0 AS z, p_retailprice / 1000 AS amp FROM part),
a AS (SELECT s_suppkey AS p, -8660.254e0 AS ax, (s_suppkey - 4.5e0) * 2.5e0 AS ay, 5000e0 AS az FROM supplier),
hist AS (SELECT p, k, sum(amp * cos(2 * pi() * (c - round(c)))) AS re, sum(amp * sin(2 * pi() * (c - round(c)))) AS im FROM (
  SELECT p, k, amp, -2 * ({_FMIN!r} + k * {_DF!r}) / 299792458e0 * (sqrt(pow(x - ax, 2) + pow(y - ay, 2) + pow(z - az, 2)) - sqrt(ax * ax + ay * ay + az * az)) AS c FROM s, a, (SELECT unnest(range({_K})) AS k)) GROUP BY p, k)"""


def _small(spark, d):
    k = F.col("p_partkey")
    s = r.table(spark, d, "part").select(((k % 40 - 20) * 0.4).alias("x"), ((F.floor(k / 40) % 40 - 20) * 0.4).alias("y"), F.lit(0.0).alias("z"), (F.col("p_retailprice") / 1000).alias("amp"))
    p = F.col("s_suppkey")
    a = r.table(spark, d, "supplier").select(p.alias("p"), F.lit(-8660.254).alias("ax"), ((p - 4.5) * 2.5).alias("ay"), F.lit(5000.0).alias("az"))
    return s, a


@query("simulate_echoes", r.rounded_sql(f"WITH {_SMALL}\n--\nSELECT p, CAST(k AS INTEGER) AS k, re, im FROM hist", "re im", "p k", 5))
def _(spark, d):
    return r.rounded(formation.simulate(*_small(spark, d), _FMIN, _DF, _K), 5)


@query(
    "backproject_exact",
    r.rounded_sql(
        f"""WITH {_SMALL}, g AS (SELECT i * 16 + j AS id, (i - 8) * 1e0 AS x, (j - 8) * 1e0 AS y FROM (SELECT unnest(range(16)) AS i), (SELECT unnest(range(16)) AS j)),
c AS (SELECT id, re, im, 2 * ({_FMIN!r} + k * {_DF!r}) / 299792458e0 * (sqrt(pow(x - ax, 2) + pow(y - ay, 2) + az * az) - sqrt(ax * ax + ay * ay + az * az)) AS c FROM hist JOIN a USING (p), g)
--
SELECT id, sum(re * cos(2 * pi() * (c - round(c))) - im * sin(2 * pi() * (c - round(c)))) AS re, sum(re * sin(2 * pi() * (c - round(c))) + im * cos(2 * pi() * (c - round(c)))) AS im FROM c GROUP BY id""",
        "re im",
        "id",
        3,
    ),
)
def _(spark, d):
    s, a = _small(spark, d)
    points = spark.range(256).select("id", (F.floor(F.col("id") / 16) - 8.0).alias("x"), (F.col("id") % 16 - 8.0).alias("y"), F.lit(0.0).alias("z"))
    return r.rounded(formation.backproject(formation.simulate(s, a, _FMIN, _DF, _K), a, points, _FMIN, _DF), 3)
