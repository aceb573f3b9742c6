"""Geometry of images and collections: projections, planes, polygons, orbits, pulses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geodesy as g

Point = tuple[float, float, float]


def vector(*names: str) -> g.Vector:
    return tuple(F.col(n) for n in names)


def constant(p: Point) -> g.Vector:
    return tuple(F.lit(float(v)) for v in p)


def project(x: g.Vector, antenna: Point, velocity: Point, shape: tuple[int, int], spacing: tuple[float, float], e1: Point, e2: Point) -> tuple[Column, Column]:
    """Pixel (i, j) at which a point appears: same range and Doppler, of two solutions that nearer the point; null if none."""
    length = math.sqrt(sum(v * v for v in velocity))
    a, v = antenna, tuple(c / length for c in velocity)
    inner = lambda p, q: sum(s * t for s, t in zip(p, q, strict=True))
    g1, g2 = inner(e1, v), inner(e2, v)
    n = math.hypot(g1, g2)
    d = tuple((-g2 * p + g1 * q) / n for p, q in zip(e1, e2, strict=True))
    along = tuple((g1 * p + g2 * q) / n**2 for p, q in zip(e1, e2, strict=True))
    w = g.minus(x, constant(a))
    p0 = tuple((g.dot(w, constant(v)) + inner(a, v)) * c for c in along)
    off = g.minus(p0, constant(a))
    b = g.dot(off, constant(d))
    disc = b * b - (g.dot(off, off) - g.dot(w, w))
    root = F.when(disc >= 0, F.sqrt(disc))
    at = g.dot(g.minus(x, p0), constant(d))
    step = F.when(F.abs(-b - root - at) < F.abs(-b + root - at), -b - root).otherwise(-b + root)
    p = tuple(p0[k] + step * d[k] for k in range(3))
    return g.dot(p, constant(e1)) / spacing[0] + shape[0] / 2.0, g.dot(p, constant(e2)) / spacing[1] + shape[1] / 2.0


def slant_frame(scp: Point, antenna: Point, velocity: Point) -> dict:
    """Axes of the slant plane at a scene point, on the driver."""
    diff = [s - a for s, a in zip(scp, antenna, strict=True)]
    r0 = math.sqrt(sum(d * d for d in diff))
    e2 = [d / r0 for d in diff]
    v = velocity
    n = [e2[1] * v[2] - e2[2] * v[1], e2[2] * v[0] - e2[0] * v[2], e2[0] * v[1] - e2[1] * v[0]]
    size = math.copysign(math.sqrt(sum(c * c for c in n)), n[2])
    n = [c / size for c in n]
    e1 = [e2[1] * n[2] - e2[2] * n[1], e2[2] * n[0] - e2[0] * n[2], e2[0] * n[1] - e2[1] * n[0]]
    return {"arp": antenna, "vel": v, "r0": r0, "v1": sum(a * b for a, b in zip(v, e1, strict=True)), "v2": sum(a * b for a, b in zip(v, e2, strict=True))}


def ground_to_slant(frame: dict, p: g.Vector) -> tuple[Column, Column]:
    """Slant-plane (azimuth, range) with the range and range rate of a ground point."""
    w = g.minus(p, constant(frame["arp"]))
    v1, v2 = frame["v1"], frame["v2"]
    v = math.hypot(v1, v2)
    along = g.dot(w, constant(frame["vel"])) / v
    across = F.sqrt(F.greatest(g.dot(w, w) - along * along, F.lit(0.0))) * math.copysign(1, v1)
    return (along * v1 - across * v2) / v, (along * v2 + across * v1) / v - frame["r0"]


def slant_to_ground(frame: dict, a: Column, r: Column, z: Column) -> g.Vector:
    """The point at height z that slant-plane coordinates show, on the side of the scene; null if out of reach."""
    arp, vel = frame["arp"], frame["vel"]
    q = frame["r0"] + r
    range2, rate = a * a + q * q, a * frame["v1"] + q * frame["v2"]
    dz = z - arp[2]
    flat2 = range2 - dz * dz
    level = math.hypot(vel[0], vel[1])
    ux, uy = vel[0] / level, vel[1] / level
    s = (rate - dz * vel[2]) / level
    rest = flat2 - s * s
    t = F.when(rest >= 0, F.sqrt(rest))
    side = 1.0 if frame["v1"] * (-arp[0] * -uy - arp[1] * ux) * math.copysign(1, frame["v1"]) >= 0 else -1.0
    return arp[0] + s * ux - side * t * uy, arp[1] + s * uy + side * t * ux, z


def collection_angles(scp: g.Vector, arp: g.Vector, vel: g.Vector) -> dict[str, Column]:
    """Range and angles (degrees) of the line of sight at the centre of aperture."""
    los = g.minus(scp, arp)
    to, speed, up = g.unit(los), g.unit(vel), g.enu(*g.to_geodetic(scp)[:2])[2]
    bound = lambda c: F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))
    left = g.dot(g.cross(g.unit(arp), speed), to) > 0
    sin_graze = bound(-g.dot(to, up))
    normal = g.scaled(g.unit(g.cross(speed, to)), F.when(left, 1.0).otherwise(-1.0))
    north = g.unit(g.minus((F.lit(0.0), F.lit(0.0), F.lit(1.0)), g.scaled(up, up[2])))
    east = g.cross(north, up)
    toward = g.unit(g.minus(g.scaled(to, F.lit(-1.0)), g.scaled(up, -g.dot(to, up))))
    lay = g.minus(up, g.scaled(normal, 1 / g.dot(up, normal)))
    bearing = lambda v: F.pmod(F.degrees(F.atan2(g.dot(v, east), g.dot(v, north))), F.lit(360.0))
    return {
        "side": F.when(left, F.lit("L")).otherwise(F.lit("R")),
        "slant_range": g.norm(los),
        "ground_range": g.norm(scp) * F.acos(bound(g.dot(g.unit(arp), g.unit(scp)))),
        "cone": F.degrees(F.acos(bound(g.dot(speed, to)))),
        "graze": F.degrees(F.asin(sin_graze)),
        "incidence": 90.0 - F.degrees(F.asin(sin_graze)),
        "twist": -F.degrees(F.asin(bound(g.dot(g.cross(up, toward), normal)))),
        "slope": F.degrees(F.acos(bound(g.dot(up, normal)))),
        "azimuth": bearing(toward),
        "layover": bearing(lay),
    }


def inside_polygon(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, inside) by the even-odd rule, for points (id, x, y) and polygon edges (x1, y1, x2, y2).

    A polygon is a few edges, broadcast for a nested-loop join with the crossing as its condition.
    """
    crosses = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    right = F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    few = edges.limit(10_001)
    if few.count() > 10_000:
        raise ValueError("a polygon of more than 10,000 edges")
    hits = points.join(F.broadcast(few), crosses & right).groupBy("id").count()
    return points.select("id").join(hits, "id", "left").select("id", (F.coalesce("count", F.lit(0)) % 2 == 1).alias("inside"))


def shoelace(points: DataFrame, order: str, by: str) -> DataFrame:
    """Area of the polygon of each group, vertices in order."""
    ring = Window.partitionBy(by).orderBy(order)
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx = F.coalesce(F.lead("x").over(ring), F.first("x").over(whole))
    ny = F.coalesce(F.lead("y").over(ring), F.first("y").over(whole))
    return points.withColumn("_t", F.col("x") * ny - nx * F.col("y")).groupBy(by).agg((F.abs(F.sum("_t")) / 2).alias("area"))


def hermite(states: DataFrame, times: DataFrame, by: str) -> DataFrame:
    """Positions at times (by, t) from state vectors (by, t, x, v): as-of join to the last state and the next one.

    States and times are one sorted stream per key, so no pair of them is ever formed; null outside the states.
    """
    nxt = Window.partitionBy(by).orderBy("t")
    legs = states.select(by, "t", F.struct("t", "x", "v", F.lead("t").over(nxt).alias("t1"), F.lead("x").over(nxt).alias("x1"), F.lead("v").over(nxt).alias("v1")).alias("leg"))
    both = legs.select(by, "t", F.lit(0).alias("kind"), "leg").unionByName(times.select(by, "t", F.lit(1).alias("kind")), allowMissingColumns=True)
    last = F.last("leg", ignorenulls=True).over(Window.partitionBy(by).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = both.withColumn("leg", last).filter("kind = 1")
    h = F.col("leg.t1") - F.col("leg.t")
    s = (F.col("t") - F.col("leg.t")) / h
    value = (2 * s * s * s - 3 * s * s + 1) * F.col("leg.x") + (s * s * s - 2 * s * s + s) * h * F.col("leg.v") + (3 * s * s - 2 * s * s * s) * F.col("leg.x1") + (s * s * s - s * s) * h * F.col("leg.v1")
    return met.select(by, "t", value.alias("x"))


def fill_gaps(track: DataFrame) -> DataFrame:
    """Even tracks (id, p, x, y, z): where a step is m >= 2 times the median step, m - 1 places are put on the line.

    Results: id, n (place in the filled track), x, y, z, inserted.
    """
    line = Window.partitionBy("id").orderBy("p")
    nxt = {c: F.lead(c).over(line) for c in "xyz"}
    step = F.sqrt(sum(((nxt[c] - F.col(c)) * (nxt[c] - F.col(c)) for c in "yz"), (nxt["x"] - F.col("x")) * (nxt["x"] - F.col("x"))))
    met = track.select("id", "p", "x", "y", "z", *(nxt[c].alias(f"{c}1") for c in "xyz"), step.alias("step"))
    median = met.groupBy("id").agg(F.percentile("step", F.lit(0.5)).alias("median"))
    met = met.join(median, "id").withColumn("m", F.when(F.col("median") > 0, F.greatest(F.rint(F.col("step") / F.col("median")), F.lit(1.0))).otherwise(1.0).cast("long")).withColumn("m", F.coalesce("m", F.lit(1)))
    before = F.coalesce(F.sum("m").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = met.withColumn("n0", before).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("k"))
    f = F.col("k") / F.col("m")
    return out.select("id", (F.col("n0") + F.col("k")).alias("n"), *(F.when(F.col("k") == 0, F.col(c)).otherwise((1 - f) * F.col(c) + f * F.col(f"{c}1")).alias(c) for c in "xyz"), (F.col("k") > 0).alias("inserted"))


def beam_spans(patches: DataFrame, pulses: DataFrame, limit: float, cell: float) -> DataFrame:
    """First and last pulse whose beam covers a patch: |x - center| <= limit, for patches (id, x) and pulses (p, center).

    A range join without a cross product: both sides are cut in cells of width ``cell`` >= limit, and
    a patch is sought in its own cell and the two beside it.
    """
    near = patches.select("id", "x", F.explode(F.array(*(F.floor(F.col("x") / cell) + k for k in (-1, 0, 1)))).alias("cell"))
    there = pulses.select("p", "center", F.floor(F.col("center") / cell).alias("cell"))
    return near.join(there, "cell").filter(F.abs(F.col("x") - F.col("center")) <= limit).groupBy("id").agg(F.min("p").alias("first"), F.max("p").alias("last"))
