"""WGS-84 coordinates, local axes and the standard atmosphere, as column expressions in metres and degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS-84 ellipsoid and the speed of light.
A = 6378137.0
FLATTENING = 1 / 298.257223563
B = A * (1 - FLATTENING)
E2 = FLATTENING * (2 - FLATTENING)
EP2 = E2 / (1 - E2)
C = 299792458.0

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Vector, k: Column) -> Vector:
    return a[0] * k, a[1] * k, a[2] * k


def unit(a: Vector) -> Vector:
    return scaled(a, 1 / norm(a))


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def to_ecf(lat: Column, lon: Column, height: Column) -> Vector:
    """Geodetic degrees and metres to Earth-fixed coordinates."""
    la, lo = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(la) * F.sin(la))
    return (n + height) * F.cos(la) * F.cos(lo), (n + height) * F.cos(la) * F.sin(lo), (n * (1 - E2) + height) * F.sin(la)


def to_geodetic(p: Vector) -> Vector:
    """Earth-fixed coordinates to (latitude, longitude, height), by Bowring's closed form."""
    r = F.hypot(p[0], p[1])
    theta = F.atan2(p[2] * A, r * B)
    s, c = F.sin(theta), F.cos(theta)
    la = F.atan2(p[2] + EP2 * B * s * s * s, r - E2 * A * c * c * c)
    n = A / F.sqrt(1 - E2 * F.sin(la) * F.sin(la))
    return F.degrees(la), F.degrees(F.atan2(p[1], p[0])), r / F.cos(la) - n


def enu(lat: Column, lon: Column) -> tuple[Vector, Vector, Vector]:
    """East, north and up unit vectors."""
    la, lo = F.radians(lat), F.radians(lon)
    return (-F.sin(lo), F.cos(lo), F.lit(0.0)), (-F.sin(la) * F.cos(lo), -F.sin(la) * F.sin(lo), F.cos(la)), (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))


def placed(p: Vector, lat: Column, lon: Column, height: Column, heading: Column) -> Vector:
    """A point of a scene frame (x across track, y along track, z up) at a place on Earth and a track heading."""
    h = F.radians(heading)
    local = p[0] * F.cos(h) + p[1] * F.sin(h), -p[0] * F.sin(h) + p[1] * F.cos(h), p[2]
    axes, origin = enu(lat, lon), to_ecf(lat, lon, height)
    return tuple(origin[k] + sum((local[m] * axes[m][k] for m in range(1, 3)), local[0] * axes[0][k]) for k in range(3))


def troposphere_delay(tx: Vector, rcv: Vector, point: Vector) -> Column:
    """Two-way hydrostatic delay in seconds (Saastamoinen zenith delay, cosecant mapping, 5 degrees at least)."""
    lat, lon, h = to_geodetic(point)
    up = enu(lat, lon)[2]
    hpa = 1013.25 * F.pow(F.greatest(1 - 2.25577e-5 * h, F.lit(0.0)), F.lit(5.25588))
    zenith = 0.0022768 * hpa / (1 - 0.00266 * F.cos(2 * F.radians(lat)) - 0.00028 * h / 1000)
    total = None
    for antenna in (tx, rcv):
        d = minus(antenna, point)
        way = zenith / F.least(F.greatest(dot(d, up) / norm(d), F.sin(F.radians(F.lit(5.0)))), F.lit(1.0))
        total = way if total is None else total + way
    return total / C
