"""Between images and the Earth: pixels on a surface, map grids, elevation tiles, and images on another plane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy as g
from . import geometry, raster

# The WGS-84 ellipsoid.
_A, _E2 = 6378137.0, 6.69437999014e-3


def _height(p: np.ndarray) -> np.ndarray:
    """Geodetic height of Earth-fixed points, by a few fixed-point steps of the latitude."""
    r = np.hypot(p[:, 0], p[:, 1])
    lat = np.arctan2(p[:, 2], r * (1 - _E2))
    for _ in range(5):
        n = _A / np.sqrt(1 - _E2 * np.sin(lat) ** 2)
        lat = np.arctan2(p[:, 2] + _E2 * n * np.sin(lat), r)
    n = _A / np.sqrt(1 - _E2 * np.sin(lat) ** 2)
    return r * np.cos(lat) + p[:, 2] * np.sin(lat) - _A * _A / n


def geolocate(points: DataFrame, antenna: tuple, velocity: tuple, height: float = 0.0, iterations: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """(id, x, y, z): where range and Doppler of Earth-fixed points (id, x, y, z) meet the surface at a geodetic height.

    All places with a point's range and range rate lie on a circle about the track; a damped Newton search turns
    along it from the point itself to the surface.  Null coordinates where it is not reached.
    """
    a, v = np.array(antenna, float), np.array(velocity, float)
    v = v / np.linalg.norm(v)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            p = np.stack([table.column(c).to_numpy() for c in "xyz"], 1).astype(float)
            center = a + ((p - a) @ v)[:, None] * v
            arm = p - center
            across = np.cross(v, arm)
            angle = np.zeros(len(p))
            at = lambda t: center + np.cos(t)[:, None] * arm + np.sin(t)[:, None] * across
            for _ in range(iterations):
                miss = _height(at(angle)) - height
                slope = (_height(at(angle + 1e-7)) - height - miss) / 1e-7
                angle -= np.clip(np.divide(miss, slope, out=np.zeros_like(miss), where=slope != 0), -0.1, 0.1)
            out = at(angle)
            ok = np.abs(_height(out) - height) <= max(tolerance, 1e-3)
            yield pa.RecordBatch.from_arrays([table.column("id"), *(pa.array(out[:, c], mask=~ok) for c in range(3))], names=["id", "x", "y", "z"])

    return points.select(F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in "xyz")).mapInArrow(run, "id long, x double, y double, z double")


def map_grid(spark, south: float, west: float, step: float, rows: int, columns: int) -> DataFrame:
    """(id, lat, lon): the pixels of a geographic grid, row by row from the south-west."""
    ids = spark.range(rows * columns)
    return ids.select("id", (south + F.floor(F.col("id") / columns) * step).alias("lat"), (west + F.col("id") % columns * step).alias("lon"))


def geocode(image: DataFrame, value: str, grid: DataFrame, to_pixel) -> DataFrame:
    """(id, value) of a geographic grid (id, lat, lon): the image read bilinearly where ``to_pixel`` (Earth-fixed vector to
    columns x, y) puts a grid point at height 0; null outside."""
    x, y = to_pixel(g.to_ecf(F.col("lat"), F.col("lon"), F.lit(0.0)))
    return raster.bilinear(image, grid.select("id", x.alias("x"), y.alias("y")), value)


def merged_tiles(tiles: DataFrame) -> DataFrame:
    """(i, j, h) of elevation tiles (tile, i, j, h) on one grid: the first tile with a height wins."""
    return tiles.filter(F.col("h").isNotNull() & ~F.isnan("h")).groupBy("i", "j").agg(F.min_by("h", "tile").alias("h"))


def to_plane(image: DataFrame, frame: dict, slant: tuple[float, float, float, float], spacing: tuple[float, float], shape: tuple[int, int], origin: tuple[float, float]) -> DataFrame:
    """A slant-plane image (i, j, re, im) read on ground pixels (i, j) of height 0: pixel (0, 0) at ``origin``, ``spacing`` apart.

    ``slant``: azimuth and range of its first pixel and its two spacings; ``frame`` is that of geometry.slant_frame.
    """
    n, m = shape
    cells = image.sparkSession.range(n * m).select("id", (origin[0] + F.floor(F.col("id") / m) * spacing[0]).alias("gx"), (origin[1] + F.col("id") % m * spacing[1]).alias("gy"))
    a, r = geometry.ground_to_slant(frame, (F.col("gx"), F.col("gy"), F.lit(0.0)))[:2]
    points = cells.select("id", ((a - slant[0]) / slant[2]).alias("x"), ((r - slant[1]) / slant[3]).alias("y"))
    re, im = (raster.bilinear(image.select("i", "j", c), points, c) for c in ("re", "im"))
    return re.join(im, "id").select(F.floor(F.col("id") / m).alias("i"), (F.col("id") % m).alias("j"), "re", "im")


def gain(table: DataFrame, points: DataFrame, first: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """(id, gain) of directions (id, u, v) from a gain table (i, j, gain) with its first direction and steps; null outside."""
    return raster.bilinear(table, points.select("id", ((F.col("u") - first[0]) / step[0]).alias("x"), ((F.col("v") - first[1]) / step[1]).alias("y")), "gain")


def boresight(yaw: Column, pitch: Column, roll: Column) -> g.Vector:
    """The direction of a beam along -z of a body after roll, pitch and yaw (radians) about x, y and z."""
    x, y, z = F.sin(pitch) * F.cos(roll), -F.sin(roll), F.cos(pitch) * F.cos(roll)
    return -(x * F.cos(yaw) - y * F.sin(yaw)), -(x * F.sin(yaw) + y * F.cos(yaw)), -z
