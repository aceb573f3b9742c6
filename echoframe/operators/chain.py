"""From phase-history files to images, products and stacks, built from the operators."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesy import C
from . import focus, lines, raster
from .estimate import tile_shifts


@dataclass
class Frame:
    """A local frame: its origin on Earth, and the axes (azimuth, range on the ground, up) as rows."""

    origin: np.ndarray
    axes: np.ndarray


@dataclass
class Scene:
    """A collection in a local frame: pulses (p, ax, ay, az, re, im), one frequency grid, and the resolution in azimuth and range."""

    pulses: DataFrame
    fmin: float
    df: float
    k: int
    frame: Frame
    resolution: tuple[float, float]
    middle: np.ndarray


def _geometry(spark: SparkSession, path: str, options: dict) -> list:
    """Positions and frequencies of the pulses, read without their samples."""
    rows = spark.read.format("cphd").options(**options, metadata="true").load(path).select("p", "tx", "rcv", "srp", "sc0", "scss").orderBy("p").collect()
    if not rows:
        raise ValueError(f"{path}: no pulses")
    return rows


def frame_of(rows: list) -> Frame:
    """Origin at the mean reference point, up by its direction from the Earth's centre, range away from the middle antenna."""
    origin = np.mean([r.srp for r in rows], 0)
    up = origin / np.linalg.norm(origin) if np.linalg.norm(origin) > 1e3 else np.array([0, 0, 1.0])
    middle = rows[len(rows) // 2]
    look = origin - (np.array(middle.tx) + np.array(middle.rcv)) / 2
    away = look - (look @ up) * up
    away /= np.linalg.norm(away)
    return Frame(origin, np.stack([np.cross(away, up), away, up]))


def open_scene(spark: SparkSession, path: str, frame: Frame | None = None, **options) -> Scene:
    """A file's channel as a scene; ``options`` go to the reader (channel, pulses, samples).

    The antenna stands halfway between transmitter and receiver.  Phases are turned from each pulse's own
    reference point to the frame's origin; pulses with frequencies of their own are read on one grid.
    """
    rows = _geometry(spark, path, options)
    frame = frame or frame_of(rows)
    place = {r.p: frame.axes @ ((np.array(r.tx) + np.array(r.rcv)) / 2 - frame.origin) for r in rows}
    srp = {r.p: frame.axes @ (np.array(r.srp) - frame.origin) for r in rows}
    read = spark.read.format("cphd").options(**options).load(path).select("p", "tx", "rcv", "srp", "sc0", "scss", "re", "im")
    k = read.agg(F.max(F.size("re"))).first()[0]
    fmin, fmax = max(r.sc0 for r in rows), min(r.sc0 + (k - 1) * r.scss for r in rows)
    df = (fmax - fmin) / (k - 1)
    origin, axes = frame.origin, frame.axes

    def turned(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = fmin + np.arange(k) * df
        for table in tables:
            out = []
            for r in table.to_pylist():
                a = axes @ ((np.array(r["tx"]) + np.array(r["rcv"])) / 2 - origin)
                s = np.array(r["re"]) + 1j * np.array(r["im"])
                if abs(r["sc0"] - fmin) > 1e-3 * df or abs(r["scss"] - df) > 1e-6 * df:
                    s = lines.sinc_read(s, (f - r["sc0"]) / r["scss"], 16)
                shift = np.linalg.norm(axes @ (np.array(r["srp"]) - origin) - a) - np.linalg.norm(a)
                s = s * np.exp(-4j * np.pi * f / C * shift)
                out.append((r["p"], *a, s.real, s.imag))
            kinds = [pa.int64(), *[pa.float64()] * 3, *[pa.list_(pa.float64())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 6, kinds, strict=True)], names=["p", "ax", "ay", "az", "re", "im"])

    pulses = read.mapInArrow(turned, "p long, ax double, ay double, az double, re array<double>, im array<double>")
    looks = np.array([(srp[p] - a) / np.linalg.norm(srp[p] - a) for p, a in place.items()])
    graze = math.asin(min(1.0, abs(float(looks.mean(0)[2]))))
    turn = float(np.ptp(np.arctan2(looks[:, 0], looks[:, 1])))
    fc = (fmin + fmax) / 2
    resolution = (C / (2 * fc * max(turn, 1e-9) * math.cos(graze)), C / (2 * (fmax - fmin) * math.cos(graze)))
    return Scene(pulses, fmin, df, k, frame, resolution, place[rows[len(rows) // 2].p])


def form_file(spark: SparkSession, path: str, shape: tuple[int, int], spacing: tuple[float, float] | None = None, algorithm: str = "factorized", frame: Frame | None = None, focused: bool = False, **options) -> tuple[DataFrame, Scene, focus.Grid]:
    """Pixels (i, j, re, im) of a file about its reference point; i is azimuth, j ground range, pixel (n/2, m/2) the origin."""
    scene = open_scene(spark, path, frame, **options)
    spacing = spacing or tuple(r / 1.3 for r in scene.resolution)
    grid = focus.Grid(*shape, *spacing)
    image = focus.form(scene.pulses, grid, fmin=scene.fmin, df=scene.df, k=scene.k, algorithm=algorithm)
    return (autofocus(image, scene, grid) if focused else image), scene, grid


def deramped(image: DataFrame, scene: Scene, grid: focus.Grid, sign: int = -1) -> DataFrame:
    """An image times exp(sign 4 pi j fc (R - R0) / c), R from the middle antenna: its band is then about zero."""
    from ..functions import cx

    x = [(F.col("i") - grid.nx / 2) * grid.spx * float(grid.e1[c]) + (F.col("j") - grid.ny / 2) * grid.spy * float(grid.e2[c]) - float(scene.middle[c]) for c in range(3)]
    dr = F.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2]) - float(np.linalg.norm(scene.middle))
    re, im = cx.times(cx.pair("re", "im"), cx.turn(sign * 2 * (scene.fmin + scene.k * scene.df / 2) / C * dr))
    return image.select("i", "j", re.alias("re"), im.alias("im"))


def autofocus(image: DataFrame, scene: Scene, grid: focus.Grid, **options) -> DataFrame:
    """An image without its common azimuth phase error: deramp, phase gradient along azimuth columns, ramp again."""
    columns = lines.to_lines(deramped(image, scene, grid), "j", "i")
    fixed, _ = focus.phase_gradient(columns, grid.nx, **options)
    return deramped(lines.to_pixels(fixed, "j", "i"), scene, grid, 1)


def detected(image: DataFrame) -> DataFrame:
    """Amplitudes (i, j, a)."""
    return image.select("i", "j", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("a"))


def process(spark: SparkSession, path: str, output: str, shape: tuple[int, int], *, product: str = "png", remap: str = "nrl", weighting: str = "none", focused: bool = False, **options) -> DataFrame:
    """A file formed, weighted (``none`` or ``sva``), and written as a display image (``png``) or complex image (``nitf``); the pixels."""
    from ..sources import nitf, png

    image, _, _ = form_file(spark, path, shape, focused=focused, **options)
    if weighting not in ("none", "sva"):
        raise ValueError(f"unknown weighting {weighting!r}")
    image = (raster.sva(image) if weighting == "sva" else image).persist()
    if product == "png":
        png.write(raster.remap(detected(image), remap), output)
    elif product == "nitf":
        nitf.write(lines.to_lines(image), output)
    else:
        raise ValueError(f"unknown product {product!r}")
    return image


def quicklook(spark: SparkSession, path: str, output: str, size: int = 256, extent: float | None = None, remap: str = "nrl") -> tuple[int, int]:
    """A small display image of a file from as many central pulses and samples as its pixels resolve; how many were read.

    Geometry comes first, without samples; the reader then fetches only the chosen ranges.
    """
    rows = _geometry(spark, path, {})
    whole = open_scene(spark, path)
    extent = extent or C / (2 * whole.df)
    wanted = extent / size
    shares = [min(1.0, r / wanted) for r in whole.resolution]

    def central(n: int, share: float) -> tuple[int, int]:
        count = max(2, min(n, math.ceil(n * share)))
        return (n - count) // 2, (n - count) // 2 + count

    pulses, samples = central(len(rows), shares[0]), central(whole.k, shares[1])
    image, _, _ = form_file(spark, path, (size, size), (wanted, wanted), frame=whole.frame, pulses=f"{pulses[0]}:{pulses[1]}", samples=f"{samples[0]}:{samples[1]}")
    from ..sources import png

    png.write(raster.remap(detected(image.persist()), remap), output)
    return pulses[1] - pulses[0], samples[1] - samples[0]


def register(pair: DataFrame, tile: int = 64, least: float = 5.0) -> tuple[float, float] | None:
    """The displacement of image b against a (i, j, ar, ai, br, bi): the median of significant tiles, or None."""
    db = lambda x, y: 10 * F.log10(F.greatest(F.col(x) * F.col(x) + F.col(y) * F.col(y), F.lit(1e-30)))
    found = tile_shifts(pair.select("i", "j", db("ar", "ai").alias("a"), db("br", "bi").alias("b")), tile).filter(F.col("z") >= least)
    row = found.agg(F.median("di"), F.median("dj")).first()
    return None if row[0] is None else (row[0], row[1])


def displaced(image: DataFrame, di: float, dj: float) -> DataFrame:
    """An image moved by (di, dj) pixels: whole pixels by index, the rest by a phase ramp along each axis; zero beyond the border."""
    wi, wj = round(di), round(dj)
    size = image.agg(F.max("i"), F.max("j")).first()
    moved = image.select((F.col("i") + wi).alias("i"), (F.col("j") + wj).alias("j"), "re", "im").filter((F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("i") <= size[0]) & (F.col("j") <= size[1]))
    grid = image.select("i", "j").join(moved, ["i", "j"], "left").select("i", "j", F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im"))
    along = lines.shift(lines.to_lines(grid), dj - wj)
    return lines.to_pixels(lines.corner_turn(lines.shift(lines.corner_turn(along), di - wi)))


def process_stack(spark: SparkSession, paths: list[str], shape: tuple[int, int], spacing: tuple[float, float], *, product: str = "mean", registered: bool = True, **options) -> DataFrame:
    """Several files on the grid of the first, registered to it, and combined: mean, coherence, change or interferogram."""
    if product not in ("mean", "coherence", "change", "interferogram"):
        raise ValueError(f"unknown product {product!r}")
    if len(paths) < 2 or product != "mean" and len(paths) != 2:
        raise ValueError(f"{product} does not take {len(paths)} files")
    first, scene, grid = form_file(spark, paths[0], shape, spacing, **options)
    images = [deramped(first, scene, grid).persist()]
    for path in paths[1:]:
        image, other, _ = form_file(spark, path, shape, spacing, frame=scene.frame, **options)
        image = deramped(image, other, grid).persist()
        both = images[0].selectExpr("i", "j", "re as ar", "im as ai").join(image.selectExpr("i", "j", "re as br", "im as bi"), ["i", "j"])
        by = register(both) if registered else None
        images.append(image if by is None else displaced(image, -by[0], -by[1]).persist())
    if product == "mean":
        stack = None
        for n, image in enumerate(images):
            one = image.select(F.lit(n).cast("long").alias("img_id"), "i", "j", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))
            stack = one if stack is None else stack.unionByName(one)
        return raster.stack_mean(stack)
    pair = images[0].selectExpr("i", "j", "re as ar", "im as ai").join(images[1].selectExpr("i", "j", "re as br", "im as bi"), ["i", "j"])
    if product == "change":
        return raster.change(pair)
    out = raster.coherence(pair)
    return out.select("i", "j", "coherence") if product == "coherence" else out.select("i", "j", F.atan2("xi", "xr").alias("phase"), "coherence")
