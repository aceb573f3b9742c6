"""Images by patches: mosaics of a moving beam, time-domain sums, and focus estimates by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import C
from .estimate import drift, surface
from .focus import Grid
from .formation import _BLOCK, _blocks, _fields, _range_difference
from .lines import map_lines, sinc_read

_PIXELS = "i long, j long, re double, im double"


def mosaic(pulses: DataFrame, spans: DataFrame, grid: Grid, *, fmin: float, df: float, patch: int = 32, run: int = 256) -> DataFrame:
    """Pixels (i, j, re, im) of ``grid``, each patch (ti, tj) from its own pulses ``first`` to ``last`` of ``spans``.

    Pulses (p, ax, ay, az, re, im) meet the patches that their beam covers by a range join; runs of pulses
    of a patch are summed in one task, and runs meet by pixel.  Patches without pulses stay out.
    """
    met = pulses.join(spans, (F.col("p") >= F.col("first")) & (F.col("p") <= F.col("last")))
    met = met.select("ti", "tj", F.floor(F.col("p") / run).alias("run"), "ax", "ay", "az", "re", "im")

    def image(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        ti, tj = rows[0]["ti"], rows[0]["tj"]
        i, j = np.meshgrid(np.arange(ti * patch, min(grid.nx, (ti + 1) * patch)), np.arange(tj * patch, min(grid.ny, (tj + 1) * patch)), indexing="ij")
        x = grid.points(i, j).reshape(-1, 3)
        total = np.zeros(len(x), np.complex128)
        for r, dr in zip(rows, _range_difference(x, _fields(rows, "ax", "ay", "az")), strict=True):
            step, value = np.exp(4j * np.pi / C * df * dr), np.zeros(len(x), np.complex128)
            for sample in (np.array(r["re"]) + 1j * np.array(r["im"]))[::-1]:
                value = value * step + sample
            cycles = 2 / C * fmin * dr
            total += value * np.exp(2j * np.pi * (cycles - np.rint(cycles)))
        return pa.table({"i": i.ravel(), "j": j.ravel(), "re": total.real, "im": total.imag})

    return met.groupBy("ti", "tj", "run").applyInArrow(image, _PIXELS).groupBy("i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def time_domain(echoes: DataFrame, pulses: DataFrame, points: DataFrame, *, fs: float, fc: float, start: float, beam: float, up: int = 8) -> DataFrame:
    """Image values (id, re, im) of points (id, x, y, z) from range-compressed lines: the sum over pulses whose beam covers a
    point (sine off broadside up to ``beam``, the y axis is the track) of the line at the point's delay times exp(2 pi j fc delay).

    Lines are read on a band-limited finer grid by sinc taps.  Blocks of pulses meet blocks of points.
    """

    def images(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for mine, at in zip(table.column("mine").to_pylist(), table.column("at").to_pylist(), strict=True):
                x, total = _fields(at, "x", "y", "z"), np.zeros(len(at), np.complex128)
                for r in mine:
                    a = np.array([r["ax"], r["ay"], r["az"]])
                    rng = np.linalg.norm(x - a, axis=1)
                    seen = np.flatnonzero(np.abs(x[:, 1] - a[1]) <= beam * rng)
                    if len(seen):
                        z = np.array(r["re"]) + 1j * np.array(r["im"])
                        spectrum, n = np.fft.fft(z), len(z)
                        wide = np.zeros(n * up, np.complex128)
                        wide[: (n + 1) // 2], wide[-(n // 2) :] = spectrum[: (n + 1) // 2], spectrum[(n + 1) // 2 :]
                        delay = 2 * rng[seen] / C
                        total[seen] += sinc_read(up * np.fft.ifft(wide), (delay - start) * fs * up) * np.exp(2j * np.pi * (fc * delay - np.rint(fc * delay)))
                yield pa.RecordBatch.from_arrays([pa.array([r["id"] for r in at], pa.int64()), pa.array(total.real), pa.array(total.imag)], names=["id", "re", "im"])

    lines = echoes.select(F.col("line").alias("p"), "re", "im").join(pulses, "p")
    mine = _blocks(lines, "p", _BLOCK // 64, ["ax", "ay", "az", "re", "im"])[0].select(F.col("rows").alias("mine"))
    at = _blocks(points.select(F.col("id").cast("long").alias("id"), "x", "y", "z"), "id", _BLOCK // 16384, ["id", "x", "y", "z"])[0].select(F.col("rows").alias("at"))
    return mine.crossJoin(at).mapInArrow(images, "id long, re double, im double").groupBy("id").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def map_drift(columns: DataFrame, sets: int = 8) -> DataFrame:
    """(set, phase): the quadratic azimuth phase (radians at the band's edge) by map drift, for sets of columns (line, re, im)."""

    def one(table: pa.Table) -> pa.Table:
        z = np.array([a.values.to_numpy() + 1j * b.values.to_numpy() for a, b in zip(table.column("re"), table.column("im"), strict=True)])
        return pa.table({"set": table.column("set")[:1], "phase": pa.array([drift(z.T)])})

    return columns.withColumn("set", F.col("line") % sets).groupBy("set").applyInArrow(one, "set long, phase double")


def quadratic_autofocus(columns: DataFrame, sets: int = 8, spread: float = 0.5) -> tuple[DataFrame, float]:
    """Columns without their common quadratic phase, and that phase: the median over column sets, or 0 where the sets disagree
    (their middle half wider than ``spread`` times the median)."""
    row = map_drift(columns, sets).agg(F.percentile("phase", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
    phase = float(row[1]) if row and row[2] - row[0] <= spread * abs(row[1]) else 0.0

    def corrected(_: int, z: np.ndarray) -> np.ndarray:
        return np.fft.ifft(np.fft.fft(z) * np.exp(-1j * phase * (2 * np.fft.fftfreq(len(z))) ** 2))

    return map_lines(columns, corrected), phase


def phase_surface(image: DataFrame, block: int = 64, order: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Quadratic azimuth phase by block of pixels (i, j, re, im): rows (bi, bj, phase), and the robust polynomial surface
    through them (coordinates are block numbers; terms as in ``estimate.surface``).  A block is one task; its estimates are few."""

    def one(table: pa.Table) -> pa.Table:
        i, j = table.column("i").to_numpy() % block, table.column("j").to_numpy() % block
        z = np.zeros((block, block), np.complex128)
        z[i, j] = table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
        return pa.table({"bi": table.column("bi")[:1], "bj": table.column("bj")[:1], "phase": pa.array([drift(z) if len(i) == block * block else None], pa.float64())})

    keyed = image.select(F.floor(F.col("i") / block).alias("bi"), F.floor(F.col("j") / block).alias("bj"), "i", "j", "re", "im")
    found = keyed.groupBy("bi", "bj").applyInArrow(one, "bi long, bj long, phase double").filter("phase is not null").persist()
    rows = np.array([[r.bi, r.bj, r.phase] for r in found.collect()], float).reshape(-1, 3)  # one row for each block
    return found, surface(*rows.T, order=min(order, max(0, int((2 * len(rows)) ** 0.5) - 2))) if len(rows) else np.zeros(1)


def focus_stripmap(echoes: DataFrame, pulses: int, algorithm: str = "omega_k", **parameters: float) -> DataFrame:
    """Range-compressed stripmap lines in focus by name: omega_k or range_doppler."""
    from . import focus

    if algorithm not in ("omega_k", "range_doppler"):
        raise ValueError(f"unknown algorithm {algorithm!r}")
    return getattr(focus, algorithm)(echoes, pulses, **parameters)
