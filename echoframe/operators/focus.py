"""Image formation by transforms and factors, as DataFrame stages on lines (line, re array, im array).

A stage along a line is narrow; a change of axis is one ``corner_turn``.  Factorised backprojection
sends the pulses to tiles once; all levels below are one task's.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import C
from .lines import SCHEMA, corner_turn, half_level, map_lines, sinc_read, window
from .signal import kaiser_decimator
from .steps import dealt


def transform(lines: DataFrame, inverse: bool = False) -> DataFrame:
    """The transform of every line, zero frequency first."""
    return map_lines(lines, lambda _, z: np.fft.ifft(z) if inverse else np.fft.fft(z))


def _frequency(line: int, n: int, rate: float) -> float:
    return (line if line < (n + 1) // 2 else line - n) * rate / n


def omega_k(echoes: DataFrame, pulses: int, *, fc: float, fs: float, prf: float, speed: float, r0: float) -> DataFrame:
    """Range-compressed stripmap echoes (a line for each pulse, broadside, ``r0`` at the middle sample) in focus.

    Azimuth transform, then by Doppler frequency: range transform, phase of the reference range, Stolt
    interpolation and inverse transform; azimuth inverse.  Four corner turns are the only exchanges.
    """

    def stolt(line: int, z: np.ndarray) -> np.ndarray:
        m = len(z)
        f = np.fft.fftfreq(m, 1 / fs)
        shift = (C * _frequency(line, pulses, prf) / (2 * speed)) ** 2
        spectrum = np.fft.fft(z) * np.exp(4j * np.pi * r0 / C * (np.sqrt(np.maximum((fc + f) ** 2 - shift, 0)) - (fc + f)))
        order = np.argsort(f)
        at = (np.sqrt((fc + f) ** 2 + shift) - fc - f[order[0]]) * m / fs
        return np.fft.ifft(sinc_read(spectrum[order], at, 16))

    doppler = corner_turn(transform(corner_turn(echoes)))
    return corner_turn(transform(corner_turn(map_lines(doppler, stolt)), inverse=True))


def range_doppler(echoes: DataFrame, pulses: int, *, fc: float, fs: float, prf: float, speed: float, r0: float) -> DataFrame:
    """The same echoes by the range-Doppler algorithm: range walk read back by sinc taps, azimuth matched filter by range."""

    def straighten(line: int, z: np.ndarray) -> np.ndarray:
        eta = _frequency(line, pulses, prf)
        bend = np.sqrt(max(1 - (C * eta / (2 * speed * fc)) ** 2, 1e-12))
        r = r0 + (np.arange(len(z)) - len(z) // 2) * C / (2 * fs)
        out = sinc_read(z, len(z) // 2 + (r / bend - r0) * 2 * fs / C, 16)
        return out * np.exp(4j * np.pi * fc / C * r * (bend - 1))

    doppler = corner_turn(transform(corner_turn(echoes)))
    return corner_turn(transform(corner_turn(map_lines(doppler, straighten)), inverse=True))


def polar_format(pulses: DataFrame, *, fmin: float, df: float, k: int, count: int, taps: int = 16, track: DataFrame | None = None) -> tuple[DataFrame, float, float]:
    """An image of spotlight pulses (p, ax, ay, az, re array, im array) by polar format, its range axis along the
    mean look on the ground and its azimuth axis across; the pixel spacings in azimuth and range.

    Samples lie on a polar grid of wavenumbers.  Each pulse is read at equal steps of range wavenumber, then
    each range wavenumber at equal steps of azimuth wavenumber, and a two-dimensional transform forms the
    image.  Wavenumbers that a pulse does not cover are zero.  Pulses are few numbers on the driver (their
    directions); samples stay distributed.  ``track`` (p, ax, ay, az) is where the
    directions are read if that costs less than the pulses do.
    """
    at = {r.p: np.array([r.ax, r.ay, r.az]) for r in (pulses if track is None else track).select("p", "ax", "ay", "az").collect()}
    look = {p: -a / np.linalg.norm(a) for p, a in at.items()}
    ids = sorted(look)
    mean = np.mean([look[p] for p in ids], 0)
    range_axis = np.array([mean[0], mean[1], 0]) / np.hypot(mean[0], mean[1])
    across = np.array([-range_axis[1], range_axis[0], 0])
    kr = {p: 2 / C * (look[p] @ range_axis) for p in ids}  # range wavenumber (cycles a metre) for each Hz
    slope = {p: (look[p] @ across) / (look[p] @ range_axis) for p in ids}
    low, high = max(fmin * v for v in kr.values()), min((fmin + (k - 1) * df) * v for v in kr.values())
    if not low < high and k > 1:  # a track so long that its pulses share no band: the whole of what they cover, at their spacing
        low, high = min(fmin * v for v in kr.values()), max((fmin + (k - 1) * df) * v for v in kr.values())
        k = math.ceil((high - low) / (df * min(kr.values()))) + 1
    if not low < high:
        raise ValueError("the pulses span no band of range wavenumbers")
    grid = np.linspace(low, high, k)
    steep = np.array([slope[p] for p in ids])
    order = np.argsort(steep)
    steep = steep[order]
    place = {ids[o]: n for n, o in enumerate(order)}
    edge = min(abs(steep[0]), abs(steep[-1])) * low
    azimuth = np.linspace(-edge, edge, count)

    def along(line: int, z: np.ndarray) -> np.ndarray:
        return sinc_read(z, (grid / kr[line] - fmin) / df, taps)

    read = map_lines(pulses.select(F.col("p").cast("long").alias("line"), "re", "im"), along)
    places = pulses.sparkSession.createDataFrame(list(place.items()), "line long, place long")
    read = read.join(F.broadcast(places), "line").select(F.col("place").alias("line"), "re", "im")

    def cross(line: int, z: np.ndarray) -> np.ndarray:
        want, covered = azimuth / grid[line], np.flatnonzero(z)
        first, last = (covered[0], covered[-1] + 1) if len(covered) else (0, 0)
        return np.fft.fftshift(np.fft.ifft(np.fft.ifftshift(sinc_read(z[first:last], np.interp(want, steep, np.arange(len(steep))) - first, taps))))

    # a pulse covers few of the wavenumbers of a long track
    image = map_lines(corner_turn(map_lines(corner_turn(read, (len(ids), k)), cross), (k, count)), lambda _, z: np.fft.fftshift(np.fft.ifft(np.fft.ifftshift(z))))
    return image, 1 / ((azimuth[1] - azimuth[0]) * count), 1 / ((grid[1] - grid[0]) * k)


_IMAGE = pa.schema([("ti", pa.int64()), ("tj", pa.int64()), ("re", pa.list_(pa.float64())), ("im", pa.list_(pa.float64()))])
#: Tiles that the pulses of factorised backprojection are sent to, at least, if there are as many.
_STARTS = 64


class Grid:
    """Pixels (i - nx / 2) spx e1 + (j - ny / 2) spy e2, in square tiles that halve by ``split`` at each level."""

    def __init__(self, nx: int, ny: int, spx: float, spy: float, e1=(1.0, 0.0, 0.0), e2=(0.0, 1.0, 0.0)):
        self.nx, self.ny, self.spx, self.spy, self.e1, self.e2 = nx, ny, spx, spy, np.array(e1), np.array(e2)

    def points(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return ((i - self.nx / 2) * self.spx)[..., None] * self.e1 + ((j - self.ny / 2) * self.spy)[..., None] * self.e2

    def center(self, ti: int, tj: int, size: int) -> np.ndarray:
        return self.points(np.array(ti * size + (size - 1) / 2), np.array(tj * size + (size - 1) / 2))

    def radius(self, size: int) -> float:
        return size / 2 * float(np.hypot(self.spx, self.spy))


def _toward(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.linalg.norm(x - a, axis=-1) - np.linalg.norm(a, axis=-1)


def _beyond(taps: int, step: int) -> int:
    """Samples that a filter needs beyond either end of a line so that its output holds the whole line: a multiple of the step."""
    return -(-(taps // 2) // step) * step


def _decimated(z: np.ndarray, taps: np.ndarray, step: int) -> np.ndarray:
    """Lines filtered and every ``step``-th sample kept, from as far before the line as the filter reaches to as far behind it."""
    half = len(taps) // 2
    more = _beyond(len(taps), step)
    padded = np.pad(z, ((0, 0), (half + more, half + more)))
    starts = np.arange(0, z.shape[1] + 2 * more, step)
    view = np.lib.stride_tricks.sliding_window_view(padded, len(taps), axis=1)[:, starts]
    return step * (view @ taps)


def factorized(pulses: DataFrame, grid: Grid, *, fmin: float, df: float, k: int, tile: int = 16, split: int = 2, passband: float = 0.6, track: DataFrame | None = None) -> DataFrame:
    """Pixels (i, j, re, im) from pulses (p, ax, ay, az, re array, im array) by factorised backprojection.

    A level cuts each tile by ``split`` on both axes.  The history of a child is turned to its centre, which
    narrows its band in frequency and in pulses to its size; both are filtered and decimated as far as the
    band allows.  Tiles of at most ``tile`` pixels are summed directly from what is left.  The pulses go once to each of
    a few dozen tiles, and a task goes down to the small ones from there, one after the other; it holds the
    history of one tile of each level.  ``track`` (p, ax, ay, az) is where the places of the
    pulses are read if that costs less than the pulses do.
    """
    known = pulses if track is None else track
    depth = 0
    while -(-max(grid.nx, grid.ny) // split**depth) > tile:
        depth += 1
    small = -(-max(grid.nx, grid.ny) // split**depth)  # sizes are multiples of it, so that tiles of all levels have the same edges
    at, n = (fmin, df), k
    spread = known.agg(F.max(F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2))).first()[0]
    path = np.array([[r.ax, r.ay, r.az] for r in known.orderBy("p").select("ax", "ay", "az").collect()])
    turn = float(np.linalg.norm(np.diff(path, axis=0), axis=1).max()) / spread if len(path) > 1 else 0.0
    levels = []
    for size in (small * split**d for d in range(depth)[::-1]):
        radius = grid.radius(size)
        by_frequency = max(1, int(passband * C / (4 * at[1] * radius)))
        by_pulse = max(1, int(passband * C / (4 * (at[0] + n * at[1]) * radius * turn))) if turn else 1
        by_frequency, by_pulse = min(by_frequency, max(1, n // 8)), min(by_pulse, 8)
        levels.append((size, at[0] + np.arange(n) * at[1], by_frequency, by_pulse))
        turn *= by_pulse
        more = _beyond(len(kaiser_decimator(by_frequency, passband, 60.0)), by_frequency) if by_frequency > 1 else 0
        n, at = -(-(n + 2 * more) // by_frequency), (at[0] - more * at[1], at[1] * by_frequency)
    rows = dealt(pulses, "p").select(F.col("p").cast("double").alias("p"), F.array("ax", "ay", "az").alias("a"), "re", "im")
    schema = "ti long, tj long, re array<double>, im array<double>"
    if depth:
        first = next((d for d in range(1, depth) if split ** (2 * d) >= _STARTS), depth)
        size = levels[first - 1][0]
        starts = [F.struct(F.lit(i).cast("long").alias("ti"), F.lit(j).cast("long").alias("tj")) for i in range(-(-grid.nx // size)) for j in range(-(-grid.ny // size))]
        each = rows.select(F.explode(F.array(*starts)).alias("t"), "*").select("t.ti", "t.tj", "p", "a", "re", "im")
        tiles = dealt(each, "ti", "tj").groupBy("ti", "tj").applyInArrow(_descended(grid, levels, first, split, passband, at), schema)
    else:
        from .formation import _sum_tiles

        tiles = rows.mapInArrow(_finished(grid, small, at), schema).groupBy("ti", "tj").applyInArrow(_sum_tiles, schema)
    pixels = tiles.select("ti", "tj", F.posexplode(F.arrays_zip("re", "im")).alias("n", "v"))
    i, j = F.col("ti") * small + F.floor(F.col("n") / small), F.col("tj") * small + F.col("n") % small
    return pixels.select(i.alias("i"), j.alias("j"), F.col("v.re").alias("re"), F.col("v.im").alias("im")).filter((F.col("i") < grid.nx) & (F.col("j") < grid.ny))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _rows(table: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _matrix(table.column("re")) + 1j * _matrix(table.column("im")), _matrix(table.column("a")), table.column("p").to_numpy()


def _descended(grid: Grid, levels: list, first: int, split: int, passband: float, at: tuple[float, float]):
    """The small tiles below one tile of level ``first``, from the pulses as they came."""

    def below(ti: int, tj: int, p: np.ndarray, a: np.ndarray, z: np.ndarray, depth: int, way: list[tuple[int, int]]) -> Iterator[tuple[int, int, np.ndarray]]:
        if depth == len(levels):
            yield ti, tj, _direct(grid, levels[-1][0], at, ti, tj, a, z)
            return
        size, f, by_frequency, by_pulse = levels[depth]
        before = _toward(a, grid.center(ti, tj, size * split)) if depth else 0 * p
        for i, j in way[depth : depth + 1] or [(ti * split + ci, tj * split + cj) for ci in range(split) for cj in range(split)]:
            if i * size < grid.nx and j * size < grid.ny:
                cycles = 2 / C * np.outer(_toward(a, grid.center(i, j, size)) - before, f)
                turned = z * np.exp(2j * np.pi * (cycles - np.rint(cycles)))
                del cycles
                yield from below(i, j, *_fewer(p, a, _decimated(turned, np.array(kaiser_decimator(by_frequency, passband, 60.0)), by_frequency) if by_frequency > 1 else turned, by_pulse, passband), depth + 1, way)

    def run(table: pa.Table) -> pa.Table:
        ti, tj = table.column("ti")[0].as_py(), table.column("tj")[0].as_py()
        z, a, p = _rows(table.sort_by("p").combine_chunks().to_batches()[0])
        way = [(ti // split**d, tj // split**d) for d in range(first)[::-1]]
        found = list(below(0, 0, p, a, z, 0, way))
        return pa.table([pa.array([f[0] for f in found]), pa.array([f[1] for f in found]), pa.array([f[2].real for f in found]), pa.array([f[2].imag for f in found])], schema=_IMAGE)

    return run


def _fewer(p: np.ndarray, a: np.ndarray, z: np.ndarray, step: int, passband: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pulses of one tile filtered and decimated; the track goes straight on beyond its ends."""
    if step == 1 or len(p) < 2:
        return p, a, z
    taps = np.array(kaiser_decimator(step, passband, 60.0))
    kept = np.arange(-_beyond(len(taps), step), len(p) + _beyond(len(taps), step), step)
    at = np.clip(kept, 0, len(p) - 1)
    slope = np.where((kept < 0)[:, None], a[1] - a[0], a[-1] - a[-2])
    pace = np.where(kept < 0, p[1] - p[0], p[-1] - p[-2])
    return p[at] + (kept - at) * pace, a[at] + (kept - at)[:, None] * slope, _decimated(z.T, taps, step).T


#: Pairs of a pulse and a pixel that are summed at once.
_PAIRS = 1 << 15


def _direct(grid: Grid, size: int, at: tuple[float, float], ti: int, tj: int, a: np.ndarray, z: np.ndarray, whole: bool = False) -> np.ndarray:
    """The direct sum over what is left of the history of a small tile."""
    i, j = np.meshgrid(np.arange(ti * size, (ti + 1) * size), np.arange(tj * size, (tj + 1) * size), indexing="ij")
    x = grid.points(i, j).reshape(-1, 3)
    center = grid.center(ti, tj, size)
    total = np.zeros(len(x), np.complex128)
    many = max(1, _PAIRS // len(x))  # pulses at once
    for n in range(0, len(z), many):
        antenna, samples = a[n : n + many, None], z[n : n + many]
        dr = _toward(antenna, x) - (0 if whole else _toward(antenna, center))
        step = np.exp(4j * np.pi / C * at[1] * dr)
        value = np.zeros(dr.shape, np.complex128)
        for k in range(samples.shape[1])[::-1]:
            value *= step
            value += samples[:, k, None]
        cycles = 2 / C * at[0] * dr
        total += (value * np.exp(2j * np.pi * (cycles - np.rint(cycles)))).sum(0)
    return total


def _finished(grid: Grid, size: int, at: tuple[float, float]):
    """The only tile of a small image, summed directly from the pulses of a batch."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            z, a, _ = _rows(table)
            total = _direct(grid, size, at, 0, 0, a, z, True)
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([total.real]), pa.array([total.imag])], schema=_IMAGE)

    return run


def form(pulses: DataFrame, grid: Grid, *, fmin: float, df: float, k: int, algorithm: str = "factorized", **options) -> DataFrame:
    """Pixels (i, j, re, im) of ``grid`` by name: factorized, profiles (interpolated range profiles) or exact (direct sum)."""
    if algorithm == "factorized":
        return factorized(pulses, grid, fmin=fmin, df=df, k=k, **options)
    from . import formation

    if algorithm == "profiles":
        return formation.form_image(pulses, fmin=fmin, df=df, nx=grid.nx, ny=grid.ny, spx=grid.spx, spy=grid.spy, e1=tuple(grid.e1), e2=tuple(grid.e2), **options)
    if algorithm == "exact":
        spark = pulses.sparkSession
        ids = spark.range(grid.nx * grid.ny)
        i, j = F.floor(F.col("id") / grid.ny) - grid.nx / 2, F.col("id") % grid.ny - grid.ny / 2
        points = ids.select("id", *((i * grid.spx * float(grid.e1[c]) + j * grid.spy * float(grid.e2[c])).alias(x) for c, x in enumerate("xyz")))
        history = pulses.select("p", F.posexplode(F.arrays_zip("re", "im")).alias("k", "v")).select("p", "k", "v.re", "v.im")
        out = formation.backproject(history, pulses.select("p", "ax", "ay", "az"), points, fmin, df, **options)
        return out.select(F.floor(F.col("id") / grid.ny).alias("i"), (F.col("id") % grid.ny).alias("j"), "re", "im")
    raise ValueError(f"unknown algorithm {algorithm!r}")


def phase_gradient(columns: DataFrame, n: int, *, iterations: int = 20, tolerance: float = 0.005, share: float = 0.5, least: int = 8) -> tuple[DataFrame, np.ndarray]:
    """Azimuth columns (line, re array, im array) of n samples without their common phase error, and the error.

    Phase gradient autofocus by maximum likelihood.  Columns stay distributed: each gives its peak-to-mean
    ratio, its centred power and, once the window is known, its gradient products; only vectors of n numbers
    meet on the driver.  The error is applied to the columns as it stands, so that rounds do not nest.
    """
    total = np.zeros(n)

    def corrected(z: np.ndarray, error: np.ndarray) -> np.ndarray:
        return np.fft.ifft(np.fft.ifftshift(np.fft.fftshift(np.fft.fft(z)) * np.exp(-1j * error)))

    def vectors(kernel: Callable[[np.ndarray], np.ndarray], lines: DataFrame) -> np.ndarray:
        parts = map_lines(lines, lambda _, z: kernel(corrected(z, total)))
        each = parts.select(F.posexplode(F.arrays_zip("re", "im")).alias("k", "v")).groupBy("k").agg(F.sum("v.re").alias("re"), F.sum("v.im").alias("im"))
        out = np.zeros(2 * n, np.complex128)
        for r in each.collect():  # two vectors of n numbers
            out[r.k] = complex(r.re, r.im)
        return out

    ratio = map_lines(columns, lambda _, z: np.array([(np.abs(z) ** 2).max() / max((np.abs(z) ** 2).mean(), 1e-300)]))
    ratio = ratio.select("line", F.get("re", F.lit(0)).alias("ratio"))
    from .order import Ranked

    with Ranked(ratio, F.col("ratio")) as ranked:
        count = ranked.groups[0][0]
        cut = ranked.at([(0, count - max(1, int(share * count)))])[0, count - max(1, int(share * count))]
    chosen = columns.join(ratio.filter(F.col("ratio") >= cut).select("line"), "line", "left_semi").persist()
    for _ in range(iterations):

        def centred(z: np.ndarray) -> np.ndarray:
            return np.roll(z, n // 2 - int(np.abs(z).argmax()))

        profile = vectors(lambda z: np.abs(centred(z)) ** 2 + 0j, chosen)[:n].real
        left, right = half_level(np.sqrt(np.sqrt(profile)), int(profile.argmax()))  # a fourth root at half is 12 dB down
        wide = np.nanmax([n // 2 - left, right - n // 2, least])
        keep = np.abs(np.arange(n) - n // 2) <= 1.5 * wide

        def products(z: np.ndarray) -> np.ndarray:
            g = np.fft.fftshift(np.fft.fft(np.fft.ifftshift(np.where(keep, centred(z), 0))))
            return np.concatenate([np.conj(g[:-1]) * g[1:], [0], np.abs(g) ** 2])

        found = vectors(products, chosen)
        error = np.concatenate([[0], np.cumsum(np.angle(found[: n - 1]))])
        line = np.polynomial.Polynomial.fit(np.arange(n), error, 1, w=np.sqrt(np.maximum(found[n:].real, 0)))
        error = error - line(np.arange(n))
        total = total + error
        if np.sqrt(np.mean(error**2)) < tolerance:
            break
    chosen.unpersist()
    return map_lines(columns, lambda _, z: corrected(z, total)), total


def weighted(lines: DataFrame, kind: str, **options: float) -> DataFrame:
    """Every line times a window of its length."""
    return map_lines(lines, lambda _, z: z * window(kind, len(z), **options))


__all__ = ["SCHEMA", "Grid", "factorized", "form", "omega_k", "phase_gradient", "polar_format", "range_doppler", "transform", "weighted"]
