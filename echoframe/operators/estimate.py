"""Estimation on image tiles: registration, fringes, defocus, placement.

Images are cut in tiles of bounded size; each tile is one group and one NumPy
kernel, and only the few numbers that a tile yields go on.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import C


def displacement(a: np.ndarray, b: np.ndarray, most: int = 16, highpass: float = 32.0) -> tuple[float, float, float]:
    """(rows, columns, z): where b's content lies relative to a's, by windowed, high-passed cross-correlation.

    The peak within ``most`` pixels is refined on a band-limited grid of 1/16 pixel and then by a
    parabola on each axis; z is its height over the surface in standard deviations, significant above 5.
    """
    n, m = a.shape
    w = np.outer(np.hanning(n + 2)[1:-1], np.hanning(m + 2)[1:-1])
    x, y = (np.fft.fft2((v - v.mean()) * w) for v in (a, b))
    k2 = np.add.outer(np.fft.fftfreq(n) ** 2, np.fft.fftfreq(m) ** 2)
    product = np.conj(x) * y * (1 - np.exp(-0.5 * k2 * (2 * np.pi * highpass / 2.355) ** 2))
    surface = np.fft.ifft2(product).real
    z = (surface - surface.mean()) / max(surface.std(), 1e-300)
    near = np.where(np.add.outer(np.abs(np.fft.fftfreq(n, 1 / n)) <= most, np.zeros(m)) * (np.abs(np.fft.fftfreq(m, 1 / m)) <= most)[None] > 0, z, -np.inf)
    i, j = np.unravel_index(near.argmax(), z.shape)

    def vertex(u: float, v: float, t: float) -> float:
        bend = u - 2 * v + t
        return 0.5 * (u - t) / bend if bend else 0.0

    grid = np.arange(-17, 18) / 16
    rows, columns = (np.exp(2j * np.pi * np.outer(at + grid, np.fft.fftfreq(size))) for at, size in ((i, n), (j, m)))
    fine = (rows @ product @ columns.T).real
    u, v = np.unravel_index(fine[1:-1, 1:-1].argmax(), (33, 33))
    u, v = u + 1, v + 1
    di = grid[u] + vertex(*fine[u - 1 : u + 2, v]) / 16
    dj = grid[v] + vertex(*fine[u, v - 1 : v + 2]) / 16
    wrap = lambda v, size: (v + size / 2) % size - size / 2
    return float(wrap(i + di, n)), float(wrap(j + dj, m)), float(z[i, j])


def fringe(x: np.ndarray, chance: float = 4.5e-5) -> tuple[float, float, bool]:
    """The linear fringe of a cross product: (cycles a row, cycles a column, significant).

    Without a fringe the periodogram at its N independent frequencies is exponential about its mean, and
    its largest value stays below -log(1 - (1 - chance)^(1/N)) means.  The mean of the others is taken
    where the strongest frequency has been left out.  The place is refined by three bins on each axis.
    """
    z = np.fft.fft2(x)
    p = np.abs(z) ** 2
    top = np.unravel_index(p.argmax(), p.shape)
    far = np.ones(p.shape, bool)
    far[np.ix_(*([(t + d) % n for d in (-1, 0, 1)] for t, n in zip(top, p.shape, strict=True)))] = False
    limit = -np.log(-np.expm1(np.log1p(-chance) / p.size))
    place = []
    for axis, (t, n) in enumerate(zip(top, p.shape, strict=True)):
        line = z[:, top[1]] if axis == 0 else z[top[0]]
        before, here, after = line[t - 1], line[t], line[(t + 1) % n]
        bend = 2 * here - before - after
        place.append(np.fft.fftfreq(n)[t] + (((before - after) / bend).real / n if bend else 0.0))
    return float(place[0]), float(place[1]), bool(p[top] > limit * p[far].mean())


def drift(image: np.ndarray, rounds: int = 6) -> float:
    """Quadratic azimuth phase (radians at the band's edge) of an image [azimuth, range], by map drift.

    Two half-band looks of a defocused image lie apart; their displacement along azimuth gives the
    coefficient, which is removed and measured again.
    """
    n = image.shape[0]
    k = np.fft.fftfreq(n) * 2
    spectrum, total = np.fft.fft(image, axis=0), 0.0
    for _ in range(rounds):
        z = spectrum * np.exp(-1j * total * k**2)[:, None]
        looks = [np.abs(np.fft.ifft(np.where((k > 0)[:, None] == side, z, 0), axis=0)) ** 2 for side in (False, True)]
        x = [np.fft.fft(v - v.mean(0), axis=0) for v in looks]
        c = np.fft.ifft((np.conj(x[0]) * x[1]).sum(1)).real
        p = int(c.argmax())
        u, v, t = c[p - 1], c[p], c[(p + 1) % n]
        d = p + (0.5 * (u - t) / (u - 2 * v + t) if u - 2 * v + t else 0.0)
        d = (d + n / 2) % n - n / 2
        step = -np.pi * d / 2
        total += step
        if abs(step) < 0.02:
            break
    return total


def surface(x: np.ndarray, y: np.ndarray, v: np.ndarray, order: int = 2, rounds: int = 20) -> np.ndarray:
    """Coefficients of a polynomial surface (terms x^a y^b, a + b <= order) by Tukey-biweight least squares."""
    terms = np.stack([x**a * y**b for a in range(order + 1) for b in range(order + 1 - a)], 1)
    w = np.ones(len(v))
    c = np.zeros(terms.shape[1])
    for _ in range(rounds):
        c = np.linalg.lstsq(terms * w[:, None], v * w, rcond=None)[0]
        rest = v - terms @ c
        scale = 4.685 * 1.4826 * np.median(np.abs(rest)) + 1e-12
        w = np.sqrt(np.where(np.abs(rest) < scale, (1 - (rest / scale) ** 2) ** 2, 0))
    return c


def zero_doppler(position: np.ndarray, velocity: np.ndarray, rng: float, side: float, height_of: Callable[[np.ndarray], float], height: float = 0.0, rounds: int = 60) -> np.ndarray:
    """The point broadside of an antenna at a range and height: bisection on the look angle from the nadir."""
    v = velocity / np.linalg.norm(velocity)
    down = -position / np.linalg.norm(position)
    down = down - (down @ v) * v
    down /= np.linalg.norm(down)
    across = side * np.cross(v, down)
    lo, hi = 0.0, np.pi / 2
    for _ in range(rounds):
        mid = (lo + hi) / 2
        p = position + rng * (np.cos(mid) * down + np.sin(mid) * across)
        lo, hi = (mid, hi) if height_of(p) < height else (lo, mid)
    return position + rng * (np.cos(lo) * down + np.sin(lo) * across)


def splits(n: int, tile: int, levels: int) -> tuple[int, ...]:
    """Factors (each 2 or more) of the least product times ``tile`` that covers n pixels, in at most ``levels`` steps."""
    need = -(-n // tile)
    best: tuple[int, ...] = (need,) if need > 1 else ()
    cost = lambda f: (int(np.prod(f)) if f else 1, sum(f))

    def grow(chosen: tuple[int, ...], product: int) -> None:
        nonlocal best
        if product >= need:
            best = min(best, chosen, key=cost) if best else chosen
            return
        if len(chosen) < levels:
            for f in range(chosen[-1] if chosen else 2, min(8, -(-need // product)) + 1):
                grow((*chosen, f), product * f)

    grow((), 1)
    return best


def doppler_shift(fc: float, speed: float, sine: float) -> float:
    """Doppler frequency of a target at a squint."""
    return 2 * fc * speed * sine / C


_SHIFTS = "ti long, tj long, di double, dj double, z double"


def tile_shifts(pair: DataFrame, tile: int = 64, most: int = 16) -> DataFrame:
    """Displacement of image b against a in every full tile: rows (ti, tj, di, dj, z) from pixels (i, j, a, b)."""
    schema = pa.schema([("ti", pa.int64()), ("tj", pa.int64()), ("di", pa.float64()), ("dj", pa.float64()), ("z", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i").to_numpy() % tile, table.column("j").to_numpy() % tile
        if len(i) < tile * tile:
            return schema.empty_table()
        images = []
        for name in "ab":
            image = np.zeros((tile, tile))
            image[i, j] = table.column(name).to_numpy()
            images.append(image)
        row = (table.column("ti")[0].as_py(), table.column("tj")[0].as_py(), *displacement(*images, most))
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    keyed = pair.select(F.floor(F.col("i") / tile).alias("ti"), F.floor(F.col("j") / tile).alias("tj"), "i", "j", "a", "b")
    return keyed.groupBy("ti", "tj").applyInArrow(run, _SHIFTS)
