"""Signal operators as tap joins and complex sums, for rows (line, k, re, im)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cx
from ..functions.geodesy import C


def rereference(samples: DataFrame, fmin: float, df: float, shift: Column) -> DataFrame:
    """Samples times exp(-4 pi j f shift / c), for a shift in metres by line."""
    re, im = cx.times(cx.pair("re", "im"), cx.turn(-2.0 * (fmin + F.col("k") * df) / C * shift))
    return samples.select("line", "k", re.alias("re"), im.alias("im"))


def fir(samples: DataFrame, taps: list[float], step: int) -> DataFrame:
    """Filter and keep every ``step``-th sample: the output n is the sum of taps[r] times sample n step + r.

    Each sample goes to the few outputs that read it, so the work is the taps over the step; outputs
    that would read beyond the line are left out.
    """
    n = len(taps)
    weights = F.array(*(F.lit(float(t)) for t in taps))
    first = F.greatest(F.ceil((F.col("k") - (n - 1)) / step), F.lit(0))
    to = samples.join(samples.groupBy("line").agg((F.max("k") + 1).alias("size")), "line")
    last = F.least(F.floor(F.col("k") / step), F.floor((F.col("size") - n) / step))
    to = to.filter(first <= last).select("line", "k", "re", "im", F.explode(F.sequence(first, last)).alias("n"))
    w = F.get(weights, (F.col("k") - F.col("n") * step).cast("int"))
    return to.groupBy("line", "n").agg(F.sum(w * F.col("re")).alias("re"), F.sum(w * F.col("im")).alias("im"))


def dft(samples: DataFrame, size: int, bins: list[int], sign: int = -1) -> DataFrame:
    """Chosen bins of the transform of each line: sum of x exp(sign 2 pi j b k / size)."""
    each = samples.select("line", "k", "re", "im", F.explode(F.array(*(F.lit(b) for b in bins))).alias("b"))
    re, im = cx.times(cx.pair("re", "im"), cx.turn(sign * (F.col("b") * F.col("k") % size) / F.lit(float(size))))
    return each.groupBy("line", "b").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def kaiser_decimator(step: int, passband: float, attenuation: float = 70.0) -> list[float]:
    """Taps of a low-pass of unit gain at zero for decimation by ``step``; ``passband`` is its share of the new band."""
    if step == 1:
        return [1.0]
    width = (2 - 2 * passband) * math.pi / step
    half = math.ceil((attenuation - 8) / (2.285 * width)) // 2 + 1
    beta = 0.1102 * (attenuation - 8.7)

    def bessel(x: float) -> float:
        total = term = 1.0
        k = 1
        while term > total * 1e-17:
            term *= (x / (2 * k)) ** 2
            total += term
            k += 1
        return total

    cut = 1.0 / step
    taps = []
    for n in range(-half, half + 1):
        sinc = 1.0 if n == 0 else math.sin(math.pi * cut * n) / (math.pi * cut * n)
        taps.append(cut * sinc * bessel(beta * math.sqrt(max(0.0, 1 - (n / half) ** 2))) / bessel(beta))
    total = sum(taps)
    return [t / total for t in taps]


#: Pixels on a side of a tile, whose lags are summed in one task.
_SIDE = 256


def correlate(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """Mean product of two images (i, j, v) at integer lags (di, dj) up to ``most``.

    A pixel of ``a`` goes to its tile and one of ``b`` to the tiles within ``most`` of it, so pixels are exchanged
    little more than once whatever the number of lags; a tile gives a sum and a count for each lag.
    """
    side = max(_SIDE, most)

    def tiles(x: str, reach: int) -> Column:
        return F.sequence(F.floor((F.col(x) - reach) / side), F.floor((F.col(x) + reach) / side))

    def dealt(image: DataFrame, second: bool) -> DataFrame:
        near = image.select("i", "j", F.col("v").cast("double").alias("v"), F.explode(tiles("i", most * second)).alias("ti"))
        return near.select("i", "j", "v", "ti", F.explode(tiles("j", most * second)).alias("tj"), F.lit(second).alias("second"))

    def sums(table: pa.Table) -> pa.Table:
        ti, tj = table.column("ti")[0].as_py(), table.column("tj")[0].as_py()
        second = table.column("second").to_numpy().astype(bool)
        row, column = table.column("i").to_numpy() - ti * side + most, table.column("j").to_numpy() - tj * side + most
        v = table.column("v").to_numpy()
        wide = side + 2 * most

        def image(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = (row * wide + column)[chosen]
            return (np.bincount(at, w, wide * wide).reshape(wide, wide) for w in (v[chosen], np.ones(len(at))))  # sums and numbers of a pixel's rows

        (x, nx), (y, ny) = image(~second), image(second)
        x, nx = (z[most : most + side, most : most + side] for z in (x, nx))
        out = []
        for di in range(-most, most + 1):
            for dj in range(-most, most + 1):
                there = np.s_[most + di : most + di + side, most + dj : most + dj + side]
                n = nx * ny[there]
                if n.any():
                    out.append((di, dj, float(np.where(n > 0, x * y[there], 0).sum()), int(n.sum())))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.int64()), strict=True)], names=["di", "dj", "s", "n"])

    known = dealt(a, False).unionAll(dealt(b, True)).filter("v is not null")
    parts = known.groupBy("ti", "tj").applyInArrow(sums, "di int, dj int, s double, n long")
    return parts.groupBy("di", "dj").agg((F.sum("s") / F.sum("n")).alias("c"))


def cut_metrics(cut: DataFrame, spacing: float = 1.0) -> DataFrame:
    """3 dB width, peak and integrated side-lobe ratios (dB) of power cuts (line, k, p).

    The main lobe ends at the first minima beside the peak.
    """
    peak = cut.groupBy("line").agg(F.max_by("k", F.struct("p", -F.col("k"))).alias("c"), F.max("p").alias("top"))
    w = Window.partitionBy("line").orderBy("k")
    near = cut.join(peak, "line").select("*", F.lag("p").over(w).alias("before"), F.lead("p").over(w).alias("after"))
    rising_right = (F.col("k") >= F.col("c")) & (F.col("after").isNull() | (F.col("after") >= F.col("p")))
    rising_left = (F.col("k") <= F.col("c")) & (F.col("before").isNull() | (F.col("before") >= F.col("p")))
    half = 0.5 * F.col("top")
    right = F.when((F.col("k") > F.col("c")) & (F.col("p") < half), F.struct("k", (F.col("k") - 1 + (F.col("before") - half) / (F.col("before") - F.col("p"))).alias("at")))
    left = F.when((F.col("k") < F.col("c")) & (F.col("p") < half), F.struct("k", (F.col("k") + 1 - (F.col("after") - half) / (F.col("after") - F.col("p"))).alias("at")))
    edges = near.groupBy("line").agg(F.min(F.when(rising_right, F.col("k"))).alias("hi"), F.max(F.when(rising_left, F.col("k"))).alias("lo"), F.min(right).alias("r"), F.max(left).alias("l"))
    met = cut.join(edges, "line").join(peak, "line")
    side = (F.col("k") < F.col("lo")) | (F.col("k") > F.col("hi"))
    out = met.groupBy("line").agg(F.first((F.col("r.at") - F.col("l.at")) * spacing).alias("width"), F.max(F.when(side, F.col("p"))).alias("s"), F.first("top").alias("top"), F.sum(F.when(side, F.col("p"))).alias("out"), F.sum(F.when(~side, F.col("p"))).alias("main"))
    return out.select("line", "width", (10 * F.log10(F.col("s") / F.col("top"))).alias("pslr"), (10 * F.log10(F.col("out") / F.col("main"))).alias("islr"))


def keystone_mask(pulses: DataFrame, fmin: float, df: float, k: int, symmetric: bool = True) -> DataFrame:
    """(p, kept): how many leading samples of a pulse (p, s) lie in the azimuth band of the first frequency.

    ``s`` is the azimuth component of the unit vector to the scene; a sample of frequency f stays
    while f s is inside fmin times the band of s.
    """
    band = pulses.agg(F.max("s").alias("hi"), F.min("s").alias("lo"))
    if symmetric:
        band = band.select(F.least("hi", -F.col("lo")).alias("hi")).select("hi", (-F.col("hi")).alias("lo"))
    met = pulses.crossJoin(F.broadcast(band))
    limit = F.when(F.col("s") > 0, F.col("hi")).otherwise(F.col("lo"))
    cut = F.when(F.col("s") == 0, F.lit(1e300)).otherwise(fmin * limit / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")))
    last = F.floor((F.least(cut, F.lit(fmin + k * df)) - fmin) / df + 1e-9)
    kept = F.when(cut < fmin, 0).when(cut >= 1e300, k).otherwise(F.greatest(F.least(last + 1, F.lit(k)), F.lit(0)))
    return met.select("p", kept.cast("long").alias("kept"))
