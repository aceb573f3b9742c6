"""Raw echoes and phase histories: simulation, spectra, regridding and gates on lines.

Echoes meet targets by an interval join on delay; everything along a line is a narrow kernel.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cx
from ..functions.geodesy import C
from .lines import corner_turn, map_lines, not_a_knot, sinc_read
from .steps import dealt


def chirp_echoes(targets: DataFrame, pulses: DataFrame, samples: int, *, fs: float, start: float, rate: float, length: float, fc: float, beam: float) -> DataFrame:
    """Raw samples (p, n, re, im): the sum over targets (x, y, z, amp) in the beam of amp exp(j pi rate t^2 - 2 pi j fc delay).

    Sample n of a pulse (p, ax, ay, az) stands at delay ``start`` + n / ``fs``; an echo lasts ``length``
    about its delay, so a target makes rows only for the samples it reaches.  A target is in the beam while
    its angle off broadside (the y axis is the track) has a sine of ``beam`` or less.

    Targets at one place are one with the sum of their amplitudes, and pulses sent from one place share their
    echoes.  Targets meet pulses by strips of y as wide as the beam reaches, and the next strips.
    """
    targets = targets.groupBy("x", "y", "z").agg(F.sum("amp").alias("amp"))
    places = dealt(pulses.select("ax", "ay", "az").distinct(), "ax", "ay", "az")
    wide = _strip(targets, pulses, beam)
    strip = lambda y: F.floor(F.col(y) / wide) if wide else F.lit(0).cast("long")
    near = places.select("*", F.explode(F.array(*(strip("ay") + k for k in ((-1, 0, 1) if wide else (0,))))).alias("strip"))
    d = [F.col(x) - F.col(f"a{x}") for x in "xyz"]
    met = near.join(targets.select("*", strip("y").alias("strip")), "strip").filter(F.abs(F.col("y") - F.col("ay")) <= beam * F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    met = met.select("ax", "ay", "az", "amp", (2 * F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) / C).alias("delay"))
    first = F.greatest(F.ceil((F.col("delay") - length / 2 - start) * fs), F.lit(0))
    last = F.least(F.floor((F.col("delay") + length / 2 - start) * fs), F.lit(samples - 1))
    each = met.filter(first <= last).select("ax", "ay", "az", "amp", "delay", F.explode(F.sequence(first, last)).alias("n"))
    t = start + F.col("n") / fs - F.col("delay")
    re, im = cx.turn(0.5 * rate * t * t - fc * F.col("delay"))
    echoes = each.groupBy("ax", "ay", "az", "n").agg(F.sum(F.col("amp") * re).alias("re"), F.sum(F.col("amp") * im).alias("im"))
    return pulses.join(echoes, ["ax", "ay", "az"]).select("p", "n", "re", "im")


def _strip(targets: DataFrame, pulses: DataFrame, beam: float) -> float | None:
    """The farthest along y that a target in the beam is from its pulse; None if nothing bounds it."""
    ends = lambda *names: [f(n).cast("double").alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]
    r = targets.agg(*ends("x", "z")).crossJoin(pulses.agg(*ends("ax", "az"))).first().asDict()  # a single row
    if beam >= 1 or None in r.values():
        return None
    across = math.hypot(*(max(r[f"max_{c}"] - r[f"min_a{c}"], r[f"max_a{c}"] - r[f"min_{c}"]) for c in "xz"))
    far = beam * across / math.sqrt(1 - beam * beam) * (1 + 1e-9)
    return far if 0 < far < math.inf else None


def to_history(compressed: DataFrame, *, fs: float, fc: float, start: float, band: float, reference: Callable[[int], float]) -> DataFrame:
    """Range-compressed lines as frequency samples over ``band`` (Hz) about ``fc``, phases relative to a delay by line."""

    def kernel(line: int, z: np.ndarray) -> np.ndarray:
        f = np.fft.fftshift(np.fft.fftfreq(len(z), 1 / fs))
        keep = np.abs(f) <= band / 2
        spectrum = np.fft.fftshift(np.fft.fft(z))[keep]
        return spectrum * np.exp(-2j * np.pi * f[keep] * (start - reference(line))) * np.exp(2j * np.pi * fc * reference(line))

    return map_lines(compressed, kernel)


def regrid_frequency(lines: DataFrame, first: Callable[[int], float], step: Callable[[int], float], grid: np.ndarray, taps: int = 16) -> DataFrame:
    """Lines whose samples stand at first + k step, read at the frequencies of one grid."""
    return map_lines(lines, lambda line, z: sinc_read(z, (grid - first(line)) / step(line), taps))


def regrid_pulses(lines: DataFrame, times: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """Lines at their pulse times read at other times, by a cubic spline along each sample."""

    def kernel(_: int, z: np.ndarray) -> np.ndarray:
        return not_a_knot(times, z)(wanted)

    return corner_turn(map_lines(corner_turn(lines), kernel))


def gate_plan(pulses: DataFrame, corners: list[tuple[float, float, float]], df: float, k: int, guard: int) -> DataFrame:
    """(p, first, count): the range bins (of c / (2 k df) metres, zero at the origin) that an image with these corners spans."""
    bin_size = C / (2 * k * df)
    a = [F.col(x) for x in ("ax", "ay", "az")]
    own = F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
    ranges = [(F.sqrt(sum(((F.lit(float(c)) - v) * (F.lit(float(c)) - v) for c, v in zip(corner, a, strict=True)), F.lit(0.0))) - own) / bin_size for corner in corners]
    low, high = F.floor(F.least(*ranges)) - guard, F.ceil(F.greatest(*ranges)) + guard
    return pulses.select("p", low.alias("first"), F.least(high - low + 1, F.lit(k)).alias("count"))


def mean_spectrum(lines: DataFrame) -> DataFrame:
    """(b, energy): the mean power of the lines' transforms by bin."""
    spectra = map_lines(lines, lambda _, z: np.abs(np.fft.fft(z)) ** 2 + 0j)
    return spectra.select(F.posexplode("re").alias("b", "e")).groupBy(F.col("b").cast("long").alias("b")).agg(F.avg("e").alias("energy"))


def smoothed(spectrum: DataFrame, n: int, width: int) -> DataFrame:
    """The circular moving mean of (b, energy) over ``width`` bins."""
    half = width // 2
    moved = spectrum.select("energy", F.explode(F.array(*(F.lit(d) for d in range(-half, half + 1)))).alias("d"), "b")
    return moved.groupBy(F.pmod(F.col("b") + F.col("d"), F.lit(n)).alias("b")).agg((F.sum("energy") / width).alias("energy"))


def spectral_gap(lines: DataFrame, n: int, width: int = 5) -> DataFrame:
    """(gap): the bin where the smoothed mean spectrum is least, and with it the whole samples that unwrap the band."""
    s = smoothed(mean_spectrum(lines), n, width)
    return s.agg(F.min_by("b", F.struct(F.round("energy", 9), F.col("b"))).alias("gap"))


def occupied_band(lines: DataFrame, n: int, width: int = 3) -> tuple[int, int]:
    """First bin and number of bins of the occupied band: from the emptiest bin on, where the smoothed mean spectrum is above
    half its median over the strongest half.  The spectrum is n numbers on the driver."""
    energy = np.zeros(n)
    for r in smoothed(mean_spectrum(lines), n, width).collect():
        energy[r.b] = r.energy
    start = int(energy.argmin())
    turned = np.roll(energy, -start)
    inside = np.flatnonzero(turned >= 0.5 * np.median(np.sort(turned)[n // 2 :]))
    return (start + int(inside[0])) % n, int(inside[-1] - inside[0] + 1)


def noise_level(lines: DataFrame, cells: int = 8) -> DataFrame:
    """(noise, clutter): the least and the greatest mean power over cells of a range-Doppler map (cells x cells)."""
    spectra = corner_turn(map_lines(corner_turn(map_lines(lines, lambda _, z: np.fft.ifft(z))), lambda _, z: np.fft.fft(z)))
    each = spectra.select("line", F.posexplode(F.arrays_zip("re", "im")).alias("k", "v"), F.size("re").alias("n"))
    each = each.crossJoin(F.broadcast(spectra.agg((F.max("line") + 1).alias("m"))))  # a single row
    cell = [F.floor(F.col("line") * cells / F.col("m")), F.floor(F.col("k") * cells / F.col("n"))]
    power = F.col("v.re") * F.col("v.re") + F.col("v.im") * F.col("v.im")
    return each.groupBy(*cell).agg(F.avg(power).alias("p")).agg(F.min("p").alias("noise"), F.max("p").alias("clutter"))


def internal_delay(lines: DataFrame, replica: np.ndarray, fs: float) -> DataFrame:
    """(line, delay): the delay of a calibration pulse: the peak of its correlation with the replica, refined by a parabola."""

    def kernel(_: int, z: np.ndarray) -> np.ndarray:
        c = np.abs(np.correlate(z, replica, "full"))[len(replica) - 1 :]
        k = int(c.argmax())
        if not 0 < k < len(c) - 1:
            return np.array([k / fs + 0j])
        u, v, w = c[k - 1 : k + 2]
        bend = u - 2 * v + w
        return np.array([(k + (0.5 * (u - w) / bend if bend else 0.0)) / fs + 0j])

    return map_lines(lines, kernel).select("line", F.get("re", F.lit(0)).alias("delay"))
