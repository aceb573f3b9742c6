"""Raster operators on pixel rows (i, j, values).

Neighbourhoods are window frames along a line, and block statistics are
aggregations with map-side combination.  A scene of many images carries its
key in ``by``; lines of one image are then the partitions of a window, so no
task holds more than a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cx
from ..functions.radar import decibels, to_byte
from .lines import spline_percentile
from .order import Ranked, percentile


def multilook(pixels: DataFrame, la: int, lr: int, values: dict[str, Column], by: tuple[str, ...] = (), whole: bool = True) -> DataFrame:
    """Means over la x lr boxes; incomplete boxes at the far edges are dropped, or kept if not ``whole``."""
    keys = [*by, F.floor(F.col("i") / la).alias("bi"), F.floor(F.col("j") / lr).alias("bj")]
    means = [F.avg(v).alias(n) for n, v in values.items()]
    if not whole:
        return pixels.groupBy(*keys).agg(*means)
    size = pixels.groupBy(*by).agg((F.max("i") + 1).alias("_nx"), (F.max("j") + 1).alias("_ny"))
    met = pixels.join(F.broadcast(size), list(by)) if by else pixels.crossJoin(F.broadcast(size))  # one row for each image
    inside = met.filter((F.col("i") < F.col("_nx") - F.col("_nx") % la) & (F.col("j") < F.col("_ny") - F.col("_ny") % lr))
    return inside.groupBy(*keys).agg(*means)


def _frame_mean(df: DataFrame, names: list[str], along: str, across: list[str], width: int) -> DataFrame:
    """Moving means along one axis of a dense grid; beyond an edge the edge value repeats."""
    lo, hi = (width - 1) // 2, width // 2
    line = Window.partitionBy(*across)
    frame = line.orderBy(along).rowsBetween(-lo, hi)
    left = F.greatest(lo - (F.col(along) - F.min(along).over(line)), F.lit(0))
    right = F.greatest(hi - (F.max(along).over(line) - F.col(along)), F.lit(0))
    means = {n: (F.sum(n).over(frame) + left * F.min_by(n, along).over(line) + right * F.max_by(n, along).over(line)) / width for n in names}
    return df.withColumns(means)


def box_mean(pixels: DataFrame, names: list[str], w1: int, w2: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Moving means over w1 x w2 windows of a dense grid, same shape, nearest edges."""
    keep = pixels.select(*by, "i", "j", *names)
    return _frame_mean(_frame_mean(keep, names, "j", [*by, "i"], w2), names, "i", [*by, "j"], w1)


def cross_terms(pair: DataFrame) -> DataFrame:
    """Products of a pair (ar, ai, br, bi): the cross product xr, xi and both powers pa, pb."""
    a, b = cx.pair("ar", "ai"), cx.pair("br", "bi")
    xr, xi = cx.times_conjugate(a, b)
    return pair.select("i", "j", xr.alias("xr"), xi.alias("xi"), cx.power(a).alias("pa"), cx.power(b).alias("pb"))


def coherence(pair: DataFrame, w1: int = 5, w2: int = 5) -> DataFrame:
    """Sample coherence of a pair over moving windows: i, j, coherence and the averaged products."""
    m = box_mean(cross_terms(pair), ["xr", "xi", "pa", "pb"], w1, w2)
    value = F.sqrt(F.col("xr") * F.col("xr") + F.col("xi") * F.col("xi")) / F.greatest(F.sqrt(F.col("pa") * F.col("pb")), F.lit(1e-300))
    return m.withColumn("coherence", value)


def map_statistics(values: DataFrame, name: str) -> DataFrame:
    """Median, 90th percentile, mean and the shares above one half and seven tenths."""
    v = F.col(name)
    with Ranked(values, v) as ranked:
        found = ranked.percentiles([0.5, 0.9])
        rest = ranked.values.agg(F.avg("v"), F.avg((F.col("v") > 0.5).cast("double")), F.avg((F.col("v") > 0.7).cast("double"))).first()
    row = (found.get((0, 0.5)), found.get((0, 0.9)), *rest)
    return values.sparkSession.createDataFrame([row], "median double, p90 double, mean double, above_half double, above_seven_tenths double")


def displaced(pair: DataFrame, s: int) -> DataFrame:
    """The pair with its second image moved by s rows: a[s:] against b[:-s]."""
    b = pair.select((F.col("i") + s).alias("i"), "j", "br", "bi")
    return pair.select("i", "j", "ar", "ai").join(b, ["i", "j"])


def sva(pixels: DataFrame, step: int = 2, joint: bool = True, axes: tuple[str, ...] = ("j", "i")) -> DataFrame:
    """Spatially variant apodization: range first, then azimuth, neighbours outside the image are zero."""
    out = pixels.select("i", "j", "re", "im")
    for axis in axes:
        line = Window.partitionBy("i" if axis == "j" else "j").orderBy(axis)
        side = {n: F.coalesce(F.lag(n, step).over(line), F.lit(0.0)) + F.coalesce(F.lead(n, step).over(line), F.lit(0.0)) for n in ("re", "im")}
        out = out.withColumns({"_br": side["re"], "_bi": side["im"]})
        x, b = cx.pair("re", "im"), cx.pair("_br", "_bi")

        def weight(top: Column, low: Column) -> Column:
            return F.when(low == 0, 0.0).otherwise(F.least(F.greatest(-top / F.when(low == 0, 1.0).otherwise(low), F.lit(0.0)), F.lit(0.5)))

        if joint:
            w = weight(x[0] * b[0] + x[1] * b[1], cx.power(b))
            out = out.select("i", "j", (x[0] + w * b[0]).alias("re"), (x[1] + w * b[1]).alias("im"))
        else:
            out = out.select("i", "j", (x[0] + weight(x[0], b[0]) * b[0]).alias("re"), (x[1] + weight(x[1], b[1]) * b[1]).alias("im"))
    return out


def with_scalars(pixels: DataFrame, **aggregates: Column) -> DataFrame:
    """Every pixel with statistics of the whole image: one aggregated row, joined by broadcast."""
    return pixels.crossJoin(F.broadcast(pixels.agg(*(v.alias(n) for n, v in aggregates.items()))))  # a single row


# Lowest display value and span of the logarithmic density remaps.
DENSITY = {"density": (30.0, 40.0), "brighter": (60.0, 40.0), "darker": (0.0, 40.0), "highcontrast": (30.0, 4.0)}


def density(amplitude: Column, mean: Column, low: float, span: float) -> Column:
    """Log amplitude with 0.8 of the mean at ``low`` and ``span`` times that at 255."""
    start = 0.8 * mean
    m = (255.0 - low) / F.log10(start * span / start)
    return m * F.log10(F.greatest(amplitude, F.lit(1e-5))) + (low - m * F.log10(start))


def remap(pixels: DataFrame, kind: str, spline: bool = True) -> DataFrame:
    """Display values (i, j, value) of amplitudes (i, j, a); ``spline``: the knee of nrl by the spline through ranks, else linear."""
    a = F.col("a")
    if kind in DENSITY or kind == "pedf":
        d = density(a, F.col("mean"), *DENSITY["density" if kind == "pedf" else kind])
        d = F.when(d > 128, 0.5 * (d + 128)).otherwise(d) if kind == "pedf" else d
        return with_scalars(pixels, mean=F.avg("a")).select("i", "j", to_byte(d).alias("value"))
    if kind == "nrl":
        knee = F.lit(spline_percentile(pixels, "a", 99.0)).cast("double") if spline else percentile(pixels, a, 0.99)
        met = with_scalars(pixels, low=F.min("a"), high=F.max("a")).withColumn("p99", knee)
        knee = F.col("p99") - F.col("low")
        flat = (a - F.col("low")) * 220.0 / knee
        bent = (255.0 - 220.0) / F.log10((F.col("high") - F.col("low")) / knee) * F.log10(F.greatest(a - F.col("low"), F.lit(1e-300)) / knee) + 220.0
        return met.select("i", "j", to_byte(F.when(a <= F.col("p99"), flat).otherwise(bent)).alias("value"))
    if kind == "log":
        met = with_scalars(pixels, mean=F.avg("a"), low=F.min("a"))
        level = F.greatest(1.0 - 10.0 * F.col("low") / F.col("mean"), F.lit(0.0))
        met = met.select("i", "j", (10.0 * a / F.col("mean") + level).alias("b"))
        met = with_scalars(met, power=F.avg(F.col("b") * F.col("b")), db_low=F.min(20 * F.log10("b")), db_high=F.max(20 * F.log10("b")))
        center = 10 * F.log10("power")
        lo, hi = F.greatest(center - 25, "db_low"), F.least(center + 25, "db_high")
        return met.select("i", "j", to_byte((F.least(F.greatest(20 * F.log10("b"), lo), hi) - lo) / (hi - lo) * 255).alias("value"))
    if kind == "linear":
        return pixels.select("i", "j", a.alias("value"))
    raise ValueError(f"unknown remap {kind!r}")


def level(pixels: DataFrame, how: str = "clipped") -> DataFrame:
    """Brightness of powers (i, j, p) on every second pixel: the mean below the 99th percentile, or the median."""
    some = pixels.filter((F.col("i") % 2 == 0) & (F.col("j") % 2 == 0) & (F.col("p") > 0))
    if how == "median":
        return some.agg(F.max(percentile(some, F.col("p"), 0.5)).alias("level"))
    return some.filter(F.col("p") <= percentile(some, F.col("p"), 0.99)).agg(F.avg("p").alias("level"))


def stack_mean(stack: DataFrame, equalize: bool = True) -> DataFrame:
    """Incoherent mean of images (img_id, i, j, p): sum of gain x power over the images valid at a pixel.

    Gains bring every image to the level (the mean below its 99th percentile) of the first.  One
    row of gains for each image is broadcast; pixels meet in one aggregation with partial sums.
    """
    valid = stack.filter("p > 0")
    if equalize:
        with Ranked(valid, F.col("p"), F.col("img_id")) as ranked:
            found = ranked.percentiles([0.99])
        top = stack.sparkSession.createDataFrame([(g, v) for (g, _), v in found.items()], "img_id long, p99 double")
        levels = valid.join(F.broadcast(top), "img_id").filter("p <= p99").groupBy("img_id").agg(F.avg("p").alias("level"))
        first = levels.agg(F.min_by("level", "img_id").alias("first"))
        gains = levels.crossJoin(F.broadcast(first)).select("img_id", (F.col("first") / F.col("level")).alias("gain"))
        valid = valid.join(F.broadcast(gains), "img_id")
    else:
        valid = valid.withColumn("gain", F.lit(1.0))
    return valid.groupBy("i", "j").agg((F.sum(F.col("gain") * F.col("p")) / F.count("*")).alias("p"), F.count("*").alias("n"))


def change(pair: DataFrame, window: int = 5) -> DataFrame:
    """Coherent change detection: intensity ratio (dB less its median), coherence, and the coherence that noise allows.

    Noise is the 0.5th percentile of the 15 x 15 mean power of each image.
    """
    box = coherence(pair, window, window).withColumn("ratio", decibels(F.col("pb")) - decibels(F.col("pa"))).persist()
    noise = box_mean(cross_terms(pair), ["pa", "pb"], 15, 15).filter((F.col("i") % 4 == 0) & (F.col("j") % 4 == 0))
    both = noise.select(F.inline(F.array(F.struct(F.lit(0).alias("image"), F.col("pa").alias("p")), F.struct(F.lit(1).alias("image"), F.col("pb").alias("p")))))
    with Ranked(both, F.col("p"), F.col("image")) as ranked:
        least = ranked.percentiles([0.005])
    met = box.withColumns({n: F.lit(least.get((k, 0.005))).cast("double") for k, n in enumerate(("na", "nb"))}).withColumn("middle", percentile(box, F.col("ratio"), 0.5))
    snr = [F.greatest((F.col(p) - F.col(n)) / F.col(n), F.lit(1e-30)) for p, n in (("pa", "na"), ("pb", "nb"))]
    allowed = 1 / F.sqrt((1 + 1 / snr[0]) * (1 + 1 / snr[1]))
    return met.select("i", "j", (F.col("ratio") - F.col("middle")).alias("ratio_db"), "coherence", allowed.alias("allowed"))


def coherent_sum(pair: DataFrame, window: int = 15, core: int = 5) -> DataFrame:
    """a + amp b aligned in phase by the ring of the window around its core; amp matches the mean powers."""
    terms = cross_terms(pair)
    outer = box_mean(terms, ["xr", "xi"], window, window)
    ring = outer.select("i", "j", *((F.col(c) * window * window).alias(c) for c in ("xr", "xi")))
    if window > core + 2:
        inner = box_mean(terms, ["xr", "xi"], core, core).select("i", "j", F.col("xr").alias("cr"), F.col("xi").alias("ci"))
        ring = ring.join(inner, ["i", "j"]).select("i", "j", (F.col("xr") - core * core * F.col("cr")).alias("xr"), (F.col("xi") - core * core * F.col("ci")).alias("xi"))
    amp = terms.agg(F.sqrt(F.sum("pa") / F.sum("pb")).alias("amp"))
    met = pair.join(ring, ["i", "j"]).crossJoin(F.broadcast(amp))
    size = F.greatest(F.sqrt(F.col("xr") * F.col("xr") + F.col("xi") * F.col("xi")), F.lit(1e-300))
    br, bi = cx.times(cx.pair("br", "bi"), (F.col("xr") / size, F.col("xi") / size))
    return met.select("i", "j", (F.col("ar") + F.col("amp") * br).alias("re"), (F.col("ai") + F.col("amp") * bi).alias("im"))


def bilinear(pixels: DataFrame, points: DataFrame, value: str) -> DataFrame:
    """Values at fractional places (id, x, y) of a grid (i, j, value): four weighted taps joined by cell; null outside."""
    size = F.broadcast(pixels.agg(F.max("i").alias("mi"), F.max("j").alias("mj")))
    inside = points.crossJoin(size).filter((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") <= F.col("mi")) & (F.col("y") <= F.col("mj")))
    cell = inside.select("id", "x", "y", F.least(F.floor("x"), F.col("mi") - 1).alias("ci"), F.least(F.floor("y"), F.col("mj") - 1).alias("cj"))
    fx, fy = F.col("x") - F.col("ci"), F.col("y") - F.col("cj")
    taps = [F.struct((F.col("ci") + di).alias("i"), (F.col("cj") + dj).alias("j"), ((fx if di else 1 - fx) * (fy if dj else 1 - fy)).alias("w")) for di in (0, 1) for dj in (0, 1)]
    read = cell.select("id", F.inline(F.array(*taps))).join(pixels.select("i", "j", value), ["i", "j"]).groupBy("id").agg(F.sum(F.col("w") * F.col(value)).alias(value))
    return points.select("id").join(read, "id", "left")
