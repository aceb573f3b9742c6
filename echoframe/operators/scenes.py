"""Scenes and tracks to simulate, alike on every cluster: numbers follow from row numbers and a seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesy import C


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed only."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)


def normal(key: Column, seed: int) -> Column:
    """A standard normal number of a key (Box and Muller)."""
    return F.sqrt(-2 * F.log(uniform(key, seed))) * F.cos(2 * math.pi * uniform(key, seed + 1))


def track(spark: SparkSession, pulses: int, *, resolution: float, r0: float, graze: float, fc: float) -> DataFrame:
    """Pulses (p, ax, ay, az) of a straight broadside track that resolves ``resolution`` metres in azimuth."""
    turn = C / (2 * fc * resolution * math.cos(math.radians(graze)))
    ground, up = r0 * math.cos(math.radians(graze)), r0 * math.sin(math.radians(graze))
    step = 2 * ground * math.tan(turn / 2) / max(1, pulses - 1)
    p = F.col("id")
    return spark.range(pulses).select(p.alias("p"), F.lit(-ground).alias("ax"), ((p - (pulses - 1) / 2) * step).alias("ay"), F.lit(up).alias("az"))


def band(resolution: float, graze: float, fc: float, samples: int) -> tuple[float, float]:
    """First frequency and step of a band that resolves ``resolution`` metres on the ground."""
    width = C / (2 * resolution * math.cos(math.radians(graze)))
    return fc - width / 2, width / (samples - 1)


def points(spark: SparkSession, side: int, spacing: float) -> DataFrame:
    """A square of point targets (x, y, z, amp) about the origin."""
    k = F.col("id")
    middle = (side - 1) / 2
    return spark.range(side * side).select(((F.floor(k / side) - middle) * spacing).alias("x"), ((k % side - middle) * spacing).alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("amp"))


def clutter(spark: SparkSession, count: int, extent: float, level_db: float = 0.0, seed: int = 1) -> DataFrame:
    """Scatterers (x, y, z, amp) spread evenly over a square, amplitudes normal about zero at a level."""
    k = F.col("id")
    return spark.range(count).select(((uniform(k, seed) - 0.5) * extent).alias("x"), ((uniform(k, seed + 10) - 0.5) * extent).alias("y"), F.lit(0.0).alias("z"), (normal(k, seed + 20) * 10 ** (level_db / 20)).alias("amp"))


def noise(history: DataFrame, power: float, seed: int = 7) -> DataFrame:
    """A history (p, k, re, im) with complex normal noise of a power a sample."""
    key = F.struct("p", "k")
    scale = math.sqrt(power / 2)
    return history.select("p", "k", (F.col("re") + scale * normal(key, seed)).alias("re"), (F.col("im") + scale * normal(key, seed + 100)).alias("im"))


def capabilities(spark: SparkSession) -> DataFrame:
    """(name, version): what this installation offers; a null version is absent."""
    import importlib.metadata
    import platform

    def version(name: str) -> str | None:
        try:
            return importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            return None

    rows = [("spark", spark.version), ("python", platform.python_version()), ("java", spark.sparkContext._jvm.System.getProperty("java.version"))]
    return spark.createDataFrame(rows + [(n, version(n)) for n in ("numpy", "pyarrow", "pandas", "duckdb", "h5py", "rasterio")], "name string, version string")


def require(module: str, purpose: str):
    """A module, or an error that says what it is needed for."""
    import importlib

    try:
        return importlib.import_module(module)
    except ModuleNotFoundError:
        raise ImportError(f"{purpose} needs {module}, which is not installed") from None


def block_rows(row_bytes: int, copies: float, memory: int, cores: int, share: float = 0.5) -> int:
    """Rows of a block so that ``copies`` of it in each of an executor's ``cores`` tasks take ``share`` of its memory; a warning
    where even one row does not fit."""
    import warnings

    rows = int(memory * share / cores / (row_bytes * copies))
    if rows < 1:
        warnings.warn(f"one row of {row_bytes} bytes takes more than a task's share of memory", ResourceWarning, stacklevel=2)
    return max(1, rows)
