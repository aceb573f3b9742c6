"""Readers and writers of radar containers and images, as Python data sources.

``register(spark)`` makes the formats ``cphd``, ``nitf`` and ``png`` known to
``spark.read.format`` and ``df.write.format``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    from .cphd import CphdSource
    from .nitf import NitfSource
    from .png import PngSource

    for source in (CphdSource, NitfSource, PngSource):
        spark.dataSource.register(source)


def read_collection(spark: SparkSession, path: str, **options):
    """A phase history by the kind of its file: only CPHD has a reader here; others are refused by name."""
    lower = path.lower()
    if lower.endswith((".cphd", ".cphd03")):
        return spark.read.format("cphd").options(**options).load(path)
    if lower.endswith((".h5", ".hdf5")):
        raise ImportError(f"{path}: reading HDF5 collections needs h5py, which is not installed")
    raise ValueError(f"{path}: not a collection that can be read")
