"""Cutting the lineage of an iteration, in the folder that the cluster's machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in ``spark.checkpoint.dir``; a local session without it gets a folder of its own."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="echoframe-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
