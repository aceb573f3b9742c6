"""Quality areas: connected regions of a mask that touch a seed, and polynomial calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut


def regions(mask: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(i, j, region) for the pixels (i, j) of a mask: the least pixel number i * 2^31 + j of its 4-connected region.

    Runs along a line are joined by one window, so that a round has a row for each run; runs that meet on
    neighbouring lines exchange their least label and point to the label's own label (pointer jumping),
    which ends in a logarithmic number of rounds in practice.  A mask that does not settle is an error.
    """
    line = Window.partitionBy("i").orderBy("j")
    runs = mask.select("i", "j").distinct().withColumn("run", F.col("j") - F.row_number().over(line))
    runs = runs.groupBy("i", "run").agg(F.min("j").alias("a"), F.max("j").alias("b"))
    runs = cut(runs.select("i", "a", "b", (F.col("i") * (1 << 31) + F.col("a")).alias("id")))
    below = runs.select((F.col("i") - 1).alias("i"), F.col("a").alias("c"), F.col("b").alias("d"), F.col("id").alias("other"))
    links = runs.join(below, "i").filter((F.col("c") <= F.col("b")) & (F.col("d") >= F.col("a"))).select("id", "other")
    links = cut(links.union(links.select("other", "id")))
    label = runs.select("id", F.col("id").alias("region"))
    mark = None
    for _ in range(most_rounds):
        near = links.join(label.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("region").alias("least"))
        new = label.join(near, "id", "left").select("id", F.least("region", F.coalesce("least", "region")).alias("region"))
        up = new.select(F.col("id").alias("region"), F.col("region").alias("top"))
        label = cut(new.join(up, "region").select("id", F.least("region", "top").alias("region")))
        state = label.agg(F.sum(F.col("region").cast("decimal(38,0)"))).first()[0]  # labels only fall
        if state == mark:
            return runs.join(label, "id").select("i", F.explode(F.sequence("a", "b")).alias("j"), "region")
        mark = state
    raise RuntimeError(f"regions: no end after {most_rounds} rounds")


def quality_area(values: DataFrame, test: Column, seed: Column) -> DataFrame:
    """(i, j): the pixels that pass ``test`` and are connected with one that passes ``seed`` too."""
    passing = values.filter(test)
    label = regions(passing.select("i", "j"))
    chosen = label.join(passing.filter(seed).select("i", "j"), ["i", "j"], "left_semi").select("region").distinct()
    return label.join(chosen, "region", "left_semi").select("i", "j")


def chebyshev_fit(samples: DataFrame, x: Column, y: Column, most_order: int = 8, within: float = 0.1) -> tuple[int, np.ndarray]:
    """The lowest order up to ``most_order`` whose Chebyshev series fits y(x), x in [-1, 1], to ``within`` dB, and its coefficients.

    Least squares in relative error.  The normal equations of the highest order are sums over the samples, one
    aggregation; lower orders are their leading parts.
    """
    terms: list[Column] = [F.lit(1.0), x]
    while len(terms) <= most_order:
        terms.append(2 * x * terms[-1] - terms[-2])
    n = most_order + 1
    scaled = [t / y for t in terms]
    sums = [F.sum(scaled[a] * scaled[b]) for a in range(n) for b in range(a, n)] + [F.sum(t) for t in scaled]
    row = samples.agg(*(s.alias(f"s{k}") for k, s in enumerate(sums))).first()
    m, at = np.zeros((n, n)), 0
    for a in range(n):
        for b in range(a, n):
            m[a, b] = m[b, a] = row[at]
            at += 1
    v = np.array(row[at:], np.float64)
    for order in range(n):
        c = np.linalg.lstsq(m[: order + 1, : order + 1], v[: order + 1], rcond=None)[0]
        fit = sum((float(k) * t for k, t in zip(c, terms, strict=False)), F.lit(0.0))
        worst = samples.agg(F.max(F.abs(10 * F.log10(F.greatest(fit / y, F.lit(1e-30)))))).first()[0]
        if worst is None or worst <= within or order == most_order:
            return order, c
    raise AssertionError
