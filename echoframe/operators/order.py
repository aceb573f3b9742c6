"""Exact order statistics without a sort and without a buffer of all values.

A rank is sought by counting: the interval that holds it is cut into cells, one
aggregation counts the cells, and the cell with the rank is the next interval.
Each pass is a map-side aggregation into at most ``cells`` rows for a group and
rank, so memory does not grow with the image; four to five passes reach a single
value of any distribution.  Values are kept for the passes by Spark's cache,
which recomputes what a lost executor held.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Ranked:
    """The finite values of a column by group; ``by`` groups are few (rows on the driver)."""

    def __init__(self, df: DataFrame, value: Column, by: Column | None = None, cells: int = 4096):
        v = value.cast("double")
        self.cells, self.spark = cells, df.sparkSession
        kept = df.select((F.lit(0) if by is None else by).alias("g"), v.alias("v"))
        self.values = kept.filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))).persist()
        rows = self.values.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        self.groups = {r.g: (r.n, r.low, r.high) for r in rows}

    def __enter__(self) -> Ranked:
        return self

    def __exit__(self, *_: object) -> None:
        self.values.unpersist()

    def at(self, wanted: Iterable[tuple[object, int]]) -> dict[tuple[object, int], float]:
        """The value of rank k (from 0) in group g, for each (g, k)."""
        found: dict[tuple[object, int], float] = {}
        state = {(g, k): (self.groups[g][1], self.groups[g][2], k) for g, k in set(wanted)}
        while state:
            for key in [key for key, (low, high, _) in state.items() if low == high]:
                found[key] = state.pop(key)[0]
            if not state:
                break
            spans = sorted({(g, low, high) for (g, _), (low, high, _) in state.items()})
            table = F.broadcast(self.spark.createDataFrame([(n, *s) for n, s in enumerate(spans)], f"s int, h {self.values.schema['g'].dataType.simpleString()}, low double, high double"))
            width = (F.col("high") - F.col("low")) / self.cells
            cell = F.when(F.col("low") + width > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(self.cells - 1))).otherwise((F.col("v") >= F.col("high")).cast("long"))
            inside = self.values.join(table, (F.col("g") == F.col("h")) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
            counted: dict[int, list] = {}
            for r in inside.groupBy("s", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect():
                counted.setdefault(r.s, []).append((r.cell, r.n, r.a, r.b))
            place = {s: sorted(counted[n]) for n, s in enumerate(spans)}
            for (g, k), (low, high, left) in list(state.items()):
                for _, n, a, b in place[g, low, high]:
                    if left < n:
                        state[g, k] = (a, b, left)
                        break
                    left -= n
        return found

    def percentiles(self, shares: Sequence[float]) -> dict[tuple[object, float], float]:
        """By (group, share): linear between the ranks about (n - 1) share."""
        ranks = {(g, s): (n - 1) * s for g, (n, _, _) in self.groups.items() for s in shares}
        read = self.at((g, int(k)) for (g, _), h in ranks.items() for k in (np.floor(h), np.ceil(h)))
        out = {}
        for (g, s), h in ranks.items():
            a, b = read[g, int(np.floor(h))], read[g, int(np.ceil(h))]
            out[g, s] = float(a + (h - np.floor(h)) * (b - a))
        return out


def percentile(df: DataFrame, value: Column, share: float) -> Column:
    """One percentile of all values as a literal; null without values."""
    with Ranked(df, value) as ranked:
        found = ranked.percentiles([share])
    return F.lit(found.get((0, share))).cast("double")
