"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace


def connected_components(links: DataFrame, work: Workspace, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b); component is the least node reached.

    Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond",
    2014) until nothing changes: a logarithmic number of rounds in practice, each a few exchanges of
    the remaining links.  Least neighbours are found by pre-aggregated minima and joined back, so a
    node with very many links is never gathered; its links are split by Spark's skew handling.
    Every round is written to the shared folder, and a round that does not end is an error.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = both.join(least, "a")
        if large:
            return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.filter("a != b").distinct()

    edges = work.table(f"{name}-0", links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for k in range(1, most_rounds + 1):
        edges = work.table(f"{name}-{k}", star(star(edges, True), False))
        work.drop(f"{name}-{k - 1}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        mark = state
    raise RuntimeError(f"connected components: no end after {most_rounds} rounds")
