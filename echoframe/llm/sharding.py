"""Sharding by extendible hashing.

A directory maps prefixes of a document's hash bits to buckets.  Only a bucket
above the byte limit splits, on its next bit, until every bucket fits or holds
a single hash value.  The final bucket of a document so is the shortest prefix
whose bytes fit.

Spark plan
----------
Bytes are summed at one fine prefix depth (pre-aggregated; a few hundred cells
for each shard), then for every shorter depth from those cells, never again
from documents.  Cells that are too large even there, if any, are refined by
``step`` more bits from their own documents alone.  Documents meet their cell's
depth in one join; texts take no part in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace

BITS = 60


def hash_bits(doc_id: str | Column) -> Column:
    """The first 60 bits of the MD5 of an id as text; of the empty text for null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: int | Column) -> Column:
    """The bits above ``depth``; a shift by all 60 bits gives 0."""
    return F.expr(f"shiftright(hash, {BITS} - {depth})")


def assign_shards(docs: DataFrame, *, limit_bytes: int, step: int = 8) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, bytes, depth, shard (bits of the prefix) and shard_bytes.

    ``bytes`` is the UTF-8 length of the text, 0 for null.  Rows with one doc_id have one hash and
    stay together; a shard that holds one hash value only may exceed the limit, no other does.
    A table that fits is one shard, the empty prefix.  A null doc_id is hashed as the empty text.
    Other columns are ignored.  An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "shards")
    rows = work.table("rows", docs.select(F.col("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), hash_bits("doc_id").alias("hash")))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth = min(BITS, max(1, total // limit_bytes).bit_length() + step)
    first, left, found = 0, rows, []
    while True:
        cells = left.groupBy(_prefix(depth).alias("cell")).agg(F.sum("bytes").alias("b"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        cells = work.table(f"cells-{depth}", cells)
        deeper = cells.select("cell", "b", "low", "high", F.explode(F.sequence(F.lit(first), F.lit(depth))).alias("depth"))
        sums = deeper.groupBy("depth", F.expr(f"shiftright(cell, {depth} - depth)").alias("p")).agg(F.sum("b").alias("b"), F.min("low").alias("low"), F.max("high").alias("high"))
        fits = sums.filter((F.col("b") <= limit_bytes) | (F.col("low") == F.col("high")))
        best = deeper.select("cell", "depth", F.expr(f"shiftright(cell, {depth} - depth)").alias("p")).join(fits.select("depth", "p", F.col("b").alias("shard_bytes")), ["depth", "p"])
        best = work.table(f"depths-{depth}", best.groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes")).alias("at")))
        found.append(left.withColumn("cell", _prefix(depth)).join(best, "cell").select("doc_id", "bytes", "hash", "at.depth", "at.shard_bytes"))
        open_cells = cells.join(best, "cell", "left_anti")
        if depth == BITS or open_cells.isEmpty():
            break
        left = work.table(f"left-{depth}", left.withColumn("cell", _prefix(depth)).join(open_cells.select("cell"), "cell", "left_semi").drop("cell"))
        first, depth = depth + 1, min(BITS, depth + step)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "bytes", F.col("depth").cast("long").alias("depth"), F.expr(f"substring(lpad(bin(hash), {BITS}, '0'), 1, depth)").alias("shard"), "shard_bytes")


def write_shards(docs: DataFrame, path: str, *, limit_bytes: int) -> None:
    """Write the rows of ``docs`` as Parquet, a folder for each shard (``_`` is the empty prefix)."""
    shards = assign_shards(docs, limit_bytes=limit_bytes).select(F.col("doc_id").alias("_id"), F.concat(F.lit("_"), "shard").alias("shard")).distinct()
    named = docs.join(shards, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    named.repartition("shard").write.partitionBy("shard").parquet(path)
