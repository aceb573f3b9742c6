"""Deterministic rasters from the driver's tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A complex image (i, j, re, im), 32 columns wide: a row of each embedding."""
    e = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.struct(j.cast("long").alias("j"), F.get(e, j).alias("re"), F.get(e, j + 32).alias("im")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.inline(parts))


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two images (i, j, ar, ai, br, bi): the two halves of the scene; an odd last row has no partner and stays out."""
    half = table(spark, sf_dir, "embeddings").agg(F.expr("(max(vec_id) + 1) div 2").alias("half"))
    both = scene(spark, sf_dir).crossJoin(F.broadcast(half)).filter(F.col("i") < 2 * F.col("half"))  # a single row
    a = F.when(F.col("i") < F.col("half"), F.struct("re", "im"))
    b = F.when(F.col("i") >= F.col("half"), F.struct("re", "im"))
    met = both.groupBy((F.col("i") % F.col("half")).alias("i"), "j").agg(F.max(a).alias("a"), F.max(b).alias("b"))
    return met.select("i", "j", F.col("a.re").alias("ar"), F.col("a.im").alias("ai"), F.col("b.re").alias("br"), F.col("b.im").alias("bi"))


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven power images (img_id, i, j, p) of 64 x 64 pixels, some of them empty."""
    keys = F.col("l_linenumber").cast("long").alias("img_id"), (F.col("l_orderkey") % 64).alias("i"), (F.col("l_partkey") % 64).alias("j")
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.count("*") / 100).alias("p"))


SCENE = """scene AS (
  SELECT vec_id AS i, unnest(range(32)) AS j, CAST(unnest(embedding[1:32]) AS DOUBLE) AS re, CAST(unnest(embedding[33:64]) AS DOUBLE) AS im FROM embeddings
)"""
PAIR = f"""{SCENE}, half AS (SELECT (max(vec_id) + 1) // 2 AS half FROM embeddings), pair AS (
  SELECT a.i, a.j, a.re AS ar, a.im AS ai, b.re AS br, b.im AS bi FROM scene a CROSS JOIN half JOIN scene b ON b.i = a.i + half AND b.j = a.j WHERE a.i < half
), terms AS (
  SELECT i, j, ar * br + ai * bi AS xr, ai * br - ar * bi AS xi, ar * ar + ai * ai AS pa, br * br + bi * bi AS pb FROM pair
)"""
STACK = """stack AS (
  SELECT CAST(l_linenumber AS BIGINT) AS img_id, l_orderkey % 64 AS i, l_partkey % 64 AS j,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS p
  FROM lineitem GROUP BY ALL
)"""


def box(source: str, names: str, w1: int, w2: int) -> str:
    """A SELECT of moving means with nearest edges: offsets joined by clamped index, one axis after the other."""

    def along(axis: str, other: str, width: int, rows: str) -> str:
        values = ", ".join(f"sum(q.{n}) / {width} AS {n}" for n in names.split())
        return f"""SELECT p.i, p.j, {values} FROM {rows} p CROSS JOIN (SELECT max({axis}) AS m FROM {source})
  CROSS JOIN (SELECT unnest(range({-((width - 1) // 2)}, {width // 2 + 1})) AS d)
  JOIN {rows} q ON q.{other} = p.{other} AND q.{axis} = greatest(0, least(m, p.{axis} + d)) GROUP BY p.i, p.j"""

    return along("i", "j", w1, f"({along('j', 'i', w2, source)})")


def _round(x, digits: int):
    """What F.round gives, without its decimal number for each value wherever no tie is near."""
    y = F.abs(x) * 10.0**digits
    clear = (y < 2.0**40) & (F.abs(y - F.floor(y) - 0.5) > 1e-3)
    return F.when(clear, F.signum(x) * F.floor(y + 0.5) / 10.0**digits).otherwise(F.round(x, digits))


def rounded(df: DataFrame, digits: int = 6, many: bool = False) -> DataFrame:
    """Every double rounded, negative zero made positive; ``many`` rows by a cheaper way to the same numbers."""
    near = _round if many else F.round
    return df.select(*((near(F.col(n), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


def rounded_sql(sql: str, doubles: str, others: str = "", digits: int = 6) -> str:
    """The same of a query's double columns; other columns as they are."""
    columns = [*others.split(), *(f"round({n}, {digits}) + 0e0 AS {n}" for n in doubles.split())]
    head, _, body = sql.rpartition("\n--\n")
    return f"{head}\nSELECT {', '.join(columns)} FROM ({body})"
