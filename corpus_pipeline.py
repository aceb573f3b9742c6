"""From raw documents to packed sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  A stage works on every row that its
predecessor kept, and what it decides takes effect in its result.

In every stage a null text is a text without words, extra columns stay as they
are whatever their names, repeated rows are rows of their own unless a stage says
otherwise, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoframe.llm.decontamination import remove_contaminated
from echoframe.llm.importance import keep_selected
from echoframe.llm.jaccard_join import keep_one_of_each_group
from echoframe.llm.line_dedup import dedup_lines
from echoframe.llm.packing_bins import pack_documents
from echoframe.llm.store import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that importance resampling against the labelled target selects.

    Null and blank texts have weight one; equal keys at the cut all stay.  Without target labels all rows stay.
    """
    return keep_selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated chunks and passages of lines; n_chars follows the text.

    No row goes; a text may become empty, a null one stays null.  The first copy by (doc_id, place) stays.
    """
    out = dedup_lines(docs)
    n_chars = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the least doc_id.

    Texts without words are in no group and stay.  Rows that repeat doc_id and text stay once.
    """
    return keep_one_of_each_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of the benchmark; null texts stay, null items are in no text."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts, each with its place in a sequence of at most 2048 tokens; a null text is its end token."""
    return pack_documents(docs, keep_ids=False)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packing)]

#: Importance weights, hashed signatures and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = work.table(name, stage(spark, docs, sf_dir))
        if before:
            work.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
