"""Batches by write count, and when merges happen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_numbers(df: DataFrame, seq: str = "seq", chunk: int = 1 << 20) -> DataFrame:
    """``df`` with write_no, the place of each row in sequence order from 1.

    Rows are numbered inside chunks of sequence numbers, and chunk counts are
    summed over the far smaller table of chunks.
    """
    cut = df.withColumn("__chunk", F.floor(F.col(seq) / chunk))
    counts = cut.groupBy("__chunk").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__chunk", before.alias("__start"))
    inner = F.row_number().over(W.partitionBy("__chunk").orderBy(seq))
    return cut.withColumn("__inner", inner).join(starts, "__chunk").withColumn("write_no", (F.col("__start") + F.col("__inner")).cast("long")).drop("__chunk", "__inner", "__start")


def rotate(df: DataFrame, max_writes: int, seq: str = "seq") -> DataFrame:
    """``df`` with write_no and run_no: a batch closes after ``max_writes`` writes, repeated keys counted; at most 1 closes after each."""
    return write_numbers(df, seq).withColumn("run_no", F.floor((F.col("write_no") - 1) / max(1, max_writes)).cast("long"))


def runs_after(flushes: Column, threshold: Column) -> Column:
    """Runs that are left after ``flushes`` flushes, when ``threshold`` runs are merged into one as soon as they are there."""
    cycle = F.lit(1) + F.pmod(flushes - threshold, F.greatest(threshold - 1, F.lit(1)))
    return F.when(flushes <= 0, F.lit(0)).when(threshold <= 1, F.lit(1)).when(flushes < threshold, flushes).otherwise(cycle).cast("long")
