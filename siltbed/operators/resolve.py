"""Last-writer-wins views and key lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltbed.model import precedence
from siltbed.sources.files import stored


def latest(df: DataFrame, order: Column | None = None, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """The version of each key with the greatest ``order`` (the sequence unless given), tombstones included.

    One aggregation with partial aggregates: a key that holds a third of the
    rows leaves each task as one row.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.col("seq") if order is None else order
    best = F.max_by(F.struct(*rest), order).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__best.{c}").alias(c) for c in rest))


def live(df: DataFrame) -> DataFrame:
    """Rows that are no tombstones."""
    return df.filter(~F.col("deleted"))


def resolve_layers(df: DataFrame) -> DataFrame:
    """The newest version of each key over layers, from rows with tier and position columns."""
    return latest(df, precedence(F.col("tier"), F.col("position"), F.col("seq"))).drop("tier", "position")


#: Row number within the partition, in what ``monotonically_increasing_id`` gives.
_WITHIN = (1 << 33) - 1


def by_range(df: DataFrame, key: str, then: tuple[str, ...] = (), name: str = "ranges") -> DataFrame:
    """``df`` stored in ranges of ``key``, sorted by it and ``then`` within: with the range's number and, from 0, the row's place in it.

    Spark picks the bounds from a sample and as many ranges as the data needs.
    Rows of equal keys are in one range. The numbers are stored with the rows, as the
    bounds may differ when they are computed again.
    """
    ordered = df.repartitionByRange(key).sortWithinPartitions(key, *then)
    return stored(ordered.withColumn("__range", F.spark_partition_id()).withColumn("__inner", F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN))), name)


def ranked(df: DataFrame, key: str = "key", name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1, in the order of a unique key: its place in its range of keys, on from the counts of earlier ranges."""
    cut = by_range(df, key, name="ranked")
    counts = cut.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    out = cut.join(F.broadcast(counts.select("__range", before.alias("__before"))), "__range")
    return out.withColumn(name, (F.col("__before") + F.col("__inner") + 1).cast("long")).drop("__range", "__inner", "__before")


def point_get(df: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """The live version of one key, or no row. The filter on the key reaches every scan below the aggregation."""
    return live(latest(df.filter(F.col("key") == key), order))


def multi_get(df: DataFrame, keys: DataFrame, order: Column | None = None) -> DataFrame:
    """``keys`` (a column key) with seq, value and status: live, deleted or absent.

    Only rows of wanted keys are resolved: a semi-join, which Spark broadcasts
    when the keys are few and shuffles otherwise.
    """
    found = latest(df.join(keys.select("key").distinct(), "key", "left_semi"), order)
    status = F.when(F.col("deleted").isNull(), "absent").when(F.col("deleted"), "deleted").otherwise("live")
    return keys.join(found, "key", "left").withColumn("status", status)


def unsorted(df: DataFrame, position: str, key: str = "key", chunk: int = 1 << 20) -> DataFrame:
    """Rows whose key is smaller than the one before them in ``position`` order; equal keys are in order.

    Neighbours are compared inside chunks of positions; the last key of each
    chunk is carried to the next one, so no task sorts the whole run.
    """
    cut = df.withColumn("__chunk", F.floor(F.col(position) / chunk))
    inside = cut.withColumn("__before", F.lag(key).over(W.partitionBy("__chunk").orderBy(position)))
    ends = cut.groupBy("__chunk").agg(F.max_by(key, position).alias("__last"))
    carried = ends.withColumn("__carried", F.lag("__last").over(W.orderBy("__chunk"))).select("__chunk", "__carried")
    out = inside.join(carried, "__chunk").withColumn("previous_key", F.coalesce("__before", "__carried"))
    return out.filter(F.col("previous_key") > F.col(key)).drop("__chunk", "__before", "__carried")
