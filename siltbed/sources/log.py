"""Change-log segments: names, listing and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltbed.operators.resolve import latest

SEGMENT = r"^wal-([+-]?[0-9]+)\.log$"


def segment_name(segment: int) -> str:
    return f"wal-{segment}.log"


def segment_id(path: Column) -> Column:
    """The number in a segment's file name, or null."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(name, SEGMENT, 1).try_cast("long")


def segments(paths: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path names a segment, with segment_id and its numeric place."""
    found = paths.withColumn("segment_id", segment_id(F.col(path))).filter("segment_id is not null")
    return found.withColumn("place", F.row_number().over(W.orderBy("segment_id", path)))  # one row for each file of a log


def replay(rows: DataFrame, segment: str = "segment_id", position: str = "position") -> DataFrame:
    """The last write of each key over segments in numeric order; sequence numbers are not compared."""
    return latest(rows, F.struct(segment, position)).drop(segment, position)
