"""Records, limits, errors, and the precedence of versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A version of a key. A live empty value is an empty binary; a tombstone has no value.
RECORD = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("deleted", T.BooleanType(), False),
])

MAX_KEY_BYTES = 64 << 10
MAX_VALUE_BYTES = 64 << 20

#: Layers from old to new: immutable runs, batches in the log.
TIER_RUN, TIER_CLOSED = 0, 1


class StoreError(Exception):
    """Base of the store's errors."""


class ClosedError(StoreError):
    """The store was closed."""


class NotFoundError(StoreError, KeyError):
    """No live version of a key."""


class DeletedError(NotFoundError):
    """The newest version of a key in a run is a tombstone."""


class UnsortedRecordsError(StoreError):
    """Records of a run are not in ascending key order."""


class CorruptRunError(StoreError):
    """Bytes or metadata of a run that break its format."""


class InvalidFilterError(StoreError):
    """Bloom filter arguments or bytes that break its rules."""


def precedence(tier: Column | int, position: Column | int, seq: Column) -> Column:
    """What orders versions of a key: layer, place in the layer's list, then sequence.

    Layers come first because a read stops at the newest layer that has the key;
    sequence numbers are never compared across layers.
    """
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(tier).cast("int").alias("tier"), as_column(position).cast("long").alias("position"), seq.cast("long").alias("seq"))
