"""What is sent to Python workers once, and what they keep between their tasks."""

from __future__ import annotations

import ctypes
import gc
import pickle
import time
import uuid
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_HELD: dict[str, tuple[Hashable, Any]] = {}


class Shared:
    """A broadcast value of bounded size, with a name that workers know it by."""

    def __init__(self, spark: SparkSession, value: Any):
        self.key, self._sent = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self) -> Any:
        return self._sent.value


def per_worker(kind: str, key: Hashable, build: Callable[[], Any]) -> Any:
    """The object that ``build`` makes, made once in this process while ``key`` stays the same; one is held of each kind."""
    held = _HELD.get(kind)
    if held is None or held[0] != key:
        _HELD[kind] = held = (key, build())
    return held[1]


def in_one_task(rows: DataFrame, order: list[str], build: Callable[[pa.Table], Any]) -> Any:
    """What ``build`` makes of a bounded number of rows, sorted by ``order``, in one task of an executor; the driver gets the result alone."""
    schema = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in rows.schema.fields])

    def run(batches):
        table = pa.Table.from_batches([b.cast(schema) for b in batches], schema)
        built = pickle.dumps(build(table))
        del table
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array([built], pa.binary())], names=["built"])

    found = rows.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "built binary").first()
    return build(schema.empty_table()) if found is None else pickle.loads(found[0])  # no task runs over an empty table


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def release_memory() -> None:
    """Gives freed memory back to the system: what one task used must not stay with the next, or with a small driver."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


#: Seconds between two trims of the driver's JVM, and when the last one was.
_EVERY = 1.0
_trimmed = [0.0]
#: What ``MBeanServer.invoke`` takes.
_INVOKE = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")


def trim_driver(spark: SparkSession) -> None:
    """Gives back what planning and compiling many queries leaves in the native heap of the driver's JVM (some 200 MB after a few
    dozen jobs): the machine's allocator keeps it otherwise. JVMs that have no such command are left alone."""
    if time.monotonic() - _trimmed[0] < _EVERY:
        return
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    find = jvm.java.lang.Class.forName
    types, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for k, name in enumerate(_INVOKE):
        types[k] = find(name)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    given[2], given[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
    try:  # by reflection: the server's class is not public
        find("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        pass
    _trimmed[0] = time.monotonic()
