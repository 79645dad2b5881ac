"""Intermediate tables in the folder that driver and executors share.

Long plans are cut by writing a Parquet table and reading it back: unlike a
local checkpoint it survives the loss of any executor, and unlike
``checkpoint()`` the plan is computed once and keeps its columns prunable.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from siltbed.llm.worker import trim_driver
from siltbed.sources.files import shared_dir


class Scope:
    """Paths of the tables that were stored since it was opened."""

    def __init__(self):
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Leaves the table that ``df`` was stored as to the scope around this one."""
        path = getattr(df, "_stored_at", None)
        if path in self.paths:
            self.paths.remove(path)
            if len(_scopes) > 1:
                _scopes[-2].paths.append(path)
        return df


_scopes: list[Scope] = []


@contextmanager
def cleared(spark: SparkSession) -> Iterator[Scope]:
    """On leaving, deletes the tables that were stored inside and not kept: nothing lazy may read them any more."""
    scope = Scope()
    _scopes.append(scope)
    try:
        yield scope
    finally:
        _scopes.remove(scope)
        for path in scope.paths:
            _delete(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a table scan."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].paths.append(path)
    df.write.parquet(path)
    trim_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_scratch(df: DataFrame) -> None:
    """Deletes the table that ``materialize`` stored ``df`` as, once it is no longer needed."""
    path = df._stored_at
    for scope in _scopes:
        if path in scope.paths:
            scope.paths.remove(path)
    _delete(df.sparkSession, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
