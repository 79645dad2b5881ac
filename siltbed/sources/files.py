"""Small files and folders through Hadoop's file system, so any store that Spark reaches can hold a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the one that was set on the context. Only where driver
    and executors are one process (tests, local mode) a temporary folder of this machine does, made once per session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siltbed-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what is numbered by partition must not be computed twice."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def list(self, name: str = "") -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Writes a file that must not exist yet, all at once; False if another writer was first."""
        temp = self._path(f"{name}.tmp-{self._jvm.java.util.UUID.randomUUID().toString()}")
        stream = self._fs.create(temp, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else self._fs.getUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        options[0] = rename.NONE
        try:
            context.rename(temp, self._path(name), options)
        except Exception as e:  # the JVM's FileAlreadyExistsException
            self._fs.delete(temp, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def age(self, name: str) -> float:
        """Seconds since a file, or anything directly in a folder, last changed."""
        path = self._path(name)
        times = [self._fs.getFileStatus(path).getModificationTime(), *(x.getModificationTime() for x in self._fs.listStatus(path))]
        return (self._jvm.java.lang.System.currentTimeMillis() - max(times)) / 1000

    def delete(self, name: str) -> None:
        """Removes a file or folder; nothing happens if there is none."""
        self._fs.delete(self._path(name), True)
