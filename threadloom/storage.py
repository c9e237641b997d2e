"""Small files and folders on any file system that Hadoop knows, from the driver."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


class Storage:
    """Operations below one root; the root's scheme decides the file system."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)
        self.root = self._fs.makeQualified(self._path(root)).toString().rstrip("/")

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def create(self, path: str, text: str = "") -> None:
        """Writes a file that must not exist; FileExistsError where it does."""
        if self.exists(path):
            raise FileExistsError(path)
        try:
            stream = self._fs.create(self._path(path), False)  # fails too where another was faster
        except Exception as e:
            if self.exists(path):
                raise FileExistsError(path) from e
            raise
        try:
            stream.write(text.encode("utf-8"))
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Writes a file in one step: readers see the old text or the new."""
        new = f"{path}.new"
        self.remove(new)
        self.create(new, text)
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        context.rename(self._path(new), self._path(path), options)


_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where all run on one machine."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (known or "file:///tmp/checkpoints/threadloom").rstrip("/")


def staged(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, where a plan must be cut; removed when the driver ends."""
    path, schema = f"{shared_dir(spark)}/threadloom-staged-{uuid.uuid4().hex}", df.schema
    _staged.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            if spark.sparkContext._jsc is not None:
                Storage(spark, path).remove(path)
        except Exception:  # the session may have ended before us
            return
