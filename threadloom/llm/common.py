"""What the operators share: the shared folder, written tables, hashing of words, number columns."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SHARED = "file:///tmp/checkpoints/threadloom"
#: The characters that part words, and their complement as a pattern for Java, RE2 and Python alike.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
#: A-Z to a-z, nothing else; UTF-8 bytes over 0x7F stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MASK = (1 << 64) - 1
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own where that is unset and all run on one machine."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (known or DEFAULT_SHARED).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme and host that Hadoop gives it, so that every reader means the same place."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(target).toString()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; it is removed when the driver ends."""
    path = qualified(spark, f"{shared_dir(spark)}/threadloom-{name}-{uuid.uuid4().hex}")
    _written.append((spark, path))
    return path


def written(spark: SparkSession, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there and lost executors cost nothing."""
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes tables of written() that nothing reads any more."""
    for table in tables:
        if (path := table.__dict__.pop("_written_at", None) if table is not None else None) is not None:
            _written.remove((table.sparkSession, path))
            remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session may have ended before us
            return


class Cache(dict):
    """make(key) by key, of the last `limit` to twice as many keys that were asked for, and of those in `first`."""

    def __init__(self, make: Callable[[Any], Any], limit: int, first: dict | None = None):
        super().__init__()
        self.make, self.limit, self.first, self.old = make, limit, first or {}, {}

    def __missing__(self, key: Any) -> Any:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.first.get(key)
        if value is None and (value := self.old.get(key)) is None:
            value = self.make(key)
        self[key] = value
        return value


_words = Cache(xxhash.xxh3_64_intdigest, 60_000)
_resident: dict[Any, Any] = {}


def resident(key: Any, make: Callable[[], Any]) -> Any:
    """make() kept by the worker for its next tasks; only one thing is kept, so that a worker's memory does not add up over stages."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def tidied(batches: Iterator) -> Iterator:
    """batches, and at their end the memory that the worker no longer needs goes back to the system."""
    import pyarrow as pa

    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return np.array([xxhash.xxh3_64_intdigest(i.to_bytes(4, "little"), seed) | 1 for i in range(n)], np.uint64)


_FOLD = odd_numbers(64, 7)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, by position; none if there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = h[:n] * _FOLD[0]
    for j in range(1, k):
        total += h[j : j + n] * _FOLD[j % 64] + np.uint64(j // 64)
    return mixed(total + np.uint64(k))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def texts_of(column, rows: int = 256) -> Iterator[bytes | None]:
    """The UTF-8 bytes of an Arrow string column, null as None; few are Python objects at a time."""
    import pyarrow as pa

    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).cast(pa.large_binary()).to_pylist()


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
