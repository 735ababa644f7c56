"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that a task holds back before it writes them.
ROW_GROUP = 32 << 20
#: Session settings that some operators rely on, where the session has none of its own: batches between the JVM and
#: Python are bounded by bytes, whatever the rows hold, and a query's shuffle files go when it ends.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_OWN: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def mapped(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """`mapInArrow`, after which the worker gives its free memory back: workers are used again, by other stages too."""

    def lean(batches):
        yield from run(batches)
        give_back()

    return frame.mapInArrow(lean, schema)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; where it is unset, a folder of our own in local mode, an error on a cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return _OWN[app]


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{folder(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*frames: DataFrame) -> None:
    """Delete tables made by `store` that nothing will read again; other ones stay."""
    for frame in frames:
        for path in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            if "/graphloom/" in path:
                remove(frame.sparkSession, path)


def store(frame: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write `frame` and return it as read back, so that what follows neither repeats nor depends on its lineage."""
    path = fresh(frame.sparkSession, name)
    schema = frame.schema
    frame.write.option("parquet.block.size", ROW_GROUP).parquet(path, compression=codec)
    return frame.sparkSession.read.schema(schema).parquet(path)
