"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Bytes of rows that go to Python at once, so that a task's memory doesn't hang on the length of texts.
BATCH_BYTES = "8m"


#: The same for steps that run in many tasks beside each other's leavings: their buffers grow by doubling, in the JVM too.
SMALL_BATCH_BYTES = "2m"
#: What Python workers keep from task to task, such as tokenizers.
_kept: list[dict] = []


def limit_batches(spark: SparkSession, size: str = BATCH_BYTES) -> None:
    """Sets the size of Arrow batches for what is planned from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def kept() -> dict:
    """A dict for what tasks of one step keep in a Python worker; a lean task of another step empties it."""
    _kept.append({})
    return _kept[-1]


def forget() -> None:
    """Empties what other steps kept in this worker."""
    if any(_kept):
        for held in _kept:
            held.clear()
        give_back()


def give_back() -> None:
    """Gives freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library than GNU's
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that drops what other steps kept and gives memory back to the system at its end: Python workers live on beside the next step's JVM."""

    @functools.wraps(run)
    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from run(batches)
        give_back()

    return lean_run


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only if it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and reads it again, so that no step before it runs twice."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
