"""What the operators share: a folder all executors see, written intermediate tables, small helpers."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch at most (a single larger row is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 4000, 16 << 20
_own: dict[str, str] = {}
#: Lists that note the folders of stored tables, of the calls that this thread is in.
_noted: ContextVar[tuple[list[str], ...]] = ContextVar("_noted", default=())


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir; where that is unset a temporary one, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.get(spark.sparkContext.applicationId)
        if base is None:
            folder = tempfile.mkdtemp(prefix="shared-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            base = _own[spark.sparkContext.applicationId] = Path(folder).as_uri()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and a lost executor loses nothing.

    The table goes with the session, or before where tidied() or delete() find that nothing reads it.
    """
    path = shared_folder(df.sparkSession, name)
    for paths in _noted.get():
        paths.append(path)
    df.write.parquet(path)
    gone_at_end(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    release(df.sparkSession)
    return out


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders of all tables stored inside."""
    paths: list[str] = []
    token = _noted.set((*_noted.get(), paths))
    try:
        yield paths
    finally:
        _noted.reset(token)


def tidied(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The function, after which the tables are deleted that it stored and that its result doesn't read."""

    @wraps(function)
    def run(*args, **kwargs) -> DataFrame:
        with noted() as paths:
            out = function(*args, **kwargs)
        read = {x.rpartition("/")[0].rpartition("/")[2] for x in out.inputFiles()}
        delete(out.sparkSession, [x for x in paths if x.rpartition("/")[2] not in read])
        return out

    return run


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def gone_at_end(spark: SparkSession, path: str) -> None:
    """Delete the folder when the driver ends."""
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    while paths:
        files, at = _file_system(spark, paths.pop())
        files.delete(at, True)


def release(spark: SparkSession) -> None:
    """Let the driver forget finished shuffles now, so that their files go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches with a bound in rows and bytes, so that very long texts don't make very large batches.

    The same for all operators, and left so: a lazy result is computed under whatever is set when it is read.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def small(df: DataFrame, rows: int) -> bool:
    """Whether a stored table has at most so many rows: the check before a broadcast."""
    return df.count() <= rows


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(df: pd.DataFrame, rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """A large frame as several, for Arrow makes several chunks of a long column, which Spark doesn't take."""
    for at in range(0, len(df), rows):
        yield df.iloc[at : at + rows]
