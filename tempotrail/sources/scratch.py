"""Folders for files that only a query of its own session reads."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's name under spark.checkpoint.dir (on one machine a temporary one where that is unset); it goes with the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = Path(tempfile.gettempdir()).as_uri()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, at = _at(spark, path)
    files.deleteOnExit(at)
    return path


def replace(spark: SparkSession, made: str, target: str) -> None:
    """Put a finished folder in the place of another: readers see the old one or the new one, whole.

    The old one steps aside first, for a rename doesn't replace; a run that stops in between leaves it beside.
    """
    files, source = _at(spark, made)
    _, place = _at(spark, target)
    _, aside = _at(spark, f"{target.rstrip('/')}.old-{uuid.uuid4().hex}")
    files.mkdirs(place.getParent())
    had = files.exists(place)
    if had and not files.rename(place, aside):
        raise OSError(f"can't move {target}")
    if not files.rename(source, place):
        if had:
            files.rename(aside, place)
        raise OSError(f"can't move {made} to {target}")
    if had:
        files.delete(aside, True)
