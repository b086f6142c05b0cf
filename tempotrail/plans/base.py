"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType

from tempotrail.plans.proxy import Model, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def wide(df: DataFrame) -> DataFrame:
    """Whole numbers as longs, so that results compare with any engine's."""
    return df.withColumns({f.name: F.col(f.name).cast("long") for f in df.schema.fields if isinstance(f.dataType, (IntegerType, ShortType, ByteType))})


def query(name: str, body: str | None = None, **views: str) -> Callable:
    """Register a function of the model; body is SQL over the model's views that gives the same rows."""

    def register(function: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        QUERIES[name] = lambda spark, folder: wide(function(Model(spark, folder)))
        if body is not None:
            ORACLE_SQL[name] = sql(body, **views)
        return function

    return register
