"""Distributions, rates and speeds of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempotrail.operators.status import started

BIN_SECONDS = 900
#: Speeds over this are errors of timing.
MOST_KMH = 30.0


def pace_of(seconds: Column, km: Column) -> Column:
    return F.when((seconds > 0) & (km > 0), seconds / km)


def speed_of(pace: Column) -> Column:
    return F.when(pace > 0, 3600.0 / pace)


def quantile(value: Column | str, q: float) -> Column:
    """Linear between the two nearest ranks."""
    return F.percentile(value, q)


def bins(results: DataFrame, *by: str, step: int = BIN_SECONDS) -> DataFrame:
    """start and n of every bin of finish times, from the least to the greatest, empty ones included."""
    start = F.floor(F.col("finish_seconds") / step) * step
    counts = results.filter("finish_seconds is not null").groupBy(*by, start.alias("start")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("start").alias("a"), F.max("start").alias("b"))
    every = ends.filter("a is not null").select(F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("start"))
    for c in by:
        every = every.join(results.select(c).distinct(), how="cross")  # bins with the values of a dimension
    return every.join(counts, [*by, "start"], "left").select(*by, "start", F.coalesce("n", F.lit(0)).alias("n"))


def group_speed(samples: DataFrame, *by: str, least: int = 2) -> DataFrame:
    """kmh of whole groups, all distance over all time, from valid samples (km, seconds); null of too few."""
    kmh = F.col("km") * 3600.0 / F.col("seconds")
    good = samples.filter((F.col("km") > 0) & (F.col("seconds") > 0) & (kmh <= MOST_KMH))
    out = good.groupBy(*by).agg(F.sum("km").alias("_km"), F.sum("seconds").alias("_s"), F.count("*").alias("n"))
    return out.select(*by, "n", F.when(F.col("n") >= least, F.col("_km") * 3600.0 / F.col("_s")).alias("kmh"))


def index(speed: Column, reference: Column) -> Column:
    return F.when((speed > 0) & (reference > 0), 100 * speed / reference)


def fastest_tenth(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean of the fastest tenth of each group, at least one row, and how many they are."""
    w = Window.partitionBy(*by)
    ranked = rows.filter(F.col(value) > 0).withColumns({"_i": F.row_number().over(w.orderBy(F.desc(value))), "_n": F.count("*").over(w)})
    return ranked.filter(F.col("_i") <= F.floor((F.col("_n") + 9) / 10)).groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def most_frequent(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """The most frequent value of each group, of equals the first."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def share(part: Column, whole: Column) -> Column:
    """Per cent with one decimal, 0 of nothing."""
    return F.when(whole > 0, F.floor(part / whole * 1000 + 0.5) / 10).otherwise(F.lit(0.0))


def starters() -> Column:
    return F.count_if(started())


def finishers() -> Column:
    return F.count_if(F.col("category") == "finished")


def finish_times() -> Column:
    return F.when(F.col("category") == "finished", F.col("finish_seconds"))


def with_empty(groups: DataFrame, dimensions: DataFrame, keys: list[str]) -> DataFrame:
    """Groups for all combinations of keys in dimensions, counts 0 where there is none."""
    out = dimensions.join(groups, keys, "left")
    counts = [f.name for f in groups.schema.fields if f.name not in keys and f.dataType.simpleString() in ("bigint", "int")]
    return out.fillna(0, counts)
