"""Joins by range, by nearest, by fallback and by alias."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_dimensions(results: DataFrame, athletes: DataFrame, sources: DataFrame) -> DataFrame:
    return results.join(athletes, "athlete_id").join(sources, "source_id")


def foreign_checkpoints(splits: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Passages (race_id, checkpoint_id) whose control belongs to another race."""
    c = checkpoints.select("checkpoint_id", F.col("race_id").alias("checkpoint_race"))
    return splits.join(c, "checkpoint_id").filter("race_id <> checkpoint_race")


def without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return rows.join(others, key, "left_anti")


def routes_for(races: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """races (race_key, year) with the route of the first rule (order, prefix, first, last, route) that holds.

    Rules are few; a rule holds for a key prefix and a span of years, open where null.
    """
    holds = F.col("race_key").startswith(F.col("prefix")) & (F.col("year") >= F.coalesce("first", F.lit(0))) & (F.col("year") <= F.coalesce("last", F.lit(9999)))
    hits = races.join(rules, holds).groupBy("race_key").agg(F.min_by("route", "order").alias("route"))
    return races.join(hits, "race_key", "left").withColumn("route", F.coalesce("route", F.lit(default)))


def around(points: DataFrame, anchors: DataFrame, by: str, at: str = "at", anchor: str = "anchor", values: Sequence[str] = ()) -> DataFrame:
    """points (by, at) with the last anchor at or before them and the first after, and the values of both.

    An as-of join without a range join: both sides are sorted together once per group.  Columns of the anchor
    before have the prefix prev_, of the one after next_.
    """
    cols = [anchor, *values]
    left = points.withColumns({"_at": F.col(at).cast("double"), "_point": F.lit(1)})
    right = anchors.select(by, F.col(anchor).cast("double").alias("_at"), F.lit(0).alias("_point"), F.struct(*cols).alias("_anchor"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("_at", "_point")
    before = F.last("_anchor", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_anchor", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumns({"_prev": before, "_next": after}).filter("_point = 1")
    return out.select(*points.columns, *(F.col(f"_prev.{c}").alias(f"prev_{c}") for c in cols), *(F.col(f"_next.{c}").alias(f"next_{c}") for c in cols))


def interpolated(at: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """y on the line between two anchors; at the ends the anchor's own."""
    line = y0 + (y1 - y0) * F.try_divide(at - x0, x1 - x0)
    return F.when(x1.isNull() | (at == x0), y0).when(x0.isNull(), y1).otherwise(line)


def by_key_or_name(wanted: DataFrame, splits: DataFrame) -> DataFrame:
    """wanted (result_id, checkpoint_key, name) with the passage of that key, or else of that name (the first of several)."""
    s = splits.select("result_id", "checkpoint_key", F.col("elapsed_seconds").alias("by_key"))
    n = splits.groupBy("result_id", "name").agg(F.min("elapsed_seconds").alias("by_name"))
    return wanted.join(s, ["result_id", "checkpoint_key"], "left").join(n, ["result_id", "name"], "left").withColumn("elapsed_seconds", F.coalesce("by_key", "by_name")).drop("by_key", "by_name")


def by_alias(texts: DataFrame, aliases: Sequence[tuple[str, str]], text: str = "text") -> DataFrame:
    """texts with checkpoint_key, that of the first alias that is the text or a word run of it; lower-case texts."""
    padded = F.concat(F.lit(" "), F.col(text), F.lit(" "))
    key = F.coalesce(*(F.when(padded.contains(f" {alias} "), F.lit(k)) for alias, k in aliases))
    return texts.withColumn("checkpoint_key", key)
