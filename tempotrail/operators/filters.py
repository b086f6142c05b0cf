"""Selections of results, races and runners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def family_of(race_key: Column, name: Column | None = None) -> Column:
    """The race family by key prefix; with a name, unknown races count as long unless they say 45."""
    known = F.when(race_key.startswith("short"), "short").when(race_key.startswith("long"), "long")
    return known if name is None else F.coalesce(known, F.when(name.contains("45"), "short").otherwise("long"))


def matching(results: DataFrame, race_id: int | None = None, sex: str | None = None, age_class: str | None = None, club: str | None = None, status: str | None = None, ignore: Sequence[str] = ()) -> DataFrame:
    """The conjunction of the given choices, without the ignored ones; the status is compared as published."""
    for column, value in (("race_id", race_id), ("sex", sex), ("age_class", age_class), ("club", club), ("status", status)):
        if value is not None and column not in ignore:
            results = results.filter(F.col(column) == value)
    return results


def search(results: DataFrame, text: str, limit: int = 14, prefix_first: bool = True) -> DataFrame:
    """Runners whose name, club or bib holds the text: names that start with it, newest, best placed first."""
    needle = text.strip().lower()
    hay = F.lower(F.concat_ws(" ", "name", "club", "bib"))
    found = results.filter(hay.contains(needle))
    if prefix_first:
        return found.orderBy(~F.lower("name").startswith(needle), F.desc("year"), F.col("overall_place").asc_nulls_last(), "name", "id").limit(limit)
    return found.orderBy(F.col("finish_seconds").asc_nulls_last(), "id").limit(limit)


def search_histories(histories: DataFrame, text: str, limit: int = 10, least: int = 2) -> DataFrame:
    """Athletes (athlete_id, name, races) by name, most races first; too short a text finds none."""
    needle = text.strip().lower()
    found = histories.filter(F.lower("name").contains(needle) if len(needle) >= least else F.lit(False))
    return found.orderBy(F.desc("races"), "athlete_id").limit(limit)


def select_race(races: DataFrame, family: str, year: int | None) -> DataFrame:
    """The family's race of the year, or else its newest."""
    return races.filter(F.col("family") == family).orderBy((F.col("year") != (year if year is not None else -1)), F.desc("year")).limit(1)


def zoom(points: DataFrame, start: tuple[float, float], end: tuple[float, float], bounds: tuple[float, float, float, float]) -> DataFrame:
    """Points (x, y) in the rectangle between two corners, whatever their order, inside the bounds (x0, x1, y0, y1)."""
    x0, x1, y0, y1 = bounds
    clamp = lambda v, lo, hi: min(max(v, lo), hi)
    xs = sorted((clamp(start[0], x0, x1), clamp(end[0], x0, x1)))
    ys = sorted((clamp(start[1], y0, y1), clamp(end[1], y0, y1)))
    return points.filter(F.col("x").between(*xs) & F.col("y").between(*ys))


def page(rows: DataFrame, number: int, size: int = 10) -> DataFrame:
    """A page of the list by place, then name."""
    return rows.orderBy(F.col("overall_place").asc_nulls_last(), "name", "id").offset(number * size).limit(size)


def hydrate(splits: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Passages with their control's name, number and distance; not estimated unless they say so."""
    c = checkpoints.select("race_id", "checkpoint_key", F.col("name").alias("checkpoint_name"), F.col("sequence_no").alias("checkpoint_no"), F.col("distance_km").alias("checkpoint_km"))
    estimated = F.coalesce("is_estimated", F.lit(0)) if "is_estimated" in splits.columns else F.lit(0)
    return splits.join(c, ["race_id", "checkpoint_key"], "left").withColumn("is_estimated", estimated)


def sample(rows: DataFrame, order: Sequence[str], by: str, size: int = 10) -> DataFrame:
    """Evenly spaced rows of each group, ends included; positions round to even."""
    w = Window.partitionBy(by)
    at = F.row_number().over(w.orderBy(*order)) - 1
    n = F.count("*").over(w)
    out = rows.withColumns({"_at": at, "_n": n})
    chosen = F.exists(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(size - 1)) == F.col("_at"))
    return out.filter((F.col("_n") <= size) | chosen).drop("_at", "_n")
