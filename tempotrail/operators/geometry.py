"""Routes: lengths, elevation, simplification, points along the way.

A route is a table of points (route_id, idx, lat, lon, elev); a measured one also has km.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tempotrail.functions.maths import haversine
from tempotrail.operators.joins import around, interpolated
from tempotrail.operators.simplify import TOLERANCE_M, kept_indices

# fixed values: limits of plausible tracks
GRADE_SPAN_KM, MOST_GRADE = 0.06, 35.0
ELEVATIONS = (-50.0, 1000.0)
MOST_GAP_POINTS, MOST_GAP_KM = 8, 0.5


def route() -> WindowSpec:
    return Window.partitionBy("route_id").orderBy("idx")


def upto() -> WindowSpec:
    return route().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    return Window.partitionBy("route_id")


def step_km() -> Column:
    """From the point before."""
    return F.coalesce(haversine(F.lag("lat").over(route()), F.lag("lon").over(route()), F.col("lat"), F.col("lon")), F.lit(0.0))


def measured(points: DataFrame) -> DataFrame:
    """With raw_km, unrounded, and km, to the metre."""
    out = points.withColumn("_step", step_km())
    out = out.withColumn("raw_km", F.sum("_step").over(upto())).drop("_step")
    return out.withColumn("km", F.round("raw_km", 3))


def normalised(points: DataFrame, official: Column) -> DataFrame:
    """km scaled to the official length, which the last point has exactly."""
    last = F.max("km").over(whole())
    end = F.col("idx") == F.max("idx").over(whole())
    return points.withColumn("km", F.when(end, official).otherwise(F.round(F.col("km") * (official / last), 3)))


def profile(points: DataFrame, most: int = 420) -> DataFrame:
    """Every so many points and the last, of routes whose elevations can be trusted."""
    good = F.when(F.col("elev").between(*ELEVATIONS), F.col("elev"))
    rows = points.withColumns({"_n": F.count("*").over(whole()), "_good": F.count(good).over(whole()), "_range": F.max(good).over(whole()) - F.min(good).over(whole()), "_end": F.max("idx").over(whole())})
    rows = rows.filter((F.col("_good") >= 0.95 * F.col("_n")) & (F.col("_range") >= 5))
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / most))
    return rows.filter((F.col("idx") % step == 0) | (F.col("idx") == F.col("_end"))).select("route_id", "idx", F.round("km", 3).alias("km"), F.round("elev", 1).alias("elev"))


def filled(points: DataFrame) -> DataFrame:
    """Short gaps of elev between two known points filled by the distance walked; needs raw_km."""
    known = F.when(F.col("elev").isNotNull(), F.struct("idx", "raw_km", "elev"))
    rows = points.withColumns({"_l": F.last(known, ignorenulls=True).over(upto()), "_r": F.first(known, ignorenulls=True).over(route().rowsBetween(0, Window.unboundedFollowing))})
    span = F.col("_r.raw_km") - F.col("_l.raw_km")
    small = (F.col("_r.idx") - F.col("_l.idx") - 1 <= MOST_GAP_POINTS) & (span > 0) & (span <= MOST_GAP_KM)
    line = F.col("_l.elev") + (F.col("_r.elev") - F.col("_l.elev")) * F.try_divide(F.col("raw_km") - F.col("_l.raw_km"), span)
    return rows.withColumn("elev", F.coalesce("elev", F.when(small, line))).drop("_l", "_r")


def smoothed(points: DataFrame, radius: int = 2) -> DataFrame:
    """The median of the known elevations around each point; unknown stays unknown."""
    near = F.collect_list("elev").over(route().rowsBetween(-radius, radius))
    ordered, n = F.array_sort(near), F.size(near)
    median = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    return points.withColumn("elev", F.when(F.col("elev").isNotNull(), median))


def climbed(points: DataFrame) -> DataFrame:
    """ascent and descent up to each point."""
    rows = points.withColumn("_d", F.coalesce(F.col("elev") - F.lag("elev").over(route()), F.lit(0.0)))
    return rows.withColumns({"ascent": F.sum(F.greatest(F.lit(0.0), F.col("_d"))).over(upto()), "descent": F.sum(F.greatest(F.lit(0.0), -F.col("_d"))).over(upto())}).drop("_d")


def grades(points: DataFrame) -> DataFrame:
    """grade in per cent between the nearest points at least 30 m behind and ahead, clipped; needs raw_km.

    Distances along a route only grow, so both points come from range frames of a window.
    """
    half = round(GRADE_SPAN_KM / 2 * 1e6)
    along = Window.partitionBy("route_id").orderBy(F.round(F.col("raw_km") * 1e6).cast("long"))  # millimetres
    here = F.struct("raw_km", "elev")
    behind, ahead = along.rangeBetween(Window.unboundedPreceding, -half), along.rangeBetween(half, Window.unboundedFollowing)
    left = F.coalesce(F.max_by(here, "idx").over(behind), F.first(here).over(upto()))
    right = F.coalesce(F.min_by(here, "idx").over(ahead), F.last(here).over(route().rowsBetween(0, Window.unboundedFollowing)))
    rows = points.withColumns({"_l": left, "_r": right})
    span = F.col("_r.raw_km") - F.col("_l.raw_km")
    raw = (F.col("_r.elev") - F.col("_l.elev")) / (span * 1000) * 100
    return rows.withColumn("grade", F.when(F.col("elev").isNotNull() & raw.isNotNull() & (span >= GRADE_SPAN_KM), F.greatest(F.lit(-MOST_GRADE), F.least(F.lit(MOST_GRADE), raw)))).drop("_l", "_r")


def simplified(points: DataFrame, tolerance_m: float = TOLERANCE_M) -> DataFrame:
    """The points that keep the line within the tolerance; a route is one group, as tracks are thousands of points."""

    keep = kept_indices  # the function alone goes to the workers

    def reduce(points: pd.DataFrame) -> pd.DataFrame:
        track = points.sort_values("idx")
        return track.iloc[keep(track[["lat", "lon"]].to_numpy(), tolerance_m)]

    rows = points.select("route_id", "idx", "lat", "lon")
    return rows.groupBy("route_id").applyInPandas(reduce, rows.schema)


def gates(points: DataFrame, official: Column) -> DataFrame:
    """route_id and code of everything that makes a track unfit; needs raw_km."""
    rows = points.withColumns({"_step": F.col("raw_km") - F.coalesce(F.lag("raw_km").over(route()), F.lit(0.0)), "_jump": F.abs(F.col("elev") - F.last("elev", ignorenulls=True).over(route().rowsBetween(Window.unboundedPreceding, -1)))})
    g = rows.groupBy("route_id").agg(F.max("raw_km").alias("km"), F.max("_step").alias("step"), (F.count("elev") / F.count("*")).alias("known"), F.min("elev").alias("low"), F.max("elev").alias("high"), F.max("_jump").alias("jump"), F.count_if(~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 180)).alias("outside"))
    checks = {
        "coordinates": F.col("outside") > 0, "length": ~F.col("km").between(official * 0.9, official * 1.1), "leap": F.col("step") > 2, "elevation_missing": F.col("known") < 0.95,
        "elevation_range": (F.col("low") < ELEVATIONS[0]) | (F.col("high") > ELEVATIONS[1]), "elevation_spike": F.col("jump") > 80,
    }
    return g.select("route_id", F.explode(F.array_compact(F.array(*(F.when(test, code) for code, test in checks.items())))).alias("code"))


def bounds(points: DataFrame) -> DataFrame:
    return points.groupBy("route_id").agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))


def at_distances(wanted: DataFrame, points: DataFrame, *values: str) -> DataFrame:
    """wanted (route_id, at in km) with the values of the route there, on the line between two points."""
    end = points.groupBy("route_id").agg(F.max("km").alias("_end"))
    clamped = wanted.join(end, "route_id").withColumn("at", F.greatest(F.lit(0.0), F.least("at", "_end"))).drop("_end")
    both = around(clamped, points.withColumnRenamed("km", "anchor"), "route_id", values=values)
    here = lambda v: interpolated(F.col("at"), F.col("prev_anchor"), F.col(f"prev_{v}"), F.col("next_anchor"), F.col(f"next_{v}"))
    return both.select(*clamped.columns, *(here(v).alias(v) for v in values))


def ascending(checkpoints: DataFrame) -> DataFrame:
    """Controls (route_id, nth, at) that lie before the one in front of them."""
    return checkpoints.withColumn("_before", F.lag("at").over(Window.partitionBy("route_id").orderBy("nth"))).filter("at < _before").drop("_before")


def shifted(checkpoints: DataFrame, official: float, old: float) -> DataFrame:
    """Controls (at, is_finish) moved to an older course of another length."""
    return checkpoints.withColumn("at", F.when(F.col("is_finish"), old).when(F.col("at") == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.col("at") - (official - old)), 3)))


def bezier(a: tuple[Column, Column], b: tuple[Column, Column], t: Column) -> tuple[Column, Column]:
    """A gentle curve between two points."""
    # fixed values: how far the middle lies off the line
    bend = (0.0022, 0.0008)
    u = 1 - t
    lat, lon = (u * u * p + 2 * u * t * ((p + q) / 2 + d) + t * t * q for p, q, d in zip(a, b, bend, strict=True))
    return lat, lon


def oriented(points: DataFrame, starts: DataFrame) -> DataFrame:
    """Turned round where the end is nearer to the start (route_id, start_lat, start_lon) than the beginning."""
    ends = points.groupBy("route_id").agg(F.min_by(F.struct("lat", "lon"), "idx").alias("_a"), F.max_by(F.struct("lat", "lon"), "idx").alias("_b"), F.max("idx").alias("_last"))
    near = ends.join(starts, "route_id").select("route_id", "_last", (haversine(F.col("_b.lat"), F.col("_b.lon"), F.col("start_lat"), F.col("start_lon")) < haversine(F.col("_a.lat"), F.col("_a.lon"), F.col("start_lat"), F.col("start_lon"))).alias("_turn"))
    return points.join(near, "route_id").withColumn("idx", F.when(F.col("_turn"), F.col("_last") - F.col("idx")).otherwise(F.col("idx"))).drop("_turn", "_last")


def projected(points: DataFrame, width: float, height: float, pad: float) -> DataFrame:
    """x and y on a picture in Mercator's projection, all of the route inside."""
    mx, my = F.radians("lon"), F.ln(F.tan(F.lit(math.pi / 4) + F.radians("lat") / 2))
    rows = points.withColumns({"_x": mx, "_y": my})
    lo_x, hi_x, lo_y, hi_y = (f(c).over(whole()) for c in ("_x", "_y") for f in (F.min, F.max))
    scale = F.least(F.lit(width - 2 * pad) / F.coalesce(F.nullif(hi_x - lo_x, F.lit(0.0)), F.lit(1.0)), F.lit(height - 2 * pad) / F.coalesce(F.nullif(hi_y - lo_y, F.lit(0.0)), F.lit(1.0)))
    x = (width - (hi_x - lo_x) * scale) / 2 + (F.col("_x") - lo_x) * scale
    y = height - ((height - (hi_y - lo_y) * scale) / 2 + (F.col("_y") - lo_y) * scale)
    return rows.withColumns({"x": x, "y": y}).drop("_x", "_y")


def sliced(points: DataFrame, start: float, end: float) -> DataFrame:
    """The points between two distances and the two ends, in order of km."""
    ends = points.select("route_id").distinct().withColumn("at", F.explode(F.array(F.lit(start), F.lit(end))))
    cut = at_distances(ends, points, "lat", "lon").select("route_id", F.col("at").alias("km"), "lat", "lon")
    inner = points.filter((F.col("km") > start) & (F.col("km") < end)).select("route_id", "km", "lat", "lon")
    return inner.unionByName(cut)
