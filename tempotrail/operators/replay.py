"""A race played again: a runner's anchors, time and place along the course, and references to run against."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempotrail.operators.joins import around, interpolated

# fixed values: sizes of reference groups
LEAST_PROFILES, LEAST_MEDAL, MEDAL_SIDE = 5, 20, 40
#: Seconds from the limit at which a candidate's weight is half.
MEDAL_SCALE = 600
SAME_KM, AT_END_KM = 0.01, 0.05


def anchors(results: DataFrame, splits: DataFrame) -> DataFrame:
    """result_id, km, seconds, kind: the start, every passage, and the finish of those who have one.

    results: result_id, finish_seconds (null for who didn't finish), race_km.
    """
    start = results.select("result_id", F.lit(0.0).alias("km"), F.lit(0).cast("long").alias("seconds"), F.lit("start").alias("kind"))
    passed = splits.filter("elapsed_seconds > 0").join(results.select("result_id", "race_km"), "result_id").select("result_id", F.least("distance_km", "race_km").alias("km"), F.col("elapsed_seconds").alias("seconds"), F.lit("split").alias("kind"))
    end = results.filter("finish_seconds > 0").select("result_id", F.col("race_km").alias("km"), F.col("finish_seconds").alias("seconds"), F.lit("finish").alias("kind"))
    return start.unionByName(passed).unionByName(end)


def map_anchors(rows: DataFrame) -> DataFrame:
    """The anchors that move on in time and not back in distance; of those at one place the last."""
    by_time = Window.partitionBy("result_id").orderBy("seconds", "km")
    moved = rows.withColumns({"_s": F.lag("seconds").over(by_time), "_k": F.lag("km").over(by_time)}).filter("_s is null or (seconds > _s and km >= _k)")
    place = F.round(F.col("km") / SAME_KM)
    nth = F.row_number().over(Window.partitionBy("result_id", place).orderBy(F.desc("seconds")))
    return moved.withColumn("_nth", nth).filter("_nth = 1").drop("_s", "_k", "_nth")


def quality(rows: DataFrame) -> DataFrame:
    """result_id, exact and label by the number of passages."""
    n = F.count_if(F.col("kind") == "split")
    return rows.groupBy("result_id").agg(n.alias("exact")).withColumn("label", F.when(F.col("exact") >= 3, "high").when(F.col("exact") >= 1, "partial").otherwise("estimate"))


def segments(splits: DataFrame) -> DataFrame:
    """seconds (from elapsed times, else as reported), km, pace and places won of each stretch."""
    w = Window.partitionBy("result_id").orderBy("sequence_no")
    follows = F.coalesce(F.lag("sequence_no").over(w), F.lit(0)) == F.col("sequence_no") - 1
    gap = F.when(follows, F.col("elapsed_seconds") - F.coalesce(F.lag("elapsed_seconds").over(w), F.lit(0)))
    km = F.col("distance_km") - F.coalesce(F.lag("distance_km").over(w), F.lit(0.0))
    out = splits.withColumns({"seconds": F.coalesce(F.when(gap > 0, gap), F.when(F.col("segment_seconds") > 0, F.col("segment_seconds"))), "km": km, "won": F.lag("place_overall").over(w) - F.col("place_overall")})
    return out.withColumn("pace", F.when((F.col("seconds") > 0) & (F.col("km") > 0), F.col("seconds") / F.col("km")))


def time_at(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """wanted (result_id, at in km) with seconds there."""
    both = around(wanted, rows.select("result_id", F.col("km").alias("anchor"), "seconds"), "result_id", values=["seconds"])
    return both.select(*wanted.columns, interpolated(F.col("at"), F.col("prev_anchor"), F.col("prev_seconds"), F.col("next_anchor"), F.col("next_seconds")).cast("double").alias("seconds"))


def distance_at(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """wanted (result_id, at in seconds) with km there."""
    both = around(wanted, rows.select("result_id", F.col("seconds").alias("anchor"), "km"), "result_id", values=["km"])
    return both.select(*wanted.columns, interpolated(F.col("at"), F.col("prev_anchor"), F.col("prev_km"), F.col("next_anchor"), F.col("next_km")).cast("double").alias("km"))


def complete_profiles(finishers: DataFrame, splits: DataFrame, controls: int) -> DataFrame:
    """result_id, sequence_no, seconds of finishers with a growing time at every control; the finish is the last.

    finishers: result_id, finish_seconds.
    """
    own = splits.filter((F.col("sequence_no") < controls) & F.col("elapsed_seconds").isNotNull()).select("result_id", "sequence_no", F.col("elapsed_seconds").alias("seconds"))
    end = finishers.select("result_id", F.lit(controls).alias("sequence_no"), F.col("finish_seconds").alias("seconds"))
    rows = own.join(finishers.select("result_id"), "result_id", "left_semi").unionByName(end)
    w = Window.partitionBy("result_id")
    rows = rows.withColumns({"_gain": F.col("seconds") - F.coalesce(F.lag("seconds").over(w.orderBy("sequence_no")), F.lit(0))})
    rows = rows.withColumns({"_n": F.count("*").over(w), "_least": F.min("_gain").over(w)})
    return rows.filter((F.col("_n") == controls) & (F.col("_least") > 0)).drop("_gain", "_n", "_least")


def rising(times: DataFrame, by: Sequence[str]) -> DataFrame:
    """seconds pushed up so that each is at least one more than the one before."""
    w = Window.partitionBy(*by).orderBy("sequence_no").rowsBetween(Window.unboundedPreceding, 0)
    return times.withColumn("seconds", F.greatest(F.max(F.col("seconds") - F.col("sequence_no")).over(w), F.lit(0)) + F.col("sequence_no"))


def median_reference(profiles: DataFrame, by: Sequence[str], least: int = LEAST_PROFILES) -> DataFrame:
    """The median profile of each group that is large enough."""
    medians = profiles.groupBy(*by, "sequence_no").agg(F.floor(F.median("seconds") + 0.5).cast("long").alias("seconds"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return rising(medians, by)


def medal_candidates(finishers: DataFrame, by: Sequence[str], side: int = MEDAL_SIDE, fill: int = 40) -> DataFrame:
    """The finishers (result_id, finish_seconds, medal) nearest to the limit on each side, topped up to fill."""
    away = F.abs(F.col("finish_seconds") - F.col("medal"))
    under = F.col("finish_seconds") <= F.col("medal")
    order = [away, F.col("finish_seconds"), F.col("result_id")]
    rows = finishers.withColumn("_side", F.row_number().over(Window.partitionBy(*by, under).orderBy(*order)))
    rows = rows.withColumn("_chosen", F.col("_side") <= side)
    rows = rows.withColumns({"_n": F.count_if("_chosen").over(Window.partitionBy(*by)), "_rest": F.row_number().over(Window.partitionBy(*by, "_chosen").orderBy(*order))})
    return rows.filter(F.col("_chosen") | (F.col("_n") + F.col("_rest") <= fill)).withColumn("weight", 1 / (1 + away / MEDAL_SCALE)).drop("_side", "_chosen", "_n", "_rest")


def weighted_median(rows: DataFrame, value: str, weight: str, by: Sequence[str]) -> DataFrame:
    """The first value at which the running weight reaches half."""
    w = Window.partitionBy(*by)
    order = w.orderBy(value, weight).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"_upto": F.sum(weight).over(order), "_all": F.sum(weight).over(w)}).filter(F.col("_upto") >= F.col("_all") / 2).groupBy(*by).agg(F.min(value).alias(value))


def medal_reference(profiles: DataFrame, candidates: DataFrame, by: Sequence[str], controls: int, least: int = LEAST_MEDAL) -> DataFrame:
    """The profile of a finish at the limit: weighted medians of time shares, in order, ending at the limit."""
    enough = candidates.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).filter(F.col("_n") >= least).drop("_n")
    shares = profiles.join(enough, "result_id").withColumn("share", F.col("seconds") / F.col("finish_seconds"))
    medians = weighted_median(shares, "share", "weight", [*by, "medal", "sequence_no"])
    times = medians.withColumn("seconds", F.when(F.col("sequence_no") == controls, F.col("medal")).otherwise(F.floor(F.col("share") * F.col("medal") + 0.5)).cast("long"))
    capped = times.withColumn("seconds", F.least("seconds", F.col("medal") - (controls - F.col("sequence_no"))))
    return rising(capped, by).drop("share")


def insights(rows: DataFrame) -> DataFrame:
    """result_id, kind, sequence_no, value: what stands out in a runner's segments (result_id, sequence_no, pace, won)."""
    good = rows.filter("pace is not null")
    w = Window.partitionBy("result_id").orderBy("sequence_no")
    good = good.withColumns({"_turn": F.abs(F.col("pace") - F.lag("pace").over(w)), "_last": F.max("sequence_no").over(Window.partitionBy("result_id"))})
    first = lambda *keys: F.struct(*keys, "sequence_no")
    no = -F.col("sequence_no")
    g = good.groupBy("result_id").agg(
        F.min_by("sequence_no", first("pace")).alias("fast"), F.max_by("sequence_no", F.struct("pace", no)).alias("tough"),
        F.max_by(F.struct("sequence_no", "won"), F.when(F.col("won") > 0, F.struct("won", no))).alias("gain"), F.min_by(F.struct("sequence_no", "won"), F.when(F.col("won") < 0, F.struct("won", "sequence_no"))).alias("loss"),
        F.median("pace").alias("median"), F.max_by("pace", "sequence_no").alias("final"), F.max("_last").alias("last"), F.min_by("sequence_no", F.when(F.col("_turn").isNotNull(), first("_turn"))).alias("even"), F.count("*").alias("n"),
    )
    item = lambda kind, test, at, value: F.when(test, F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("sequence_no"), value.cast("double").alias("value")))
    none = F.lit(None).cast("double")
    found = F.array_compact(F.array(
        item("fast", F.lit(True), F.col("fast"), none), item("tough", F.col("tough") != F.col("fast"), F.col("tough"), none), item("gain", F.col("gain.won") > 0, F.col("gain.sequence_no"), F.col("gain.won")), item("loss", F.col("loss.won") < 0, F.col("loss.sequence_no"), F.col("loss.won")),
        item("strong_finish", (F.col("n") >= 3) & (F.col("final") < F.col("median")), F.col("last"), none), item("even", F.col("n") >= 3, F.col("even"), none),
    ))
    return g.select("result_id", F.explode(found).alias("i")).select("result_id", "i.*")


def standing(states: DataFrame, race: str = "race_id") -> DataFrame:
    """states (race, result_id, progress, end_seconds) with rank at the clock time."""
    return states.withColumn("rank", F.row_number().over(Window.partitionBy(race).orderBy(F.desc("progress"), "end_seconds", "result_id")))


def passages_between(splits: DataFrame, start: Column | int, end: Column | int) -> DataFrame:
    """Each runner's latest passage in (start, end]."""
    return splits.filter((F.col("elapsed_seconds") > start) & (F.col("elapsed_seconds") <= end)).groupBy("result_id").agg(F.max_by("sequence_no", "elapsed_seconds").alias("sequence_no"), F.max("elapsed_seconds").alias("elapsed_seconds"))
