"""Orders, ranks and changes along a course, a race or a career."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def along() -> WindowSpec:
    """A runner's passages in order."""
    return Window.partitionBy("result_id").orderBy("sequence_no")


def backwards(splits: DataFrame) -> DataFrame:
    """Passages with an elapsed time under that of the row before."""
    return splits.withColumn("previous", F.lag("elapsed_seconds").over(along())).filter("elapsed_seconds < previous")


def fold_segments(splits: DataFrame) -> DataFrame:
    """segment, segment_km and pace from elapsed times with gaps.

    A segment counts from the last known time, 0 at the start; it is null after a step back, and the step
    still counts as the last time.  Its distance needs both ends.  Pace falls back to the reported one.
    """
    before = along().rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last("elapsed_seconds", ignorenulls=True).over(before), F.lit(0))
    at = F.when(F.row_number().over(along()) == 1, 0.0).otherwise(F.lag("distance_km").over(along()))
    out = splits.withColumns({"_last": last, "_at": at})
    segment = F.when(F.col("elapsed_seconds") >= F.col("_last"), F.col("elapsed_seconds") - F.col("_last"))
    km = F.when(F.col("distance_km") > F.col("_at"), F.col("distance_km") - F.col("_at"))
    reported = F.col("reported_pace") if "reported_pace" in splits.columns else F.lit(None).cast("double")
    pace = F.coalesce(F.when(segment > 0, segment / km), F.when(reported > 0, reported))
    return out.withColumns({"segment": segment, "segment_km": km, "pace": pace}).drop("_last", "_at")


def strict_segments(splits: DataFrame) -> DataFrame:
    """segment only behind the control right before."""
    follows = F.col("sequence_no") == F.coalesce(F.lag("sequence_no").over(along()), F.lit(0)) + 1
    return splits.withColumn("segment", F.when(follows, F.col("elapsed_seconds") - F.coalesce(F.lag("elapsed_seconds").over(along()), F.lit(0))))


def class_places(splits: DataFrame) -> DataFrame:
    """splits (race_id, age_class, sequence_no, elapsed_seconds, is_estimated, place_class) with gaps of place_class ranked."""
    real = (F.col("is_estimated") == 0) & F.col("elapsed_seconds").isNotNull()
    rows = ranked(splits.withColumn("_real", F.when(real, F.col("elapsed_seconds"))), ["race_id", "age_class", "sequence_no"], "_real", "_place")
    return rows.withColumn("place_class", F.coalesce("place_class", "_place")).drop("_real", "_place")


def _places(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, value, _place (one more than there are smaller values) and _size of the group.

    Values are counted first, so that a task sorts the different values of a group and never its rows.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    before = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(*by, value, (F.coalesce(before, F.lit(0)) + 1).alias("_place"), F.sum("_n").over(w).alias("_size"))


def ranked(rows: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with the place of their value in their group, null without a value."""
    places = _places(rows, by, value).withColumnRenamed("_place", name).drop("_size")
    return rows.join(places, [*by, value], "left").select(*rows.columns, name)


def positions(rows: DataFrame, by: Sequence[str], value: str, tie: str, name: str) -> DataFrame:
    """rows that have a value with their position in their group by it, ties by another column, and _size, the group's."""
    own = F.row_number().over(Window.partitionBy(*by, value).orderBy(tie))
    placed = rows.join(_places(rows, by, value), [*by, value])
    return placed.withColumn(name, F.col("_place") + own - 1).select(*rows.columns, name, "_size")


def numbered(rows: DataFrame, order: Sequence[str], coarse: dict[str, Column], name: str) -> DataFrame:
    """rows numbered from 0 in the order (nulls first); coarse: steps that come in the same order and have far fewer values.

    Rows are numbered inside a step, and steps by the running total of their counts.
    """
    stepped = rows.withColumns(coarse)
    steps = stepped.groupBy(*coarse).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)  # a row a step
    steps = steps.select(*(F.col(c).alias(f"{c}_of") for c in coarse), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.lit(True)
    for c in coarse:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    own = F.row_number().over(Window.partitionBy(*coarse).orderBy(*order))
    return stepped.withColumn("_own", own).join(steps, same).select(*rows.columns, (F.col("_start") + F.col("_own") - 1).alias(name))


def class_scores(finishers: DataFrame, class_column: str = "nclass") -> DataFrame:
    """idx from 100 for a class's first to 0 for its last; ties by position."""
    rows = positions(finishers, ["race_id", "sex", class_column], "finish_seconds", "id", "_i")
    return rows.withColumn("idx", F.when(F.col("_size") == 1, 100.0).otherwise(100.0 * (F.col("_size") - F.col("_i")) / (F.col("_size") - 1))).drop("_i", "_size")


def dominance(finishers: DataFrame, least: int = 5, class_column: str = "nclass") -> DataFrame:
    """Per race and class: winner, per cent under the median, margin to the second, runners, whether enough."""
    by = ["race_id", class_column]
    two = positions(finishers, by, "finish_seconds", "id", "_i").filter("_i <= 2")
    at = lambda c, n: F.max(F.when(F.col("_i") == n, F.col(c)))
    top = two.groupBy(*by).agg(at("id", 1).alias("winner"), at("finish_seconds", 1).alias("_first"), at("finish_seconds", 2).alias("_second"))
    middle = finishers.groupBy(*by).agg(F.median("finish_seconds").alias("_m"), F.count("*").alias("runners"))
    share = 100.0 * (F.col("_m") - F.col("_first")) / F.col("_m")
    return top.join(middle, by).select(*by, "winner", share.alias("dominance"), (F.col("_second") - F.col("_first")).alias("margin"), "runners", (F.col("runners") >= least).alias("eligible"))


def place_changes(splits: DataFrame) -> DataFrame:
    """Per result: total places won from first to last passage and the best single step."""
    step = F.lag("place_overall").over(along()) - F.col("place_overall")
    rows = splits.withColumn("_step", step)
    return rows.groupBy("race_id", "result_id").agg((F.min_by("place_overall", "sequence_no") - F.max_by("place_overall", "sequence_no")).alias("total"), F.max("_step").alias("best"), F.max_by("sequence_no", F.struct(F.coalesce("_step", F.lit(-(10**9))), -F.col("sequence_no"))).alias("best_at"))


def overtakes(splits: DataFrame, k: int = 7) -> DataFrame:
    """The k largest risers of each race."""
    won = place_changes(splits).filter("total > 0 and best > 0")
    return top_per_group(won, k, ["race_id"], F.desc("total"), F.desc("best"), F.col("result_id"))


def closing_gain(splits: DataFrame, middle: int) -> DataFrame:
    """Places won from the middle control to the last one with a place."""
    placed = F.when(F.col("place_overall").isNotNull(), F.col("sequence_no"))
    return splits.groupBy("result_id").agg((F.max(F.when(F.col("sequence_no") == middle, F.col("place_overall"))) - F.max_by("place_overall", placed)).alias("gain"))


def top_per_group(rows: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= k)


def careers(finishers: DataFrame) -> DataFrame:
    """Per athlete: finishes, best, first, last, improvement, spread."""
    key = F.struct("year", "id")
    return finishers.groupBy("athlete_id", "sex").agg(
        F.count("*").alias("finishes"), F.min("finish_seconds").alias("best"), F.min_by("finish_seconds", key).alias("first"), F.max_by("finish_seconds", key).alias("last"),
        (F.min_by("finish_seconds", key) - F.max_by("finish_seconds", key)).alias("improvement"), (F.max("finish_seconds") - F.min("finish_seconds")).alias("spread"),
    )


def between_controls(splits: DataFrame, start: int, end: int) -> DataFrame:
    """seconds, km and places won between two controls; 0 is the start."""
    at = lambda c, n: F.max(F.when(F.col("sequence_no") == n, F.col(c)))
    zero = start == 0
    out = splits.filter(F.col("sequence_no").isin(start, end)).groupBy("race_id", "result_id").agg(
        (at("elapsed_seconds", end) - (F.lit(0) if zero else at("elapsed_seconds", start))).alias("seconds"),
        (at("distance_km", end) - (F.lit(0.0) if zero else at("distance_km", start))).alias("km"),
        (at("place_overall", start) - at("place_overall", end)).alias("won"),
    )
    return out.filter("seconds > 0").withColumn("kmh", F.col("km") * 3600.0 / F.col("seconds"))


def mid_rank_bin(value: str, *by: str) -> Column:
    """0 to 4 by the mid-rank share of a value in its group."""
    w = Window.partitionBy(*by)
    lower = F.rank().over(w.orderBy(value)) - 1
    equal = F.count("*").over(Window.partitionBy(*by, value))
    n = F.count("*").over(w)
    p = (lower + F.greatest(F.lit(0), equal - 1) / 2.0) / (n - 1)
    return F.when(n > 1, F.floor(p * 4 + 0.5)).otherwise(2)
