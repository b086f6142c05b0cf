"""Who is who across races and sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempotrail.operators.windows import numbered

MISSING = ("", "UNKNOWN")
#: Athletes of a step, and first letters of a key, by which new athletes are numbered.
STEP, KEY_STEP = 1024, 6


def known(value: Column) -> Column:
    """Null for what says nothing."""
    return F.when(~F.upper(F.trim(value.cast("string"))).isin(*MISSING), value)


def shared_race(results: DataFrame) -> DataFrame:
    """Results whose athlete has another one in the same race."""
    return results.withColumn("_n", F.count("*").over(Window.partitionBy("race_id", "athlete_id"))).filter("_n > 1").drop("_n")


def same_performance(a: str, b: str) -> Column:
    """Whether rows a and b (bib, age_class, status, finish_seconds) are one performance.

    Nothing known on both sides may differ; a shared bib needs one more agreement, without it time and class.
    """
    x, y = (lambda c: known(F.col(f"{a}.{c}"))), (lambda c: known(F.col(f"{b}.{c}")))
    conflict = F.lit(False)
    for c in ("bib", "age_class", "status", "finish_seconds"):
        conflict = conflict | F.coalesce(x(c) != y(c), F.lit(False))
    agree = {c: F.coalesce(x(c) == y(c), F.lit(False)) for c in ("bib", "age_class", "status", "finish_seconds")}
    return ~conflict & ((agree["bib"] & (agree["finish_seconds"] | agree["age_class"] | agree["status"])) | (agree["finish_seconds"] & agree["age_class"]))


def identity_key(row_id: Column, athlete_id: Column, person_id: Column | None = None) -> Column:
    """athlete, person or result; never the name."""
    keys = [F.concat(F.lit("athlete:"), athlete_id.cast("string"))]
    if person_id is not None:
        keys.append(F.concat(F.lit("person:"), person_id.cast("string")))
    return F.coalesce(*keys, F.concat(F.lit("result:"), row_id.cast("string")))


def histories(results: DataFrame) -> DataFrame:
    """Per athlete its results by year, then id."""
    races = F.sort_array(F.collect_list(F.struct("year", "id")))
    return results.groupBy("athlete_id").agg(F.transform(races, lambda r: r["id"]).alias("ids"), F.count("*").alias("races"))


def collisions(results: DataFrame) -> DataFrame:
    """race_id, athlete_id, rows, conflict of athletes with several results in a race.

    They conflict if a field has two known values, or a source names the athlete twice.
    """
    fields = ("bib", "age_class", "status", "finish_seconds", "overall_place")
    differ = F.greatest(*(F.count_distinct(known(F.col(c))) for c in fields))
    per_source = results.groupBy("race_id", "athlete_id", "source").agg(F.count("*").alias("_n"))
    most = per_source.groupBy("race_id", "athlete_id").agg(F.max("_n").alias("most"))
    groups = results.groupBy("race_id", "athlete_id").agg(F.count("*").alias("rows"), differ.alias("differ")).filter("rows > 1")
    return groups.join(most, ["race_id", "athlete_id"]).select("race_id", "athlete_id", "rows", ((F.col("differ") > 1) | (F.col("most") > 1)).alias("conflict"))


def separated(results: DataFrame, first_new: int) -> DataFrame:
    """results (id, race_id, athlete_id, link_id) with new_athlete_id: the row with the least link keeps the athlete."""
    keeper = Window.partitionBy("race_id", "athlete_id").orderBy(F.col("link_id").asc_nulls_last(), "id")
    ranked = shared_race(results).withColumn("_nth", F.row_number().over(keeper))
    moved = numbered(ranked.filter("_nth > 1"), ["race_id", "athlete_id", "id"], {"_race": F.col("race_id"), "_step": F.floor(F.col("athlete_id") / STEP)}, "_no")
    moved = moved.withColumn("new_athlete_id", F.lit(first_new) + F.col("_no")).drop("_no")
    return ranked.filter("_nth = 1").withColumn("new_athlete_id", F.col("athlete_id")).unionByName(moved).drop("_nth")


def resolve(rows: DataFrame, athletes: DataFrame, links: DataFrame, first_new: int) -> DataFrame:
    """rows (row_id, external_id, key, sex, birth_year) with athlete_id.

    A link by external id decides.  Else the athletes of the same normalised name whose sex and birth year
    don't contradict; exactly one is taken.  All other rows become new athletes, one for each name, sex and
    birth year, numbered in that order.
    """
    linked = rows.join(links.select("external_id", F.col("athlete_id").alias("_link")), "external_id", "left")
    fits = lambda c: F.coalesce(F.col(f"r.{c}") == F.col(f"a.{c}"), F.lit(True))
    pairs = linked.filter("_link is null").alias("r").join(athletes.alias("a"), (F.col("r.key") == F.col("a.key")) & fits("sex") & fits("birth_year"))
    single = pairs.groupBy("r.row_id").agg(F.count("*").alias("_n"), F.min("a.athlete_id").alias("_found")).filter("_n = 1").select("row_id", "_found")
    out = linked.join(single, "row_id", "left").withColumn("athlete_id", F.coalesce("_link", "_found"))
    fresh = out.filter("athlete_id is null").select("key", "sex", "birth_year").distinct()
    fresh = numbered(fresh, ["key", "sex", "birth_year"], {"_step": F.left("key", F.lit(KEY_STEP))}, "_no").withColumn("_new", F.lit(first_new) + F.col("_no")).drop("_no")
    same = out["key"].eqNullSafe(fresh["key"]) & out["sex"].eqNullSafe(fresh["sex"]) & out["birth_year"].eqNullSafe(fresh["birth_year"])
    return out.join(fresh, same, "left").select(out["row_id"], F.coalesce(out["athlete_id"], fresh["_new"]).alias("athlete_id"))


def merge_by_priority(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], null_only: bool = False) -> DataFrame:
    """One row a key: the fields of the row of least priority, its gaps filled from the next.

    A gap is a null, and unless null_only an empty or UNKNOWN value; where all are gaps the first row's value
    stays.  sources counts the rows.
    """
    order = lambda c: F.struct("priority", "id", F.col(c).alias("v"))
    filled = []
    for c in fields:
        good = F.col(c).isNotNull() if null_only else known(F.col(c)).isNotNull()
        filled.append(F.coalesce(F.min(F.when(good, order(c)))["v"], F.min(order(c))["v"]).alias(c))
    return rows.groupBy(*keys).agg(*filled, F.count("*").alias("sources"))


def match_levels(existing: DataFrame, official: DataFrame) -> DataFrame:
    """official (oid, race_id, bib, key, finish_seconds, overall_place, age_class) with level, outcome and result_id, matched
    in the same race.

    Level 1 is bib and name with one more field, level 2 name and time, level 3 name, place and class.  The
    first level with a candidate decides: exactly one without a contradiction matches, several are ambiguous,
    one that contradicts is a conflict.
    """
    e, o = existing.alias("e"), official.alias("o")
    eq = lambda c: F.coalesce(F.col(f"e.{c}") == F.col(f"o.{c}"), F.lit(False))
    clash = lambda c: F.coalesce(F.col(f"e.{c}") != F.col(f"o.{c}"), F.lit(False))
    pairs = o.join(e, (F.col("e.race_id") == F.col("o.race_id")) & (F.col("e.key") == F.col("o.key")))
    level = F.when(eq("bib") & (eq("finish_seconds") | eq("overall_place") | eq("age_class")), 1).when(eq("finish_seconds"), 2).when(eq("overall_place") & eq("age_class"), 3)
    conflict = clash("bib") | clash("finish_seconds") | clash("overall_place")
    found = pairs.select("o.oid", F.col("e.id").alias("rid"), level.alias("level"), conflict.alias("conflict")).filter("level is not null")
    first = found.withColumn("_best", F.min("level").over(Window.partitionBy("oid"))).filter("level = _best")
    by = first.groupBy("oid").agg(F.min("level").alias("level"), F.count("*").alias("_n"), F.count_if(~F.col("conflict")).alias("_good"), F.min(F.when(~F.col("conflict"), F.col("rid"))).alias("_rid"))
    outcome = F.when(F.col("_n").isNull(), "unmatched").when(F.col("_good") == 1, "matched").when(F.col("_n") > 1, "ambiguous").otherwise("conflict")
    return official.join(by, "oid", "left").select("oid", "level", outcome.alias("outcome"), F.when(F.col("_good") == 1, F.col("_rid")).alias("result_id"))


# fixed values: what each sign is worth when an event is chosen
EVENT_SCORES = {"verified": 10_000, "pattern": 500, "year": 100, "word": 50, "label_year": 25, "legacy": -25}


def best_event(candidates: DataFrame, signs: dict[str, Column], by: Sequence[str], ties: Sequence[Column]) -> DataFrame:
    """The candidate of each group with the highest score, of equals the greatest by ties."""
    score = sum((F.when(test, EVENT_SCORES[sign]).otherwise(0) for sign, test in signs.items()), F.lit(0))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), *(t.desc() for t in ties))
    return candidates.withColumn("score", score).withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")
